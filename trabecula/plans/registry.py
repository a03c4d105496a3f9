"""Skeleton backends by name. A backend has a name, build_config(options) and run(voxels, config) -> skeleton voxels."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..operators.mcp import MCPConfig, mcp_skeletons
from ..operators.thinning import ThinningConfig, thinned


class SkeletonBackend(Protocol):
    name: str

    def build_config(self, options: dict[str, Any]) -> Any: ...

    def run(self, voxels: DataFrame, config: Any) -> tuple[DataFrame, DataFrame | None]: ...


_BACKENDS: dict[str, SkeletonBackend] = {}


def register_backend(backend: SkeletonBackend) -> SkeletonBackend:
    _BACKENDS[backend.name] = backend
    return backend


def get_backend(name: str) -> SkeletonBackend:
    if name not in _BACKENDS:
        raise KeyError(f"unknown algorithm {name!r}; there are: {', '.join(list_backends())}")
    return _BACKENDS[name]


def list_backends() -> list[str]:
    return sorted(_BACKENDS)


def _only(kind, options: dict[str, Any]):
    return kind(**{k: v for k, v in options.items() if k in kind.__dataclass_fields__ and v is not None}).validate()


class GrowthBackend:
    name = "mcp"

    def build_config(self, options: dict[str, Any]) -> MCPConfig:
        return _only(MCPConfig, options)

    def run(self, voxels: DataFrame, config: MCPConfig) -> tuple[DataFrame, DataFrame | None]:
        return mcp_skeletons(voxels, config)


class ThinningBackend:
    name = "lee94"

    def build_config(self, options: dict[str, Any]) -> ThinningConfig:
        return _only(ThinningConfig, options)

    def run(self, voxels: DataFrame, config: ThinningConfig) -> tuple[DataFrame, DataFrame | None]:
        return thinned(voxels, config), None


register_backend(GrowthBackend())
register_backend(ThinningBackend())
