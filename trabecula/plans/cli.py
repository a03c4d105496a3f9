"""Command line: run, evaluate, graphgen, graphviz."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators.evaluate import report_text
from . import api
from .registry import list_backends


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="trabecula", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="skeletons of volumes")
    run.add_argument("-i", "--input", required=True, help="a volume, or a folder of volumes")
    run.add_argument("-o", "--output", required=True, help="the skeleton's file, or a folder")
    run.add_argument("--algorithm", choices=list_backends(), required=True)
    run.add_argument("--root-method", choices=("max_fdt", "topmost"))
    run.add_argument("--threshold-scale", type=float)
    run.add_argument("--dilation-factor", type=float)
    run.add_argument("--max-iterations", type=int)
    run.add_argument("--min-object-size", type=int)
    run.add_argument("--label-objects", action="store_true")
    run.add_argument("--binarize-threshold", dest="threshold", type=float)
    run.add_argument("--verbose", action="store_true")
    ev = sub.add_parser("evaluate", help="scores of predicted skeletons")
    ev.add_argument("--pred", required=True)
    ev.add_argument("--ref", required=True)
    ev.add_argument("-b", "--buffer-radius", type=float, required=True)
    ev.add_argument("--buffer-radius-unit", choices=("voxels", "um"), default="voxels")
    ev.add_argument("--json-output")
    ev.add_argument("-v", "--verbose", action="store_true")
    gen = sub.add_parser("graphgen", help="graphs of skeletons")
    gen.add_argument("-i", "--input", required=True, help="a skeleton, or a folder of skeletons")
    gen.add_argument("-o", "--output", required=True, help="the graph's file, or a folder")
    gen.add_argument("--verbose", action="store_true")
    viz = sub.add_parser("graphviz", help="geometry of graphs")
    viz.add_argument("-i", "--input", required=True)
    viz.add_argument("--edge_thickness", type=float, default=2.0)
    viz.add_argument("--node_size", type=float, default=6.0)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = vars(build_parser().parse_args(argv))
    spark = SparkSession.builder.appName("trabecula").getOrCreate()
    command = args.pop("command")
    try:
        if command == "run":
            source, target, algorithm = args.pop("input"), args.pop("output"), args.pop("algorithm")
            verbose, done = args.pop("verbose"), api.skeletonise(spark, source, target, algorithm, **args)
            print("\n".join(done) if verbose else f"{len(done)} skeletons written to {target}")
        elif command == "evaluate":
            out = api.score(spark, args["pred"], args["ref"], args["buffer_radius"], args["buffer_radius_unit"])
            for r in report_text(out, args["verbose"]).toLocalIterator():
                print(f"{r.volume_id}\n{r.text}")
            if args["json_output"]:
                api.write_scores(out, args["buffer_radius"], args["buffer_radius_unit"], args["json_output"])
        elif command == "graphgen":
            done = api.graphs(spark, args["input"], args["output"])
            print("\n".join(done) if args["verbose"] else f"{len(done)} graphs written to {args['output']}")
        else:
            api.view(spark, args["input"], args["edge_thickness"], args["node_size"]).show(truncate=80)
    except (ValueError, KeyError) as problem:
        if command == "run":
            raise
        print(f"error: {problem}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
