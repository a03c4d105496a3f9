"""Voxel tables derived from the relational test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHAPE = 36
_CURVES = """
  SELECT p_partkey {div} 8 AS volume_id, p_partkey,
    CAST((p_partkey*7)%10  + (CASE WHEN p_partkey%3=0 THEN t ELSE (t*(p_partkey%5)) {div} 16 END) AS INT) AS i,
    CAST((p_partkey*13)%10 + (CASE WHEN p_partkey%3=1 THEN t ELSE (t*(p_partkey%7)) {div} 16 END) AS INT) AS j,
    CAST((p_partkey*29)%10 + (CASE WHEN p_partkey%3=2 THEN t ELSE (t*(p_partkey%4)) {div} 16 END) AS INT) AS k
  FROM {source}"""


def _curves(dialect: str) -> str:
    if dialect == "spark":
        return _CURVES.format(div="div", source="part LATERAL VIEW explode(sequence(0, 7+p_size%16)) x AS t")
    return _CURVES.format(div="//", source="part, LATERAL (SELECT unnest(generate_series(0, 7+p_size%16)) t)")


def skel_sql(dialect: str) -> str:
    return f"SELECT DISTINCT volume_id, i, j, k FROM ({_curves(dialect)}) c"


def pred_sql(dialect: str) -> str:
    return f"""SELECT DISTINCT volume_id, i,
      CAST(j + CASE WHEN p_partkey%3=0 THEN 1 WHEN p_partkey%7=0 THEN 3 ELSE 0 END AS INT) AS j, k
      FROM ({_curves(dialect)}) c WHERE p_partkey % 11 <> 0"""


def tube_sql(dialect: str) -> str:
    steps = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) <= 2)
    return f"""SELECT DISTINCT volume_id, CAST(i+di+1 AS INT) AS i, CAST(j+dj+1 AS INT) AS j, CAST(k+dk+1 AS INT) AS k
      FROM ({skel_sql(dialect)}) s CROSS JOIN (VALUES {steps}) AS o(di, dj, dk)"""


def fuzzy_sql(dialect: str) -> str:
    return f"SELECT volume_id, i, j, k, CAST(CAST((i*31 + j*17 + k*7 + volume_id) % 8 + 1 AS FLOAT) / 8 AS FLOAT) AS value FROM ({tube_sql(dialect)}) t"


SQL = {"skel": skel_sql, "pred": pred_sql, "tube": tube_sql, "fuzzy": fuzzy_sql}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(SQL[name]("spark"))
