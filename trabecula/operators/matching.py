"""Predictions matched to references by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file's name without folders and without .nii or .nii.gz."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.nii(\.gz)?$", "")


def family(name: Column) -> Column:
    """The leading part Lnet_i... up to a dot; empty if there is none."""
    return F.regexp_extract(name, r"^(Lnet_i[^.]+)", 1)


def _begun(names: DataFrame, name: str, by: DataFrame, other: str) -> DataFrame:
    """names with each beginning as long as some name of the other table: column head."""
    lengths = by.select(F.length(other).alias("size")).distinct()
    return names.join(F.broadcast(lengths), F.col("size") <= F.length(name)).withColumn("head", F.substring(name, F.lit(1), F.col("size"))).drop("size")


def match_references(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """pred(path), ref(path) -> pred_path, ref_path, problem, a row for each path. Equal stems first; else one stem begins the
    other, or the reference begins with the prediction's family. Exactly one match is taken; none or several are a problem.
    Repeated rows count as several.

    A family begins its own name, so what fits is what begins with the family (or, without one, the name), and what begins it.
    Both are counted by equi-joins on beginnings, never by pairs of names.
    """
    p = pred.groupBy(F.col("path").alias("pred_path")).agg(F.count("*").alias("times")).withColumn("p", stem(F.col("pred_path")))
    p = p.withColumn("q", F.when(family(F.col("p")) != "", family(F.col("p"))).when(F.col("p") != "", F.col("p")))
    r = ref.groupBy(stem(F.col("path")).alias("r")).agg(F.count("*").alias("n"), F.min("path").alias("any")).filter("r <> ''")
    q = p.filter("q is not null").select("q").distinct()
    behind = _begun(r, "r", q, "q").groupBy(F.col("head").alias("q")).agg(F.sum("n").alias("n"), F.min("any").alias("any")).join(q, "q", "left_semi")
    before = _begun(q, "q", r, "r").filter("head <> q").join(r, F.col("head") == F.col("r")).select("q", "n", "any")
    found = behind.unionByName(before).groupBy("q").agg(F.sum("n").alias("n"), F.min("any").alias("any"))
    own = r.select(F.col("r").alias("p"), F.col("n").alias("equal"), F.col("any").alias("own"))
    out = p.join(found, "q", "left").join(own, "p", "left").withColumn("equal", F.coalesce("equal", F.lit(0)) * F.col("times")).withColumn("n", F.col("n") * F.col("times"))
    one = F.when(F.col("equal") == 1, F.col("own")).when((F.col("equal") == 0) & (F.col("n") == 1), F.col("any"))
    problem = F.when(one.isNotNull(), None).when(F.col("n").isNull(), "no reference").otherwise("several references")
    return out.select("pred_path", one.alias("ref_path"), problem.alias("problem"))
