"""Helpers shared by the training-data operators: the shared folder, cutting lineage, ordering, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges of a graph that are kept in one file.
EDGES_IN_A_FILE = 500_000
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new local one where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        jvm_dir = spark.sparkContext.getCheckpointDir()
        if jvm_dir is None and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = jvm_dir or "file://" + tempfile.mkdtemp(prefix="specloom-")
        if jvm_dir is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs nothing upstream."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, as a written table: columns packed and compressed take about a third of a checkpoint's place."""
    path = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/specloom-{kind}-{uuid.uuid4().hex}"


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"_{name}"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def unit(*cols: Column | str) -> Column:
    """A repeatable number in [0, 1) drawn from the columns' hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star then small-star contraction over (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = (
        both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.union(low.select("a", F.col("low").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root), for every node that has an edge; root is the least node.

    ``edges`` has two columns of one orderable type. Alternating star contractions need about log(n) rounds, each
    of which shuffles the edges only; rounds end when a round changes nothing. Rounds over few edges are kept in
    few files.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now, mark = settled(now), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = settled(_stars(now.coalesce(1 + seen[0] // EDGES_IN_A_FILE)).coalesce(1 + 2 * seen[0] // EDGES_IN_A_FILE))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
