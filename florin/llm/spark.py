"""Spark helpers of the text operators: materialising, comparison units, connected groups."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``; a temporary one only where that is unset, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "florin-checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what has been checkpointed; it waits for the driver's garbage collection, which a large heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own for this call, below the shared one."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialise``, for large results that are read column by column: as Parquet in the shared folder, which takes about half the space."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list ``(a, b)``; root is the smallest node.

    Alternating large-star and small-star rounds: every round is two grouped
    minima and two joins over the edges, and each result is checkpointed, so
    neither links nor groups ever meet in one task or on the driver. Skewed hubs are
    plain equi-joins against a table with one row per node, which adaptive
    execution splits. Null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    current = materialise(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(lowest, F.col("u") == F.col("n"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        joined = large.join(lowest, F.col("u") == F.col("n")).select("u", "v", "m")
        small = (
            joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lowest.select(F.col("n").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        current = materialise(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected groups did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def comparison_units(buckets: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """Deals the members of overlapping buckets into units of bounded weight, so that every two members
    of one bucket meet in exactly one unit.

    ``buckets`` is ``(bucket, node)``, each pair once, and ``weights`` is ``(node, weight)``. The home of a node is the lowest node
    that shares a bucket with it or with one that it shares a bucket with; true families mostly have one home. A home of more than ``limit`` is dealt to
    blocks by hash. A unit is a pair of blocks that occur in one bucket: a chain of members that
    share buckets only with their neighbours costs work in proportion to the chain, and
    a family that is larger than ``limit`` one unit per pair of its blocks. What is returned is
    ``(node, home_i, salt_i, home_j, salt_j, side, call)``: a unit is named by its two blocks, those of one block have side 0 alone, and
    units are packed into calls of about ``limit``.
    """
    lowest = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("bucket").alias("_bucket"), "low")
    shared = materialise(buckets.join(lowest, F.col("bucket") == F.col("_bucket")).select("bucket", "node", "low"))
    first = shared.groupBy("node").agg(F.min("low").alias("near")).select(F.col("node").alias("_near_node"), "near")
    by_bucket = shared.join(first, F.col("node") == F.col("_near_node")).groupBy("bucket").agg(F.min("near").alias("home")).select(F.col("bucket").alias("_home_bucket"), "home")
    homes = shared.join(by_bucket, F.col("bucket") == F.col("_home_bucket")).groupBy("node").agg(F.min("home").alias("home"))
    homes = homes.join(weights.select(F.col("node").alias("_node"), "weight"), F.col("node") == F.col("_node")).drop("_node")
    sizes = homes.groupBy("home").agg(F.sum("weight").alias("total")).select(F.col("home").alias("_home"), F.ceil(F.col("total") / limit).cast("int").alias("blocks"))
    salt = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    placed = materialise(homes.join(sizes, F.col("home") == F.col("_home")).select("node", "weight", F.struct("home", salt.alias("salt")).alias("block")))
    inside = shared.select("bucket", "node").join(placed.select(F.col("node").alias("_node"), "block"), F.col("node") == F.col("_node")).groupBy("bucket", "block").agg(F.count("*").alias("n"))
    left, right = (inside.select(F.col("bucket").alias(f"bucket_{x}"), F.col("block").alias(x), F.col("n").alias(f"n_{x}")) for x in "ij")
    units = left.join(right, F.col("bucket_i") == F.col("bucket_j")).where((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("n_i") > 1)))
    units = materialise(units.select("i", "j").distinct())
    ends = units.select(F.struct("i", "j").alias("unit"), F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block"))))).alias("end"))
    dealt = ends.select("unit", "end.side", F.col("end.block").alias("_block")).join(placed, F.col("_block") == F.col("block")).select("node", "weight", "unit", "side")
    dealt = materialise(dealt)
    total = dealt.agg(F.sum("weight")).first()[0] or 0
    named = (F.col(f"unit.{x}.{c}").alias(f"{c}_{x}") for x in "ij" for c in ("home", "salt"))
    return dealt.select("node", *named, "side", F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(max(1, int(total // limit)))).alias("call"))


def bucket_calls(buckets: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """Deals whole buckets into calls of about ``limit``: ``(node, call, buckets)``, a node once a call, with those of its buckets that meet there.

    Arguments are those of ``comparison_units``, but only nodes of one bucket meet, so that the rows never outnumber those of ``buckets``.
    The home of a bucket is the lowest node that shares a bucket with one of its nodes. Buckets of one home mostly have the same nodes and go to one
    call, unless the home weighs more than ``limit``. A single bucket of more than ``limit`` is cut by hash into parts, and every two of them meet as a bucket of their own.
    """
    lowest = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("bucket").alias("_bucket"), "low")
    shared = buckets.join(lowest, F.col("bucket") == F.col("_bucket")).select("bucket", "node", "low")
    shared = materialise(shared.join(weights.select(F.col("node").alias("_node"), "weight"), F.col("node") == F.col("_node")).drop("_node"))
    release_shuffles(buckets.sparkSession)
    first = shared.groupBy("node").agg(F.min("low").alias("near")).select(F.col("node").alias("_near_node"), "near")
    near = shared.join(first, F.col("node") == F.col("_near_node")).groupBy("bucket")
    homes = near.agg(F.min("near").alias("home"), F.ceil(2 * F.sum("weight") / limit).cast("int").alias("cuts")).select(F.col("bucket").alias("_bucket"), "home", "cuts")
    rows = shared.join(homes, F.col("bucket") == F.col("_bucket")).drop("_bucket", "low")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    cut = rows.where("cuts > 2").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cut = cut.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "weight").withColumn("place", F.col("bucket"))
    whole = rows.where("cuts <= 2")
    sizes = whole.select("home", "node", "weight").distinct().groupBy("home").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("parts")).select(F.col("home").alias("_home"), "parts")
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("bucket"), F.col("parts"))).otherwise(0)
    whole = whole.join(sizes, F.col("home") == F.col("_home")).select("bucket", "node", "weight", F.xxhash64("home", salt).alias("place"))
    dealt = materialise(whole.union(cut).groupBy("place", "node").agg(F.max("weight").alias("weight"), F.collect_list("bucket").alias("buckets")))
    release_shuffles(buckets.sparkSession)
    total = dealt.agg(F.sum("weight")).first()[0] or 0
    call = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(max(1, int(total // limit))))
    return dealt.groupBy("node", call.alias("call")).agg(F.flatten(F.collect_list("buckets")).alias("buckets"))


UNIT = ("home_i", "salt_i", "home_j", "salt_j")


def rows_by_unit(table: pa.Table) -> list[list[dict]]:
    """The rows of a call, unit by unit."""
    units: dict[tuple, list[dict]] = {}
    for row in table.to_pylist():
        units.setdefault(tuple(row[c] for c in UNIT), []).append(row)
    return list(units.values())
