"""Shared pieces: table access, the shared folder for cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a session that names none (tests, a laptop) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="statloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and columns can be pruned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    done_with = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(done_with, "false")
    spark.conf.set(done_with, "true")  # the job's shuffle files go when the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(done_with, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> Iterator[None]:
    """Python workers get so many rows and bytes (or one row) at once meanwhile, as each row holds a whole text."""
    names = {f"spark.sql.execution.arrow.{n}": str(v) for n, v in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size))}
    usual = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in usual.items():
            spark.conf.set(n, v)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b of one orderable type): rows (node, component), the smallest node reached.

    Alternating large-star and small-star steps: each moves whole neighbourhoods to their smallest member, so
    the rounds grow with the logarithm of the longest path. Every round is an aggregation with map-side combine
    and an equi-join (skewed nodes are split by AQE); its edges are written to the shared folder, never to the driver.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = state(edges)
    for _ in range(max_rounds):
        if not last[0]:
            break
        two = both(edges)
        low = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        before, edges = edges, written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        discard(before)
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    member = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
