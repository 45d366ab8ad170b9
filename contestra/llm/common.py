"""What several operators share: staging tables, text helpers and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one is set here for a driver that
    is its own only executor (tests); on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints/contestra"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing lazy reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of rows that Spark hands to Python at once, unless the session has a bound of its own. Spark's
    bound on their number lets a few long texts fill a worker's memory."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_merge(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join. Spark takes the size of a side from the shuffle or file it comes from, so rows that
    are exploded or well compressed may be sent to the driver by the million."""
    return df.hint("merge")


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges of one task."""
    up: dict[int, int] = {}
    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            for x in (u, v):
                up.setdefault(x, x)
            while up[u] != u:
                up[u] = u = up[up[u]]
            while up[v] != v:
                up[v] = v = up[up[v]]
            up[max(u, v)] = min(u, v)
    out = []
    for x in up:
        r = x
        while up[r] != r:
            r = up[r]
        up[x] = r
        out.append((x, r))
    yield pd.DataFrame(out, columns=["node", "root"], dtype="int64")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 100_000) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node of its component.

    Alternates large-star and small-star steps, so no node's neighbours are ever gathered in one place: a hub
    costs one aggregated minimum and rows of an ordinary join. Each round is staged. Null ends, loops and repeated
    edges are ignored. An empty table gives an empty one. At most one_task edges of whole numbers are joined in one
    task instead, since each round costs the driver several plans and broadcasts.
    """
    e = staged(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    if e.schema["u"].dataType.typeName() == "long" and e.count() <= one_task:
        return e.coalesce(1).mapInPandas(_roots, "node long, root long")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        nxt = staged(small, "edges")
        unstage(e)
        e = nxt
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components have not settled")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
