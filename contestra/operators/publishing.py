"""Publishing and upkeep: snapshots behind a pointer, reconciling deletes, current flags, matched loads, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def publish(df: DataFrame, folder: str, snapshot: str) -> None:
    """Writes df as a snapshot and then points readers to it.

    The pointer is an appended row with the next version, so that readers see the old or the new snapshot, never a part.
    One writer at a time.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/data/snapshot_id={snapshot}")
    last = _pointers(spark, folder).agg(F.max("version")).first()[0] or 0
    spark.createDataFrame([(last + 1, snapshot)], "version long, snapshot string").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointer")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema("version long, snapshot string").parquet(f"{folder}/pointer")
    return spark.createDataFrame([], "version long, snapshot string")


def active(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that the newest pointer names; ValueError if none was published."""
    name = _pointers(spark, folder).agg(F.max_by("snapshot", "version")).first()[0]
    if name is None:
        raise ValueError(f"nothing published in {folder}")
    return spark.read.parquet(f"{folder}/data/snapshot_id={name}")


def reconciling_delete(target: DataFrame, seen: DataFrame, children: DataFrame, key: str, source: str) -> DataFrame:
    """target without rows of a source that its run didn't see (K09). Sources without any seen row lose nothing, nor
    do rows that children(key) refer to."""
    ran = seen.select(F.col(source).alias("__ran")).distinct()
    gone = target.join(ran, F.col(source) == F.col("__ran"), "left_semi").join(seen.select(key, source), [key, source], "left_anti").join(children.select(key), key, "left_anti")
    return target.join(gone.select(key, source), [key, source], "left_anti")


def current_takeover(events: DataFrame, entity: str, current: str, order: list[Column]) -> DataFrame:
    """events in which only the first current one of an entity in `order` stays current."""
    w = Window.partitionBy(entity, F.coalesce(current, F.lit(False))).orderBy(*order)
    return events.withColumn("__r", F.row_number().over(w)).withColumn(current, F.coalesce(current, F.lit(False)) & (F.col("__r") == 1)).drop("__r")


def mark_and_sweep(state: DataFrame, seen: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, current): rows of sources that ran are current if seen, new ones are added, others stay."""
    ran = seen.select(source).distinct().withColumn("__ran", F.lit(True))
    now = seen.select(key, source).distinct().withColumn("__seen", F.lit(True))
    both = state.select(key, source, F.col("current").alias("__was")).join(now, [key, source], "full_outer").join(ran, source, "left")
    return both.select(key, source, F.when(F.col("__ran"), F.coalesce("__seen", F.lit(False))).otherwise(F.col("__was")).alias("current"))


def matched_load(rows: DataFrame, known: DataFrame, name: str, target: str) -> DataFrame:
    """rows with `target` and `outcome`: matched (one known row of the name), ambiguous (several) or unmatched."""
    k = known.groupBy(name).agg(F.count("*").alias("__n"), F.min(target).alias("__t"))
    out = rows.join(k, name, "left")
    return out.withColumns({target: F.when(F.col("__n") == 1, F.col("__t")), "outcome": F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "ambiguous").otherwise("unmatched")}).drop("__n", "__t")


def compare_and_set(target: DataFrame, updates: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(target after updates, conflicts) for target and updates(key, value, revision).

    An update holds only if it names the revision that target has; the row's revision then grows by one. Updates has one
    row a key.
    """
    u = updates.select(key, F.col(value).alias("__v"), F.col("revision").alias("__r"))
    both = target.join(u, key, "left")
    hit = F.col("__r").eqNullSafe(F.col("revision"))
    new = both.select(key, F.when(hit, F.col("__v")).otherwise(F.col(value)).alias(value), F.when(hit, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))
    conflicts = u.join(target.select(key, "revision"), key, "left").where(F.col("revision").isNull() | (F.col("revision") != F.col("__r"))).select(key, F.col("__v").alias(value), F.col("__r").alias("revision"))
    return new, conflicts
