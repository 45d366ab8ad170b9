"""Results that arrive in micro-batches: keyed state, changed rows audited, reruns of a batch without effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def changed_rows(state: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """incoming rows that are new or differ from state in a field, with `old_<field>`; keys not incoming are no change."""
    old = state.select(F.col(key).alias("__k"), *[F.col(f).alias(f"old_{f}") for f in fields])
    differs = F.col("__k").isNull()
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"old_{f}"))
    return incoming.join(old, F.col(key) == F.col("__k"), "left").where(differs).select(key, *fields, *[f"old_{f}" for f in fields])


def complete(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key whose rows agree in every field and leave none null; other keys wait."""
    agree = rows.groupBy(key).agg(*[F.min(f).alias(f) for f in fields], *[F.max(f).alias(f"__x_{f}") for f in fields], *[F.count_if(F.col(f).isNull()).alias(f"__n_{f}") for f in fields])
    for f in fields:
        agree = agree.where((F.col(f) == F.col(f"__x_{f}")) & (F.col(f"__n_{f}") == 0))
    return agree.select(key, *fields)


def keep_results(stream: DataFrame, folder: str, key: str, fields: list[str]) -> StreamingQuery:
    """Starts a query that appends, per micro-batch, the confirmed changes below folder/changes.

    The log of changes is the state: a batch replaces its own partition only, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    schema = StructType([stream.schema[key], *[stream.schema[f] for f in fields]])

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/changes"
        state = current_state(spark, path, schema, key, before=batch_id)
        new = changed_rows(state, complete(batch, key, fields), key, fields).drop(*[f"old_{f}" for f in fields])
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def current_state(spark: SparkSession, path: str, schema: StructType, key: str, before: int | None = None) -> DataFrame:
    """The last change of each key, of batches below `before` if given; no rows before the first batch."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)
    log = log if before is None else log.where(F.col("batch") < before)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))
    return log.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "batch")


def membership_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): `added` or `removed` between two states, for use on each batch against the state.

    Repeated rows count once and null keys are equal to each other.
    """
    b, a = (df.select(keys).distinct() for df in (before, after))
    return a.exceptAll(b).withColumn("change", F.lit("added")).unionByName(b.exceptAll(a).withColumn("change", F.lit("removed")))
