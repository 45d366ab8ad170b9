"""Reusable relational operators: latest rows, guarded matches, windows over histories, merges and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order, which should end in a unique column."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def unique_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, value: str, out: str) -> DataFrame:
    """left with `out`: the value of right if exactly one distinct value has the key, else null."""
    found = right.groupBy(right_key.alias("__key")).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(out))
    return left.join(found.where("__n = 1"), left_key == F.col("__key"), "left").drop("__key", "__n")


def nearest_date_join(left: DataFrame, right: DataFrame, keys: list[str], date: str, offsets: tuple[int, ...] = (0, -1, 1, -2, 2)) -> DataFrame:
    """left with the row of right of equal keys at the first of the day offsets that has one (smallest r_seq on ties).

    right carries keys, `date` and `r_seq`. Candidate days are exploded on the left, so the join stays an equi-join.
    """
    days = F.explode(F.array(*[F.struct(F.lit(i).alias("__p"), F.date_add(F.col(date), o).alias("__d")) for i, o in enumerate(offsets)]))
    cand = left.withColumn("__x", days).select(*left.columns, "__x.*")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(date).alias("r_date"), "r_seq")
    hit = cand.join(r, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__r_{k}") for k in keys], F.col("__d") == F.col("r_date")), "left")
    return latest_per_key(hit, ["seq"], [F.col("r_seq").isNull().asc(), F.col("__p").asc(), F.col("r_seq").asc()]).select(*left.columns, "r_date", "r_seq")


def running_before(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with sums over a key's rows strictly before each row (0 where there are none)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({k: F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()})


def decayed_last(df: DataFrame, key: str, order: list[Column], value: Column, k: int, rate: float, out: str) -> DataFrame:
    """(key, out): mean of a key's last k values with weights 1 / (1 + rate * age), age 0 the latest."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.select(key, value.alias("__v"), rn.alias("__rn")).where(F.col("__rn") <= k).withColumn("__w", 1 / (1 + rate * (F.col("__rn") - 1)))
    return rows.groupBy(key).agg((F.sum(F.col("__v") * F.col("__w")) / F.sum("__w")).alias(out))


def change_events(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Rows whose column differs from the key's row before, with `previous`."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(column).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(column)))


def current_stint(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """A key's last contiguous run of one value of column."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("__new", F.coalesce((F.lag(column).over(w) != F.col(column)).cast("int"), F.lit(0)))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("__run").over(Window.partitionBy(key))
    return rows.withColumn("__last", last).where("__run = __last").drop("__new", "__run", "__last")


def validate(df: DataFrame, rules: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, violations(rule, key)); a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = df.withColumn("__broken", broken)
    bad = marked.where(F.size("__broken") > 0).select(F.explode("__broken").alias("rule"), F.col(key).alias("key"))
    return marked.where(F.size("__broken") == 0).drop("__broken"), bad


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """target with source's rows put in; columns named in preserve keep the old value where the new one is null."""
    t, s = target.alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])

    def pick(c: str) -> Column:
        new, old = F.col(f"s.{c}"), F.col(f"t.{c}")
        return (F.coalesce(new, old) if c in preserve or c in keys else F.when(F.col("s.__s"), new).otherwise(old)).alias(c)

    return t.join(s, on, "full").select(*[pick(c) for c in target.columns])


def append_once(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target and those incoming rows whose keys it lacks; existing rows never change."""
    return target.unionByName(incoming.join(target.select(*keys), keys, "left_anti"))


def scd2_apply(history: DataFrame, changes: DataFrame, key: str, value: str, as_of: str) -> DataFrame:
    """history(key, value, started_at, ended_at, is_current) after changes(key, value): differing current rows are closed
    as of that day and, unless the new value is null, a new current row starts."""
    c = changes.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    day = F.lit(as_of).cast("date")
    rows = history.join(c, F.col(key) == F.col("__k"), "left")
    close = F.col("is_current") & F.col("__k").isNotNull() & ~F.col(value).eqNullSafe(F.col("__v"))
    old = rows.select(key, value, "started_at", F.when(close, F.coalesce("ended_at", day)).otherwise(F.col("ended_at")).alias("ended_at"), (F.col("is_current") & ~close).alias("is_current"))
    now = history.where("is_current").select(F.col(key).alias("__h"), F.col(value).alias("__o"))
    fresh = c.join(now, F.col("__k") == F.col("__h"), "left").where(F.col("__v").isNotNull() & ~F.col("__v").eqNullSafe(F.col("__o")))
    new = fresh.select(F.col("__k").alias(key), F.col("__v").alias(value), day.alias("started_at"), F.lit(None).cast("date").alias("ended_at"), F.lit(True).alias("is_current"))
    return old.unionByName(new)


def greatest_or_null(a: Column, b: Column) -> Column:
    """The larger of two, null if either is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(a, b))
