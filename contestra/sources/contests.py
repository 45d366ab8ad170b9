"""The two-sided contest model over order lines.

A side is what one supplier delivers in one order. An order's two sides with the smallest supplier keys meet as a and b
on the order's date, in the division of its priority; the larger price sum wins, and the win is a finish if the loser
has a returned line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASURES = ("qty", "price", "lines", "ret")

CONTESTS_SQL = """
sides as (select l_orderkey as k, l_suppkey as s, sum(l_quantity) as qty, sum(l_extendedprice) as price, count(*) as lines,
  sum(case when l_returnflag = 'R' then 1 else 0 end) as ret from lineitem group by 1, 2),
ranked as (select *, row_number() over (partition by k order by s) as rn from sides),
contests as (select o_orderkey as seq, cast(o_orderdate as date) as event_date, o_orderpriority as division, a.s as a_id, b.s as b_id,
  a.qty as a_qty, a.price as a_price, a.lines as a_lines, a.ret as a_ret, b.qty as b_qty, b.price as b_price, b.lines as b_lines, b.ret as b_ret,
  case when a.price > b.price then 1.0 when a.price < b.price then 0.0 else 0.5 end as won_a,
  a.price <> b.price and (case when a.price > b.price then b.ret else a.ret end) > 0 as finish
  from orders join ranked a on a.k = o_orderkey and a.rn = 1 join ranked b on b.k = o_orderkey and b.rn = 2),
obs as (select seq, event_date, division, 'a' as side, a_id as entity_id, b_id as opponent_id, won_a as won, finish, a_qty as qty, a_lines as lines, a_ret as ret,
  b_qty as opp_qty, b_lines as opp_lines, b_ret as opp_ret from contests
  union all select seq, event_date, division, 'b', b_id, a_id, 1 - won_a, finish, b_qty, b_lines, b_ret, a_qty, a_lines, a_ret from contests)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    sides = lines.groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("ret")
    )
    ranked = sides.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("s"))).where("rn <= 2")
    side = F.struct("s", *MEASURES)
    # An order has few suppliers; both sides come out of one grouping, without a self-join.
    both = ranked.groupBy("k").agg(F.max(F.when(F.col("rn") == 1, side)).alias("a"), F.max(F.when(F.col("rn") == 2, side)).alias("b")).where("b is not null")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_orderpriority").alias("division"))
    rows = orders.join(both, F.col("o_orderkey") == F.col("k"))
    decided = F.col("a.price") != F.col("b.price")
    loser = F.when(F.col("a.price") > F.col("b.price"), F.col("b.ret")).otherwise(F.col("a.ret"))
    return rows.select(
        F.col("o_orderkey").alias("seq"), "event_date", "division", F.col("a.s").alias("a_id"), F.col("b.s").alias("b_id"),
        *[F.col(f"{x}.{m}").alias(f"{x}_{m}") for x in "ab" for m in MEASURES],
        F.when(F.col("a.price") > F.col("b.price"), 1.0).when(F.col("a.price") < F.col("b.price"), 0.0).otherwise(0.5).alias("won_a"),
        (decided & (loser > 0)).alias("finish"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest and side, with the opponent's measures."""

    def side(x: str, o: str):
        won = F.col("won_a") if x == "a" else 1 - F.col("won_a")
        own = [F.col(f"{x}_{m}").alias(m) for m in ("qty", "lines", "ret")] + [F.col(f"{o}_{m}").alias(f"opp_{m}") for m in ("qty", "lines", "ret")]
        return F.struct(F.lit(x).alias("side"), F.col(f"{x}_id").alias("entity_id"), F.col(f"{o}_id").alias("opponent_id"), won.alias("won"), *own)

    rows = contests(spark, sf_dir)
    return rows.select("seq", "event_date", "division", "finish", F.inline(F.array(side("a", "b"), side("b", "a")))).select(
        "seq", "event_date", "division", "side", "entity_id", "opponent_id", "won", "finish", "qty", "lines", "ret", "opp_qty", "opp_lines", "opp_ret"
    )
