import math

import numpy as np
import pytest

import contestra.plans.derived as derived
from contestra.functions import scalars as S
from contestra.operators.rating import best_match, fit_slope, shortest_paths
from contestra.streaming.results import complete, current_state, keep_results
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("text, want", [("Łukasz  Żó-ł", "ukasz zo"), ("  José O'Neil!", "jose o neil"), ("", ""), (None, None), ("武", "")])
def test_names(spark, text, want):
    assert one(spark, S.normalize_name(F.lit(text).cast("string"))) == want


def test_parsers_take_anything(spark):
    for text in ("12 of 30", "x", "", None, "99999999999999999999 of 1"):
        landed, attempted = S.parse_pair(F.lit(text).cast("string"))
        assert (one(spark, landed), one(spark, attempted)) == {"12 of 30": (12, 30), "99999999999999999999 of 1": (0, 1)}.get(text, (0, 0))
    assert [one(spark, S.parse_clock(F.lit(t).cast("string"))) for t in ("4:05", "4:5", None)] == [245, 0, 0]
    assert [str(one(spark, S.parse_day(F.lit(t).cast("string")))) for t in ("03/02/2020", "2020-02-03", "Feb", None)] == ["2020-02-03", "2020-02-03", "None", "None"]
    assert [one(spark, S.is_probability(F.lit(p).cast("double"))) for p in (0.0, 1.0, 1.1, None, float("nan"))] == [True, True, False, False, False]
    assert one(spark, S.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_fitted_slope_against_grid(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-0.7 * x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    grid = np.linspace(0, 2, 20_001)
    loss = [np.logaddexp(0, -s * x).dot(y) + np.logaddexp(0, s * x).dot(1 - y) for s in grid]
    assert math.isclose(fit_slope(df, "x", "y"), grid[int(np.argmin(loss))], abs_tol=2e-4)
    assert fit_slope(df.limit(0), "x", "y") == 0 == fit_slope(df.withColumn("y", F.lit(0.0)).where("x > 0"), "x", "y")


def test_paths_survive_cycles_and_stop(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (1, 9), (9, 3)], "entity_id long, opponent_id long")
    assert {r.node: r.path for r in shortest_paths(e, 1, 3).collect()} == {1: "1", 2: "1>2", 9: "1>9", 3: "1>2>3", 4: "1>2>3>4"}
    assert [r.path for r in shortest_paths(e.limit(0), 7, 2).collect()] == ["7"]


def test_best_match_needs_margin(spark):
    p = spark.createDataFrame([(1, 1, 12), (1, 2, 5), (2, 1, 9), (2, 2, 8), (3, 1, 6), (4, 4, 7)], "l int, r int, s int")
    assert sorted((r.l, r.r) for r in best_match(p, "l", "r", F.col("s"), 7, 3).collect()) == [(1, 1), (4, 4)]


def test_incomplete_results_wait(spark):
    rows = spark.createDataFrame([(1, "a", "KO"), (1, "a", "KO"), (2, "a", "KO"), (2, "b", "KO"), (3, "a", None)], "k int, w string, m string")
    assert [tuple(r) for r in complete(rows, "k", ["w", "m"]).collect()] == [(1, "a", "KO")]


def test_streamed_results_keep_only_changes(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k int, w string, m string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep_results(spark.readStream.schema(schema).parquet(src), out, "k", ["w", "m"]).awaitTermination()
        state = current_state(spark, f"{out}/changes", spark.createDataFrame([], schema).schema, "k")
        return {r.k: (r.w, r.m) for r in state.collect()}, spark.read.parquet(f"{out}/changes").count()

    assert feed([(1, "a", "KO"), (2, "b", None)]) == ({1: ("a", "KO")}, 1)
    assert feed([(1, "a", "KO"), (2, "b", "PTS")]) == ({1: ("a", "KO"), 2: ("b", "PTS")}, 2)
    assert feed([(1, "b", "DQ")]) == ({1: ("b", "DQ"), 2: ("b", "PTS")}, 3)


def test_antisymmetry(spark):
    got = derived.features(spark, SF).agg(F.max(F.abs("rate_diff")), F.count_if(F.col("strength") < 0)).first()
    assert got[0] <= 1 and got[1] == 0
    assert spark.createDataFrame([(1500.0, 1600.0)], "a double, b double").select((S.elo_expected(F.col("a"), F.col("b")) + S.elo_expected(F.col("b"), F.col("a"))).alias("s")).first().s == pytest.approx(1)


def test_queries_without_sql_run(spark):
    from contestra.plans.catalog import QUERIES

    assert 0 <= QUERIES["x09_fitted_slope"](spark, SF).first().slope <= 20
    assert QUERIES["m07_elo_weighted_skill"](spark, SF).where("skill not between 5 and 99").count() == 0
