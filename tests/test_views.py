import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestra.operators import fitting, global_rating, identity, text_events
from contestra.plans import views

SF = "/root/testdata/sf0.01"


def contests(n=300, people=12, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.sample(range(people), 2)
        out.append((i, datetime.date(2000, 1, 1) + datetime.timedelta(days=i // 3), "xy"[i % 2], a, b, r.choice([1.0, 0.0, 1.0, 0.0, 0.5]), r.random() < 0.4))
    return out


CONTESTS = "seq long, event_date date, division string, a_id long, b_id long, won_a double, finish boolean"


def plain_measures(rows, who):
    """Measures and the state of one entity from whole lists."""
    elo, met, res, beaten, ended, foes, bouts = {}, [], [], [], 0.0, set(), 0
    for _, _, _, a, b, won, fin in rows:
        ra, rb = elo.get(a, 1500.0), elo.get(b, 1500.0)
        p = 1 / (1 + 10 ** ((rb - ra) / 400))
        for me, foe, foe_elo, y, q in ((a, b, rb, won, p), (b, a, ra, 1 - won, 1 - p)):
            if me == who:
                bouts += 1
                foes.add(foe)
                met.append(foe_elo)
                if won != 0.5:
                    res.append(y - q)
                if y == 1:
                    beaten.append(foe_elo)
                    ended += fin / (1 + math.exp(-(foe_elo - 1500) / 240))
        if won != 0.5:
            step = 28 * (1.12 if fin else 1) * (won - p)
            elo[a], elo[b] = ra + step, rb - step
    top = sorted(beaten)[-5:]

    def faded(v, d, e):
        w = [1 / (1 + d * i) for i in range(len(v))]
        return sum(x * y for x, y in zip(reversed(v), w, strict=True)) / sum(w) if v else e

    resume = sum(top) / len(top) + min(80, 18 * math.log1p(len(beaten))) if top else 1425.0
    return bouts, len(foes), elo.get(who, 1500.0), resume, faded(met[-10:], 0.12, 1450.0), faded(res[-8:], 0.32, 0.0), ended / (max(1, len(beaten)) + 1.5)


def test_global_rating_against_plain_lists(spark):
    rows = contests()
    df = spark.createDataFrame(rows, CONTESTS)
    history = global_rating.career_history(df)
    for r in global_rating.current_measures(history).collect():
        got = (r.bouts, r.opponents, r.skill, r.resume, r.schedule, r.form, r.finish)
        assert np.allclose(got, plain_measures(rows, r.entity_id), atol=1e-9)
    for r in history.where("seq in (0, 77, 299)").collect():
        assert np.allclose((r.skill, r.resume, r.schedule, r.form, r.finish), plain_measures(rows[: r.seq], r.entity_id)[2:], atol=1e-9)
    out = global_rating.rated(global_rating.current_measures(history), global_rating.weight_shares(np.array([0.1, 0.2, 0.3, 0.2, 0.2]))).collect()
    assert sorted(r.global_rank for r in out) == list(range(1, 13)) and all(5 <= r.rating <= 97 for r in out)
    d = global_rating.mirrored_differences(history)
    assert abs(d.agg(F.sum("d_skill")).first()[0]) < 1e-6 and d.count() == 2 * sum(r[5] != 0.5 for r in rows)
    with pytest.raises(ValueError):
        global_rating.fit_weights(d, "2000-02-01")


def test_global_rating_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, 1, 2, None, None), (2, None, None, 1, 2, 1.0, None)], CONTESTS)
    assert global_rating.career_history(df).count() == 2
    assert global_rating.current_measures(global_rating.career_history(df.limit(0))).count() == 0


def test_positive_fit_and_shares():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 5)) * [200, 80, 60, 0.2, 0.1]
    y = (r.random(3000) < 1 / (1 + np.exp(-x[:, 0] / 100))).astype(float)
    beta = global_rating.positive_fit(x, y)
    shares = global_rating.weight_shares(beta)
    assert (beta >= 0).all() and beta[0] == beta.max() and abs(sum(shares.values()) - 1) < 1e-9
    low = global_rating.weight_shares(np.array([0.1, 0.3, 0.3, 0.2, 0.1]))
    assert low["skill"] == 0.45 and abs(sum(low.values()) - 1) < 1e-9


def test_momentum_fit_finds_the_slope():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 2)) * [3, 10]
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 * x[:, 0] - 0.1 * x[:, 1])))).astype(float)
    b, scales = fitting.momentum_fit(np.vstack([x, -x]), np.concatenate([y, 1 - y]), 1e-4)
    assert np.allclose(b / scales, [0.5, -0.1], atol=0.05)
    assert fitting.choose([3.0, 1.0, 2.0], lambda v: (abs(v - 1.5), v)) == 1.0


def test_bootstrap_against_plain_draws(spark):
    r = random.Random(4)
    rows = [(f"2020-01-{d + 1:02d}", r.random(), r.random(), float(r.random() < 0.5)) for d in range(20) for _ in range(d % 4 + 1)]
    got = fitting.paired_bootstrap(spark.createDataFrame(rows, "d string, p double, q double, y double"), "d", "p", "q", "y", draws=200)
    days, seed, out = sorted({x[0] for x in rows}), 123456789, []
    for _ in range(200):
        s = n = 0
        for _ in days:
            seed = (1664525 * seed + 1013904223) % 2**32
            for _, p, q, y in (x for x in rows if x[0] == days[int(seed / 2**32 * len(days))]):
                s, n = s + (p - y) ** 2 - (q - y) ** 2, n + 1
        out.append(s / n)
    out.sort()
    assert np.allclose(got, (out[5], out[194]))
    with pytest.raises(ValueError):
        fitting.paired_bootstrap(spark.createDataFrame([], "d string, p double, q double, y double"), "d", "p", "q", "y")


def test_gate_fallback_recovery(spark):
    v = spark.range(1)
    new, old = ({k: F.lit(x) for k, x in zip(("brier", "log_loss", "accuracy"), t, strict=True)} for t in ((0.2, 0.6, 0.60), (0.21, 0.61, 0.604)))
    p = fitting.rated_or_elo(F.lit(None).cast("double"), F.lit(1600.0), F.lit(1500.0))
    row = v.select(fitting.promoted(new, old).alias("g"), fitting.promoted(old, new).alias("h"), *p, fitting.recovered(F.lit(0.5), F.lit(0.5 + 1e-13)).alias("r"), fitting.recovered(F.lit(0.5), F.lit(None).cast("double")).alias("s")).first()
    assert (row.g, row.h, row.method, row.r, row.s) == (True, False, "elo", "available", "unavailable") and 0.5 < row.probability < 0.7


def test_mentions_take_any_text_and_order(spark):
    names = spark.createDataFrame([(1, "Ana Ruiz"), (2, "ana  RUÍZ"), (3, "Bo Li"), (4, "Madonna"), (5, "Juan da Silva"), (6, None)], "id long, n string")
    texts = spark.createDataFrame([(1, "Today: ANA-RUIZ, Juan da Silva; Bo Li"), (2, ""), (3, None), (4, "Banana Ruiz"), (1, "Ana Ruiz")], "k long, t string")
    got = sorted((r.k, r.name, r.name_ids, r.ambiguous) for r in text_events.mentions(texts, names, "k", "t", "id", "n").collect())
    assert got == [(1, "ana ruiz", [1, 2], True), (1, "juan da silva", [5], False)]


def test_queue_and_signals(spark):
    queue = spark.createDataFrame([("a", "pending", True), ("b", "pending", False), ("c", "pending", None)], "key string, status string, reviewed boolean")
    found = spark.createDataFrame([("a", "needs_identity"), ("b", "needs_identity"), ("d", "pending")], "key string, status string")
    assert sorted(map(tuple, text_events.reconcile(queue, found).collect())) == [("a", "pending", True), ("b", "needs_identity", False), ("c", "superseded", False), ("d", "pending", False)]
    assert spark.range(1).select(text_events.has_signal(F.lit(None).cast("string"), text_events.INJURY).alias("v")).first().v is False


def test_links_and_collisions(spark):
    left = spark.createDataFrame([(1, "a", "2000"), (2, "a", None), (3, "b", "1999"), (4, "", "1"), (5, None, "1")], "l long, n string, d string")
    right = spark.createDataFrame([(10, "a", "2000"), (20, "b", "1999"), (21, "b", "1998"), (30, "", "1")], "r long, n string, d string")
    links = identity.link_by_name(left, right, "l", "r", "n", "d")
    assert sorted(map(tuple, links.collect())) == [(1, 10, "name_birth", 0.995), (2, 10, "unique_name", 0.95), (3, 20, "birth_tiebreak", 0.98)]
    assert [r.l for r in identity.without_collisions(links, "l", "r").collect()] == [3]
    alone = identity.scored_once(links, "r", [F.desc("confidence")]).collect()
    assert sorted((r.r, r.l, r.alone) for r in alone) == [(10, 1, False), (20, 3, True)]


def test_mentions_of_names_with_equal_first_words_meet_only_their_own(spark):
    names = spark.createDataFrame([(i, f"client no {i}") for i in range(300)], "id long, n string")
    texts = spark.createDataFrame([(i, f"Client no {i} and client no {i + 1}, client") for i in range(300)], "k long, t string")
    found = text_events.mentions(texts, names, "k", "t", "id", "n")
    assert sorted((r.k, r.name_ids) for r in found.collect()) == sorted((i, [j]) for i in range(300) for j in (i, i + 1) if j < 300)
    assert "__two" not in found._jdf.queryExecution().analyzed().toString()
    assert text_events.mentions(texts, names.limit(0), "k", "t", "id", "n").count() == 0


def test_sole_best_against_all_pairs(spark):
    r = random.Random(8)
    amounts = [None, float("nan"), float("inf"), 1e300, 100.1, 300.1, 600.1, -399.9, 0.1, 0.3, 1e16, 1e16 + 500]
    side = lambda n: [(r.randrange(n) if r.random() < 0.3 else n + i, r.choice([0, 1, 2, -1, None]), r.choice([1, 2, 3, None]), r.choice(amounts) if r.random() < 0.5 else round(r.uniform(-1500, 1500), 1)) for i in range(n)]
    left, right = side(60), [(i, *x[1:]) for i, x in enumerate(side(50))]
    got = identity.sole_best(spark.createDataFrame(left, "l long, b int, p int, v double"), spark.createDataFrame(right, "r long, b int, p int, v double"), "l", "r", "b", "p", "v", 200.0, 500.0)
    assert got._jdf.queryExecution().analyzed().toString().count("CoGroup") == 1
    want = []
    for key in {x[0] for x in left}:
        scores = []
        for _, b, p, v in (x for x in left if x[0] == key):
            for i, c, q, w in right:
                if b is not None and b == c:
                    gap = abs(v - w) if v is not None and w is not None else float("nan")
                    scores.append((3 * (p is not None and p == q) + (2 if gap <= 200 else 1 if gap <= 500 else 0), i))
        top = [i for s, i in scores if s == max(scores)[0]]
        want += [(key, top[0], max(scores)[0])] if len(top) == 1 else []
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_ratings_alone_are_folded_together(spark):
    df = spark.createDataFrame(contests(), CONTESTS)
    plan = global_rating.career_history(df)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2
    split = df.withColumn("part", F.col("seq") % 2)
    parts = global_rating.career_history(split, "part").where("seq % 2 = 1")
    alone = global_rating.career_history(df.where("seq % 2 = 1"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, alone.collect()))
    assert global_rating.mirrored_differences(alone)._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 2


def test_weights_are_fitted_on_all_rows(spark):
    noise = [F.randn(seed=i) for i in range(6)]
    d = spark.range(0, 240_000, numPartitions=8).select(
        F.expr("date'2000-01-01' + if(id < 210000, int(id % 2), 9)").alias("event_date"), F.col("id").alias("seq"), (noise[5] + noise[0] + noise[2] / 2 > 0).cast("double").alias("y"),
        *[(n * s).alias(f"d_{m}") for n, s, m in zip(noise, (200, 80, 60, 0.2, 0.1), global_rating.MEASURES, strict=False)],
    ).persist()
    for split, n in (("2000-01-02", 105_000), ("2000-01-03", 210_000)):
        rows = d.where(F.col("event_date") < split).toPandas()
        want = global_rating.weight_shares(global_rating.positive_fit(rows.iloc[:, 3:].to_numpy(float), rows["y"].to_numpy(float)))
        got = global_rating.fit_weights(d, split)
        assert len(rows) == n and got["schedule"] > 0 and all(abs(got[m] - want[m]) < 1e-9 for m in global_rating.MEASURES)
    d.unpersist()


def test_global_rating_is_the_same_where_rows_stay(spark, monkeypatch):
    want = {r.entity_id: r for r in views.r09(spark, SF).collect()}
    monkeypatch.setattr(global_rating, "ON_DRIVER", 0)
    got = views.r09(spark, SF).collect()
    assert len(got) == len(want) == 100
    for r in got:
        w = want[r.entity_id]
        assert abs(r.rating - w.rating) < 1e-9 and (r.global_rank, r.division_rank) == (w.global_rank, w.division_rank)
