import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contestra.llm import ann, brown, graph_dedup, line_dedup, mixing, packing, sharding, simhash, tool_calls, toxicity

DOCS = "doc_id long, text string, source string"


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_banded_distance_equals_plain_one():
    r = random.Random(3)
    make = lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
    for most in (1, 2, 3):
        a, b = [make() for _ in range(800)], [make() for _ in range(800)]
        assert line_dedup.within_edits(a, b, most).tolist() == [edits(x, y) <= most for x, y in zip(a, b)]


def test_lines_join_and_edge_cases(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    docs = [(1, base + "\nshort\n\n" + base, "a"), (2, base.replace("quick", "quack") + "\nshort", "a"), (3, None, "a"), (4, "", "a"), (5, base[2:] + "!!", "a"), (5, base[2:] + "!!", "a")]
    out = line_dedup.line_classes(spark.createDataFrame(docs, DOCS)).collect()
    kept = sorted((r.doc_id, r.line_no) for r in out if r.kept)
    assert kept == [(1, 0), (1, 1), (5, 0), (5, 0)]
    assert {r.class_doc_id for r in out if r.doc_id == 2} == {1}
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert 2 not in left and left[3] is None and left[4] == "" and left[1] == base + "\nshort\n"
    assert line_dedup.line_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_any_length_equal_brute_force(spark):
    r, lines = random.Random(6), set()
    for _ in range(60):
        base = "".join(r.choice("abcd é") for _ in range(r.randint(1, 40)))
        for _ in range(4):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(x) + 1)
                x[k : k + r.randint(0, 1)] = r.choice(["", "x", "y"])
            lines.add("".join(x))
    lines = sorted(lines | {"", "a", "ab"})
    got = {(x.u, x.v) for x in line_dedup.edit_links(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    reach = lambda a, b: min(2, min(len(a), len(b)) // 8)
    assert got == {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if reach(lines[i], lines[j]) and edits(lines[i], lines[j]) <= reach(lines[i], lines[j])} and len(got) > 50


def test_common_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", 3)
    lines = [f"page {i:03d} of the manual" for i in range(60)] + [f"{i} bottles on the wall, {i} bottles" for i in range(30)]
    got = {(x.u, x.v) for x in line_dedup.edit_links(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if edits(lines[i], lines[j]) <= 2}


def test_lines_of_one_long_text_and_clashing_names(spark):
    text = "\n".join(["same line here"] * 5000 + ["x" * 50_000, "x" * 49_999, " \t"])
    df = spark.createDataFrame([(1, text, "s"), (None, "same line here", None)], DOCS).withColumn("class", F.lit("clash"))
    out = line_dedup.line_classes(df).collect()
    assert len(out) == 5003 and sum(x.kept for x in out) == 2 and {x.n_links for x in out if x.line_no >= 5000} == {1}


def test_crowded_keys_lose_no_link(spark):
    lines = [f"page {i:03d} of the long manual for this machine" for i in range(120)]
    got = {(r.u, r.v) for r in line_dedup.edit_links(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if edits(lines[i], lines[j]) <= 2}


@pytest.mark.parametrize("hot", [0, 1024])
def test_simhash_links_equal_brute_force(spark, hot):
    r = random.Random(1)
    centre = [r.getrandbits(63) for _ in range(5)]
    prints = list({c ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 4))) for c in centre for _ in range(40)})
    got = simhash.connected_components(simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {x.node: x.root for x in got.collect()} == {p: find(p) for p in prints if any(q != p and (p ^ q).bit_count() <= 2 for q in prints)}


def test_simhash_edges(spark):
    out = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "One two", "a"), (4, "one  two", "b"), (None, "one two", "b")], DOCS)).collect()}
    assert out[1].component_id == out[2].component_id == 1 and out[3].component_id == out[4].component_id == out[None].component_id == 3
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def plain_longest_first(sizes, shards):
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_longest_first_equals_the_plain_loop(seed):
    r = random.Random(seed)
    sizes = [(size, r.choice([1, 2, 7, 100, 1000])) for size in r.sample(range(1, 400), r.randint(1, 30))]
    dealt, loads = sharding.longest_first(sizes, 5), [0] * 5
    for size, n in sizes:
        assert sum(dealt[size]) == n
        loads = [x + size * k for x, k in zip(loads, dealt[size])]
    assert loads == plain_longest_first([size for size, n in sizes for _ in range(n)], 5)


def test_shards_keep_groups_and_slots(spark):
    docs = [(i, f"text {i % 40}" * (i % 7 + 1) if i % 9 else None, "s") for i in range(400)]
    df = spark.createDataFrame(docs, DOCS).withColumn("shard", F.lit("clash"))
    out = sharding.shard_by_group(df, F.col("text"), F.length("text"), 6, [F.col("doc_id")]).toPandas()
    assert len(out) == 400 and (out.groupby("text")["shard"].nunique() == 1).all() and out.loc[out["text"].isna(), "shard"].nunique() == 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    groups = out.assign(n=out["text"].fillna("").str.len(), t=out["text"].fillna("\0")).groupby("t")["n"].sum()
    loads = out.assign(n=out["text"].fillna("").str.len()).groupby("shard")["n"].sum().reindex(range(6), fill_value=0)
    assert loads.tolist() == plain_longest_first(groups.tolist(), 6)
    assert sharding.shard_by_group(df.limit(0), F.col("text"), F.length("text"), 6, [F.col("doc_id")]).count() == 0


def test_shards_of_many_equal_sizes(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")).alias("text"), F.when(F.col("id") % 3000 < 2000, 10).otherwise(7).alias("n"), F.lit("x").alias("slot"))
    out = sharding.shard_by_group(df, F.col("text"), F.col("n"), 7, [F.col("doc_id")]).toPandas()
    assert (out.groupby("text")["shard"].nunique() == 1).all() and all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sorted(out.groupby("shard")["n"].sum()) == sorted(plain_longest_first(out.groupby("text")["n"].sum().tolist(), 7))


def test_mix_comes_near_targets(spark):
    docs = [(i, "w " * (i % 30 + 1), [None, "a", "b"][i % 3]) for i in range(600)] + [(1000, None, "a")]
    df = spark.createDataFrame(docs, DOCS)
    one, two = (mixing.mix_sources(df, F.array("source"), F.size(F.split(F.trim("text"), " ")), [1, 2, 3]).toPandas() for _ in range(2))
    assert one.sort_values("doc_id")["taken"].tolist() == two.sort_values("doc_id")["taken"].tolist()
    assert (one["taken"] <= 3 * one["size"]).all()
    for _, g in one.groupby(one["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    assert mixing.mix_sources(df.limit(0), F.array("source"), F.lit(1), [1]).count() == 0


def test_one_change_closes_the_gap_like_trying_all(spark):
    r, rows, best, sides = random.Random(3), [], {}, {}
    for p in range(150):
        gap, others, taken = r.choice([-1, 1, 1]) * r.randint(1, 60), {r.randint(1, 90) for _ in range(r.randint(0, 8))}, {r.randint(1, 90) for _ in range(r.randint(0, 8))}
        rows += [(str(p), gap, False, x) for x in others] + [(str(p), gap, True, x) for x in taken]
        best[str(p)] = min(abs(gap - a + d) for a in [0, *others] for d in [0, *taken])
        sides[str(p)] = gap, others, taken
    got = {x["__p"]: x for x in mixing.best_changes(spark.createDataFrame(rows, "__p string, __gap long, __in boolean, size long")).collect()}
    for p, (gap, others, taken) in sides.items():
        if p in got:
            assert got[p].add in others | {0} and got[p].drop in taken | {0} and abs(gap - got[p].add + got[p].drop) == best[p]
        else:
            assert best[p] == abs(gap) or not others | taken


def test_mix_of_overlapping_sources_against_plain_sums(spark):
    sources = [["a"], ["b"], ["a", "b"], ["b", "c", "b"], [None], []]
    docs = [(i, i % 17 + (i % 5 == 0) * 40, sources[i % 6]) for i in range(900)] + [(2000, None, ["a"]), (None, 5, ["c"]), (None, 5, ["c"])]
    df = spark.createDataFrame(docs, "doc_id long, n int, of array<string>").withColumn("target", F.lit("clash"))
    out = mixing.mix_sources(df, F.col("of"), F.col("n"), [1, 2, 3]).toPandas()
    assert len(out) == 903 and (out["taken"] == out["copies"] * out["size"]).all() and out["copies"].between(0, 3).all()
    assert (out.loc[out["of"].map(len) == 0, "copies"] == 0).all() and (out.loc[out["size"] == 0, "copies"] == 0).all()
    size = {}
    for _, n, of in docs:
        for s in set(of):
            size[s] = size.get(s, 0) + (n or 0)
    want = mixing.capped_targets(size, dict(zip(["a", "b", "c", None], [1, 2, 3, 1])), 3)
    for _, row in out.iterrows():
        of = set(row["of"])
        assert row["source_size"] == sum(size[s] for s in of) and abs(row["target"] - sum(want[s] for s in of)) < 1e-6
    grand = sum(n or 0 for _, n, of in docs if of)
    assert abs(out["taken"].sum() - grand) <= 0.01 * grand


def test_flow_shares_overlapping_patterns():
    flow = mixing.min_cost_flow({"ab": 100, "b": 50}, {"ab": ["a", "b"], "b": ["b"]}, {"a": 120, "b": 60}, 3)
    assert flow["ab", "a"] == 120 and flow.get(("ab", "b"), 0) + flow["b", "b"] == 60


def test_packing_respects_every_limit():
    r = np.random.default_rng(2)
    want = np.stack([r.integers(1, 100, 500), np.ones(500, int), r.integers(0, 60, 500)], 1)
    at = packing.dot_product_bins(want, np.array([100, 4, 120]))
    for b in np.unique(at):
        assert (want[at == b].sum(0) <= [100, 4, 120]).all()
    assert want[:, 0].sum() / (100 * len(np.unique(at))) > 0.9


def test_pieces_hold_every_id_once(spark):
    texts = [None, "", "Hello, WORLD!\t it's 3 o'clock", "naïve ｆｏｏ é " * 900, "<|endoftext|> x"]
    out = packing.packed_documents(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), 512).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        p = out[out["doc_id"] == i].sort_values("start")
        assert p["length"].sum() == len(ids) and all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(p["start"], p["length"], p["ids_crc32"]))


def plain_counts(texts):
    from collections import Counter

    c = Counter()
    for t in texts:
        c.update((t or "").encode().lower().split())
        c[b""] += 1
    return c


def test_brown_scores_a_proper_model(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["a b", "c d", "e f g", f"rare{r.randrange(60)} x", f"once{i}x{j}"]) for j in range(30)) if i else None, "s") for i in range(60)]
    docs += [(None, "A b  never\u00a0seen b", "s"), (99, "", None), (99, "", None)]
    docs = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("clash"))
    docs = docs.select("doc_id", "text", "row", brown.held_out(F.col("doc_id")).alias("held_out"))
    p = brown.Params(clustered=4, classes=3, head=8)
    model, beyond = brown.fit(docs.where("not held_out").select("text"), p)
    out = brown.score(docs, model, beyond, p).toPandas()
    assert len(out) == 63 and (out[out["doc_id"] > 0]["score"] > out[out["doc_id"] > 0]["base_score"]).mean() > 0.8
    assert np.allclose((10**model.steps).sum(1), 1)
    # The words of a class share its probability; a length's class keeps some for words never seen.
    rows = beyond.toPandas()
    mass = np.zeros(len(model.steps))
    h = len(model.words)
    np.add.at(mass, model.index[: h], 10 ** model.emission[: h])
    assert h == 8 and rows["k"].notna().sum() > 10 and rows["k"].isna().sum() > 10
    for c, k in zip(rows["c"], rows["k"]):
        if k == k:
            mass[int(k)] += c / model.share[int(k)]
    assert np.allclose(mass[:3][model.share[:3] > 0], 1)
    # Base scores and known tokens against plain counting.
    got = docs.collect()
    train = plain_counts(x.text for x in got if not x.held_out)
    n, v = sum(train.values()), len(train)
    want = []
    for x in got:
        t = (x.text or "").encode().lower().split() + [b""]
        want.append((len(t), sum(w in train for w in t), sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    have = sorted(zip(out["n_tokens"], out["n_known"], out["base_score"]))
    assert np.allclose(have, sorted(want)) and (out["train_tokens"] == n).all()
    model, beyond = brown.fit(docs.limit(0).select("text"), p)
    assert (brown.score(docs, model, beyond, p).toPandas()["score"] == 0).all() and brown.score(docs.limit(0), model, beyond, p).count() == 0


def test_words_prefer_the_class_that_follows_their_contexts():
    table = np.array([[90.0, 1, 0, 0], [2, 40, 0, 0], [5, 5, 0, 0], [0, 0, 0, 0]])
    like = brown.preference(table, 2)
    assert like.shape == (4, 2) and (like[0].argmax(), like[1].argmax()) == (0, 1)
    assert np.allclose(np.exp(like).sum(0), 1)  # of a class, over contexts


def test_toxicity_gradients_and_learning():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    r, words = np.random.default_rng(0), [b"ab", b"cde", b"x", b"hello"]
    at, mask, y = r.integers(0, 4, (4, 6)), np.ones((4, 6)), np.array([1, 0, 1, 0.0])
    mask[1, 3:] = 0
    _, g = toxicity.gradients(p, words, at, mask, y)
    for k in ("wf", "ub", "wa", "va", "wo", "cb"):
        i = tuple(r.integers(0, s) for s in p[k].shape)
        ends = []
        for e in (1e-4, -1e-4):
            p[k][i] += e
            ends.append(toxicity.gradients(p, words, at, mask, y)[0])
            p[k][i] -= e
        assert abs((ends[0] - ends[1]) / 2e-4 - g[k][i]) < 1e-5
    assert toxicity.windows_of(0) == 1 and toxicity.windows_of(49) == 2


def test_nearest_recall_and_ties(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[1] = x[0]
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, 10).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -1e9
        hits += len(set(out[out["query_id"] == q]["vec_id"]) & set(np.lexsort((np.arange(3000), -s))[:10]))
    assert hits / 300 >= 0.9 and len(out) == 300


def test_graph_links_equal_brute_force(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((300, 16))
    x = np.vstack([x, x[:60] + 0.05 * r.standard_normal((60, 16)), x[:5]]).astype(np.float32)
    label = [int(i % 3) for i in range(len(x))]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label))] + [(900, None, 1), (901, x[0].tolist(), None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = graph_dedup.near_vectors(table, per_shard=40)
    got = {q.vec_id: q for q in out.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [sum(u[i] @ u[j] >= 0.93 and label[i] == label[j] and i != j for j in range(len(x))) for i in range(len(x))]
    assert sum(got[i].n_links for i in range(len(x))) >= 0.95 * sum(want) and all(got[i].n_links <= want[i] for i in range(len(x)))
    assert got[900].n_links == got[901].n_links == 0 and got[901].component_id == 901 and graph_dedup.audit_recall(table, out) > 0.9


def test_nearest_ties_few_and_repeated(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (4, [9.0, 0.0]), (5, [-1.0, 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = ann.nearest(df, F.col("vec_id") == 1, 20).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in out] == [(2, 0.5), (3, 0.5), (4, 0.5), (5, -1.0)]
    assert [x.vec_id for x in ann.nearest(df, F.col("vec_id") == 1, 2).orderBy("rank").collect()] == [2, 3]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0


def test_probing_finds_what_comparing_finds():
    r = np.random.default_rng(5)
    words = r.integers(0, 1 << 63, (2000, 4)).astype(np.uint64)
    words[1:600] = words[0] ^ (np.uint64(1) << r.integers(0, 63, (599, 4)).astype(np.uint64))
    index = ann.MultiIndex(words)
    for radius in (0, 3, 7, 20, 31, 60, 110):
        assert index.probe(words[5], radius).tolist() == np.nonzero(ann.distances(words[5:6], words)[0] <= radius)[0].tolist()
    assert index.probing_pays(20) and not index.probing_pays(110)


def test_levels_equal_longest_paths(spark):
    r = random.Random(8)
    rows, needs = [], {}
    for i in range(120):
        needs[i] = sorted({r.randrange(i) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}) if i else []
    needs |= {200: [201], 201: [202], 202: [200], 203: [200], 204: [203, 1], 205: [999], 300: [299]} | {300 + k: [299 + k] for k in range(1, 90)}
    rows = [(1, 0, str(k), "t", "{}", [str(n) for n in v] + [None]) for k, v in needs.items()]
    level = {}

    def depth(k):
        if k not in level:
            level[k] = None  # being looked at: a cycle
            below = [depth(n) for n in needs[k] if n in needs]
            level[k] = None if None in below else 1 + max(below, default=-1)
        return level[k]

    got = {int(x.call_id): x.level for x in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")).collect()}
    want = {k: depth(k) for k in needs}
    assert got == {k: want[k] for k in needs if any(n in needs for n in needs[k])}


def test_tool_calls_of_nothing_and_nulls(spark):
    calls = spark.createDataFrame([(None, None, None, None, None, None), (1, None, "a", "f", '{"n": 7, "s": ""}', ["a"])], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>").withColumn("level", F.lit("clash"))
    results = spark.createDataFrame([(1, None, "a", None), (None, 1, None, "x")], "conv_id long, turn long, call_id string, content string")
    out = {x.call_id: x for x in tool_calls.link_tool_calls(calls, results, {"f": {"n": ("integer", True, 0, 6), "s": ("string", False, 1, 9)}}).collect() if x.status != "orphan"}
    assert out["a"].status == "linked" and out["a"].level is None and out["a"].violations == "n: not within 0 and 6; s: not within 1 and 9"
    assert out[None].status == "unanswered" and out[None].violations == "unknown tool"
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_tool_call_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", "x" * 351), (1, 3, "user", "again"), (1, 4, "assistant", None), (1, 9, "assistant", "lone"), (2, 8, "user", ""), (2, None, "user", "q"), (3, 1, "user", None), (3, 1, "user", None)]
    rows += [(4, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(41)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(tool_calls.OP1_SQL).fetchdf()
    got = tool_calls.op1_tool_calls(spark, str(tmp_path)).toPandas()[list(want.columns)]
    norm = lambda df: sorted(tuple("~" if pd.isna(x) else str(int(x)) if isinstance(x, (float, np.floating)) else str(x) for x in row) for row in df.astype(object).itertuples(index=False))
    assert norm(got) == norm(want) and got["level"].max() == 20


def test_tool_calls(spark):
    schema = {"add": {"x": ("integer", True), "note": ("string", False)}}
    calls = [(1, 0, "a", "add", '{"x": 1}', []), (1, 1, "b", "add", '{"x": "1", "y": 2}', ["a"]), (1, 2, "c", "add", "no", ["d"]), (1, 3, "d", "mul", "{}", ["c"]), (1, 0, "a", "add", '{"x": 1}', [])]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame([(1, 5, "a", "one"), (1, 4, "a", "first"), (1, 6, "z", None)], "conv_id long, turn long, call_id string, content string")
    out = {x.call_id: x for x in tool_calls.link_tool_calls(c, r, schema).collect()}
    assert out["a"].status == "linked" and out["a"].result_turn == 4 and out["a"].n_results == 2 and out["a"].valid
    assert out["b"].level == 1 and out["b"].violations == "x: not integer; y: unexpected" and out["z"].status == "orphan"
    assert out["c"].level is None and out["c"].violations == "arguments: not an object" and out["d"].violations == "unknown tool"
    assert out["a"].json == '{"arguments":{"x":1},"conversation":1,"id":"a","name":"add","result":"first","turn":0}'
    assert sorted(x.position for x in out.values()) == [0, 1, 2, 3, 4]


def test_simhash_joins_broadcast_no_exploded_rows(spark):
    r = random.Random(5)
    prints = list({r.getrandbits(63) ^ (1 << r.randrange(63)) for _ in range(300)})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in [*prints, *(p ^ 1 for p in prints)]], "fp long").distinct())
    links.collect()
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(6)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(None, 1), (7, 7), (400, 401), (401, 400)], "u long, v long")
    one, rounds = (sorted(map(tuple, simhash.connected_components(edges, one_task=n).collect())) for n in (1000, 0))
    assert one == rounds and (401, 400) in one
    assert simhash.connected_components(edges.limit(0)).count() == 0
