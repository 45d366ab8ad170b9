import random

import numpy as np
import pytest

import corpus_pipeline
from contestra.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "web", len(t or "")) for i, t in texts]


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def changed(r, w, n):
    out = list(w)
    for i in r.sample(range(len(w)), n):
        out[i] = "changed" + str(r.random())
    return out


def test_near_copy_stage_drops_planted_copies(spark):
    r = random.Random(4)
    base = [words(r, 200) for _ in range(20)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    texts += [(100 + i, " ".join(changed(r, w, 3))) for i, w in enumerate(base)]  # similarity over 0.8
    texts += [(200 + i, " ".join(changed(r, w, 30))) for i, w in enumerate(base)]  # far below
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows_of(texts), COLUMNS), "").collect()
    assert sorted(x.doc_id for x in out) == [*range(20), *range(200, 220)]


@pytest.mark.parametrize("listed, cell", [(1, 2), (1, 2048), (24, 2048)])
def test_near_copies_equal_brute_force(spark, listed, cell):
    r = random.Random(9)
    tail = words(r, 30)
    texts = []
    for _ in range(6):
        w = words(r, r.randint(5, 60))
        texts += [" ".join(changed(r, w, r.randint(0, 2)) + (tail if r.random() < 0.3 else [])) for _ in range(12)]
    texts += [None, "", "one", "One", "one two three four five six seven eight", "one two three four five six seven"]
    out = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), listed, cell)[1].collect()
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for x in out:
        groups.setdefault(x["__root"], []).append(x.doc_id)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(want.values())
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0


def test_near_copy_stage_decides_by_row(spark):
    r = random.Random(5)
    w = [words(r, 100) for _ in range(6)]
    near = " ".join(changed(r, w[3], 1))
    texts = [(None, " ".join(w[0])), (None, " ".join(w[1])), (7, " ".join(w[2])), (7, " ".join(w[3])), (3, near), (None, near), (9, " ".join(w[4])), (9, " ".join(w[4]))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows_of(texts), COLUMNS), "").collect()
    want = [(None, texts[0][1]), (None, texts[1][1]), (7, texts[2][1]), (3, near), (9, texts[6][1])]
    assert sorted(map(repr, [(x.doc_id, x.text) for x in out])) == sorted(map(repr, want))


def test_pairs_of_crowded_keys_cross_components_and_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60, dtype=np.uint64)
    sets = []
    for i in range(30):
        s = base.copy()
        s[rng.choice(60, i % 9, replace=False)] = rng.integers(0, 2**62, i % 9, dtype=np.uint64)
        sets.append(np.unique(s))
    root = [i % 4 for i in range(30)]
    hot = spark.createDataFrame([(7, i, len(s), root[i]) for i, s in enumerate(sets)], "key long, id long, n long, root long")
    sketches = spark.createDataFrame([(i, bytearray(near_copies.sketch(s))) for i, s in enumerate(sets)], "id long, sketch binary")
    whole = [np.frombuffer(near_copies.sketch(s), np.uint8).astype(int) for s in sets]
    want = {
        (i, j)
        for i in range(30)
        for j in range(i + 1, 30)
        if root[i] != root[j] and 9 * abs(whole[i] - whole[j]).sum() <= len(sets[i]) + len(sets[j]) and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
    }
    assert 0 < len(want) < 300
    for n in (1, 4):
        blocks = spark.createDataFrame([(7, n)], "key long, blocks long")
        got = [tuple(r) for r in near_copies.crossing(hot, blocks, sketches).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_verification_sends_a_set_once_for_its_block(spark, monkeypatch):
    r = random.Random(12)
    base = words(r, 100)
    texts = [" ".join(changed(r, base, 1)) for _ in range(20)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "__row string, text string")
    sig = near_copies.with_sets(rows)
    ids = sorted(x["__set"] for x in sig.collect())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "u long, v long")
    keep, sent = near_copies.staged, []

    def staged(df, name):
        out = keep(df, name)
        if name == "named":
            sent.append(sum(len(x.cells) for x in out.collect()))
        return out

    monkeypatch.setattr(near_copies, "staged", staged)
    for block in (64, 3):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert sorted(map(tuple, near_copies._verified(pairs, rows, sig, False).collect())) == sorted(map(tuple, pairs.collect()))
    assert sent[0] == 20 and sent[0] < sent[1] < 190  # of 190 pairs


def test_parities_bound_differences_of_any_sizes():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    for n in (0, 1, 3, 40, 700, 4000):
        for m in (n, n + 1, n * 9 // 8, n * 5 // 4):
            for shift in (0, n // 50, n // 10, n):
                a, b = np.unique(pool[:n]), np.unique(pool[shift : shift + m])
                seen, real = near_copies.apart(near_copies.parities(a), near_copies.parities(b)), len(np.setxor1d(a, b))
                assert seen <= real and (real - seen) % 2 == 0
                if n >= 700 and 7 * real >= 2 * (n + m):
                    assert 9 * seen > n + m


def test_verification_of_long_texts_sends_only_near_ones(spark, monkeypatch):
    r = random.Random(13)
    base = [words(r, 6000) for _ in range(3)]
    texts = [" ".join(w) for w in base] + [" ".join(changed(r, base[0], 20))]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "__row string, text string")
    sig = near_copies.with_sets(rows)
    of = {x["__row"]: x["__set"] for x in sig.collect()}
    ids = sorted(of.values())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "u long, v long")
    keep, sent = near_copies.staged, []

    def staged(df, name):
        out = keep(df, name)
        if name == "named":
            sent.extend(x.id for x in out.collect())
        return out

    monkeypatch.setattr(near_copies, "staged", staged)
    want = sorted([of["0"], of["3"]])
    assert [tuple(x) for x in near_copies._verified(pairs, rows, sig, False).collect()] == [tuple(want)]
    assert sorted(sent) == want  # sizes of parts allow all six pairs


def test_a_part_of_all_texts_shows_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 4)
    r = random.Random(14)
    phrase = words(r, 5)
    rows = spark.createDataFrame([(" ".join(words(r, 6) + (phrase if i % 4 == 0 else [])),) for i in range(1600)], "text string")
    found, n = near_copies.common_shingles(rows)
    assert near_copies.shingles(" ".join(phrase), {})[0] in found
    assert 10 <= n.max() < 60  # about 400 / 16 of them
