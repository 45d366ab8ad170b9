"""Brown class-based bigram scoring.

Exchange clustering assigns the most frequent words to classes: words move, one after another, to the class that most
raises the likelihood of the class bigrams, until a sweep moves nothing or the sweeps are used up. Every other word that
is seen twice takes one exchange step, distributed, against those classes: from how often it follows each class it goes
to the class that makes this likeliest. Words seen once, and words never seen, belong to a class by their length. A
token's probability is P(its class | context of the token before) * P(token | its class); the context is the class of a
clustered word, and of another word its band of frequency (in the head vocabulary) or its length. Both are smoothed, and
a length's class keeps an absolute discount for words never seen. All counts cover every training text: word counts are
summed in Spark, pair counts per task in bounded matrices whose parts are merged in steps, and what concerns words
beyond the head vocabulary is joined, not broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, staged, unstage

END = b""  # no word is empty


@dataclass(frozen=True)
class Params:
    """clustered: words that exchange until they settle; head: words held by every worker, seen twice at least; the rest is joined."""

    clustered: int = 4096
    head: int = 131_072
    classes: int = 64
    sweeps: int = 4
    discount: float = 0.6
    prior: float = 5.0


BANDS, LENGTHS, BLOCK = 5, 4, 64
FIXED = BANDS + LENGTHS + 1
#: Words whose contexts one task assigns, and parts of a block that are merged at once.
WORD_BLOCK, MERGED = 4096, 64


def length_class(n: int) -> int:
    return min((n - 1) >> 2, LENGTHS - 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over texts(text); each text has one END, the empty word. Null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    seen.update(text.encode().lower().split())
                if len(seen) > 500_000:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen = Counter()
            seen[END] += len(pdf)
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    parts = texts.select("text").mapInPandas(run, "word binary, n long").where("n > 0")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


class Symbols(dict):
    """Word -> symbol; words outside fall to their length's symbol."""

    def __init__(self, words, symbols, first_length: int):
        super().__init__(zip(words, symbols, strict=True))
        self.lengths = [first_length + i for i in range(LENGTHS)]

    def __missing__(self, word: bytes) -> int:
        return self.lengths[length_class(len(word))]


def _stream(texts, symbols: Symbols, end: int) -> np.ndarray:
    out = [end]
    for text in texts:
        if text:
            out.extend(map(symbols.__getitem__, text.encode().lower().split()))
        out.append(end)
    return np.array(out, np.int64)


def merged(parts: DataFrame, size: int) -> DataFrame:
    """(block, at, n): the counts of parts(block, part, at, n) summed by block, a few parts at a time. size: of a block."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")
        at = np.nonzero(total)[0]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1] // MERGED, "at": [at.astype("<u4").tobytes()], "n": [total[at].astype("<i8").tobytes()]})

    most = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while most:
        parts = parts.groupBy("block", F.floor(F.col("part") / MERGED).alias("to")).applyInPandas(merge, "block long, part long, at binary, n binary")
        most //= MERGED
    return parts.select("block", "at", "n")


def blocks_of(total: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
    """Rows (block, part, at, n) of a task's flat counts, in blocks of so many."""
    part = TaskContext.get().partitionId()
    for b in range(0, len(total), size):
        at = np.nonzero(total[b : b + size])[0]
        if len(at):
            yield pd.DataFrame({"block": [b // size], "part": [part], "at": [at.astype("<u4").tobytes()], "n": [total[b + at].astype("<i8").tobytes()]})


def bigram_blocks(texts: DataFrame, words, p: Params) -> DataFrame:
    """(block, at binary, n binary): counts of symbol pairs over all texts, BLOCK first symbols a row."""
    size = p.clustered + FIXED
    rank = np.arange(len(words))
    table = spark_broadcast(texts.sparkSession, (list(words), np.where(rank < p.clustered, rank, p.clustered + bands(len(words), p)).tolist()))
    end = size - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, total = Symbols(*table.value, p.clustered + BANDS), np.zeros(size * size, np.int32)
        for pdf in batches:
            s = _stream(pdf["text"], symbols, end)
            at, n = np.unique(s[:-1] * size + s[1:], return_counts=True)
            total[at] += n.astype(np.int32)
        yield from blocks_of(total, BLOCK * size)

    parts = staged(texts.select("text").mapInPandas(run, "block long, part long, at binary, n binary"), "pairs")
    return merged(parts, BLOCK * size)


def bands(n: int, p: Params) -> np.ndarray:
    """Band of frequency of each of the n head words, most frequent first."""
    return np.minimum(np.log2(np.maximum(np.arange(n), p.clustered) / p.clustered).astype(int), BANDS - 1)


def word_contexts(texts: DataFrame, words: list, context: np.ndarray, p: Params) -> DataFrame:
    """What stands before words that aren't clustered: rows (block, part, at, n) for those of the head, at being
    word * groups + context, and rows (word, context, c) for those beyond. context: of the head words, lengths and END."""
    shared, groups, h = spark_broadcast(texts.sparkSession, (words, context)), p.classes + FIXED, len(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, context = shared.value
        symbols, seen = Symbols(head, range(h), h), Counter()
        total = np.zeros(max(0, h - p.clustered) * groups, np.int32)

        def tails() -> pd.DataFrame:
            return pd.DataFrame({"block": None, "part": None, "at": None, "n": None, "word": [w for w, _ in seen], "context": [k for _, k in seen], "c": list(seen.values())})

        for pdf in batches:
            plain = [t.encode().lower().split() if t else [] for t in pdf["text"]]
            at = np.array([h + LENGTHS, *(x for d in plain for x in (*map(symbols.__getitem__, d), h + LENGTHS))], np.int64)
            before, at = context[at[:-1]], at[1:]
            own = (at >= p.clustered) & (at < h)
            code, n = np.unique((at[own] - p.clustered) * groups + before[own], return_counts=True)
            total[code] += n.astype(np.int32)
            flat = [x for d in plain for x in (*d, END)]
            rare = np.nonzero((at >= h) & (at < h + LENGTHS))[0]
            seen.update(zip((flat[i] for i in rare.tolist()), before[rare].tolist(), strict=True))
            if len(seen) > 300_000:
                yield tails()
                seen.clear()
        if seen:
            yield tails()
        for rows in blocks_of(total, WORD_BLOCK * groups):
            yield rows.assign(word=None, context=None, c=None)

    return texts.select("text").mapInPandas(run, "block long, part long, at binary, n binary, word binary, context int, c long")


def spark_broadcast(spark: SparkSession, value):
    """Broadcast of a value whose size parameters bound."""
    return spark.sparkContext.broadcast(value)


def exchange(pairs: np.ndarray, clustered: int, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, counts of class pairs) for a square matrix of symbol pair counts.

    The first `clustered` symbols exchange between `classes` classes; each of the others has a class of its own.
    """
    size = len(pairs)
    groups = classes + size - clustered
    own = np.concatenate([np.arange(clustered) % classes, classes + np.arange(size - clustered)])
    used = np.nonzero(pairs[:clustered].sum(1) + pairs[:, :clustered].sum(0))[0]
    right = np.zeros((size, groups))  # of a word, what follows it by class
    left = np.zeros((size, groups))
    flipped = np.ascontiguousarray(pairs.T)
    for g in range(groups):
        members = own == g
        right[:, g] = pairs[:, members].sum(1)
        left[:, g] = flipped[:, members].sum(1)
    table = np.zeros((groups, groups))
    np.add.at(table, own, right)

    def xlogx(x):
        return x * np.log(np.maximum(x, 1.0))

    k = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in used:
            a, r, c, me = own[w], right[w].copy(), left[w].copy(), float(pairs[w, w])
            # Without w: pairs of w with itself are in r[a] and c[a] alike.
            r[a] -= me
            c[a] -= me
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= me
            out, into = table.sum(1)[:classes], table.sum(0)[:classes]
            rows, cols = table[:classes], table[:, :classes].T
            gain = (xlogx(rows + r) - xlogx(rows)).sum(1) + (xlogx(cols + c) - xlogx(cols)).sum(1)
            d = table[k, k]
            gain += xlogx(d + r[:classes] + c[:classes] + me) - xlogx(d + r[:classes]) - xlogx(d + c[:classes]) + xlogx(d)
            gain -= xlogx(out + r.sum() + me) - xlogx(out) + xlogx(into + c.sum() + me) - xlogx(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += me
            if b != a:
                own[w], moved = b, moved + 1
                for to, sign in ((a, -1), (b, 1)):
                    right[:, to] += sign * flipped[w]
                    left[:, to] += sign * pairs[w]
        if not moved:
            break
    return own, table


@dataclass
class Model:
    words: list  # the head, most frequent first
    context: np.ndarray  # context of each head word, then of the lengths and END
    index: np.ndarray  # class of the same
    emission: np.ndarray  # log10 P(word | class) of the same; 0 for lengths
    base: np.ndarray  # log10 of the smoothed unigram; 0 for lengths
    steps: np.ndarray  # log10 P(class | context)
    share: np.ndarray  # tokens of each class
    tail: list  # (tokens, words) seen once, by length
    tokens: int
    distinct: int


def preference(table: np.ndarray, classes: int) -> np.ndarray:
    """Contexts x classes: what one token in a context adds to the likelihood if its word joins the class."""
    part = table[:, :classes]
    return np.log(part + 0.5) - np.log(part.sum(0) + 0.5 * len(table))


def fit(texts: DataFrame, p: Params = Params()) -> tuple[Model, DataFrame]:
    """The model of texts(text) and (word, c, k), staged, of the words beyond its head: their count and class (null for
    words seen once). No text at all gives a model that scores 0. Of words of one count the first in the order of bytes
    come first; of equally good classes a word takes the lowest, unless it is in one of them already."""
    bounded_batches(texts.sparkSession)
    counts = staged(word_counts(texts), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    often = counts.where((F.col("c") > 1) & (F.octet_length("word") > 0)).withColumn("step", F.floor(F.log2("c") * 64))
    room, bar = p.head, 1 << 30  # the lowest step of frequency down to which all words fit
    for r in often.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            break
        bar = r["step"]
    head = often.where(F.col("step") >= bar).select("word", "c").toPandas()
    head["word"] = head["word"].map(bytes)
    head = head.sort_values(["c", "word"], ascending=[False, True])
    words, c = [bytes(w) for w in head["word"]], head["c"].to_numpy(dtype=np.int64)
    once = counts.where((F.octet_length("word") > 0) & (F.col("c") == 1))
    tail = [(0, 0) for _ in range(LENGTHS)]
    for r in once.groupBy(F.least(F.floor((F.octet_length("word") - 1) / 4), F.lit(LENGTHS - 1)).alias("k")).agg(F.count("*").alias("v")).collect():
        tail[r["k"]] = (r["v"], r["v"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        size = p.clustered + FIXED
        pairs = np.zeros(size * size, np.int32)
        for b, at, n in zip(pdf["block"], pdf["at"], pdf["n"], strict=True):
            pairs[np.frombuffer(at, "<u4").astype(np.int64) + b * BLOCK * size] = np.minimum(np.frombuffer(n, "<i8"), 2**31 - 1)
        own, table = exchange(pairs.reshape(size, size), p.clustered, p.classes, p.sweeps)
        return pd.DataFrame({"own": [own.astype("<i4").tobytes()], "pairs": [table.astype("<f8").tobytes()]})

    # At most (clustered + FIXED) / BLOCK rows meet in that one task, whatever the corpus.
    got = bigram_blocks(texts, words, p).groupBy().applyInPandas(cluster, "own binary, pairs binary").collect()
    groups, h = p.classes + FIXED, len(words)
    own = np.frombuffer(got[0]["own"], "<i4") if got else np.concatenate([np.arange(p.clustered) % p.classes, p.classes + np.arange(FIXED)])
    table = np.frombuffer(got[0]["pairs"], "<f8").reshape(groups, groups).copy() if got else np.zeros((groups, groups))
    rank, lengths = np.arange(h), p.classes + BANDS + np.arange(LENGTHS + 1)
    first = own[np.minimum(rank, p.clustered - 1)]
    context = np.concatenate([np.where(rank < p.clustered, first, p.classes + bands(h, p)), lengths]).astype(np.int64)
    around = staged(word_contexts(texts, words, context, p), "contexts")
    like = preference(table, p.classes)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(WORD_BLOCK * groups)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            found[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<i8")
        found = found.reshape(WORD_BLOCK, groups)
        k = (found @ like).argmax(1)
        moved = np.zeros((groups, p.classes))
        for to in range(p.classes):
            moved[:, to] = found[k == to].sum(0)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "k": [k.astype("<i4").tobytes()], "moved": [moved.astype("<f8").tobytes()]})

    near = merged(around.where("block is not null").select("block", "part", "at", "n"), WORD_BLOCK * groups)
    index = np.concatenate([first, lengths]).astype(np.int64)
    table[:, p.classes : p.classes + BANDS] = 0  # those words are in learned classes now
    for r in near.groupBy("block").applyInPandas(assign, "block long, k binary, moved binary").collect():  # head / WORD_BLOCK rows at most
        at = np.arange(p.clustered + r["block"] * WORD_BLOCK, min(h, p.clustered + (r["block"] + 1) * WORD_BLOCK))
        index[at] = np.frombuffer(r["k"], "<i4")[: len(at)]
        table[:, : p.classes] += np.frombuffer(r["moved"], "<f8").reshape(groups, p.classes)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moved = np.zeros(groups * p.classes, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["at"].map(len).to_numpy()
            row, k, n = np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["at"].to_list()).astype(np.int64), np.concatenate(pdf["n"].to_list()).astype(np.int64)
            best = np.add.reduceat(like[k] * n[:, None], np.cumsum(size) - size, axis=0).argmax(1)
            np.add.at(moved, k * p.classes + best[row], n)
            yield pd.DataFrame({"word": pdf["word"], "c": pdf["c"], "k": best, "code": None, "m": None})
        code = np.nonzero(moved)[0]
        yield pd.DataFrame({"word": None, "c": None, "k": None, "code": code, "m": moved[code]})

    # A word has a row for each context at most, so its list is bounded.
    rare = around.where("word is not null").groupBy("word", "context").agg(F.sum("c").alias("c"))
    rare = rare.groupBy("word").agg(F.sum("c").alias("c"), F.collect_list("context").alias("at"), F.collect_list("c").alias("n")).where("c > 1")
    chosen = staged(rare.mapInPandas(choose, "word binary, c long, k int, code long, m long"), "chosen")
    for r in chosen.where("code is not null").groupBy("code").agg(F.sum("m").alias("m")).collect():  # groups * classes rows at most
        table[r["code"] // p.classes, r["code"] % p.classes] += r["m"]
    rows = chosen.where("word is not null").select("word", "c", "k")
    by_length = F.least(F.floor((F.octet_length("word") - 1) / 4), F.lit(LENGTHS - 1))
    share = np.bincount(index[:h], weights=c, minlength=groups)
    for r in rows.groupBy("k").agg(F.sum("c").alias("c")).collect():
        share[r["k"]] += r["c"]
    for r in around.where("word is not null").groupBy("context", by_length.alias("l")).agg(F.sum("c").alias("c")).collect():
        table[r["context"], p.classes + BANDS + r["l"]] -= r["c"]  # all words beyond the head; those seen once come back
    single = around.where("word is not null").join(once.select("word"), "word").groupBy("context", by_length.alias("l")).agg(F.sum("c").alias("c"))
    for r in single.collect():
        table[r["context"], p.classes + BANDS + r["l"]] += r["c"]
    z = tokens + 0.1 * (distinct + 1)
    emission = np.concatenate([np.log10(c / np.maximum(share[index[:h]], 1)), np.zeros(LENGTHS + 1)])
    base = np.concatenate([np.log10((c + 0.1) / z), np.zeros(LENGTHS), [math.log10((ends + 0.1) / z)]])
    seen = table.sum(0)
    unigram = (seen + 0.1) / (seen.sum() + 0.1 * groups)
    steps = np.log10((table + p.prior * unigram) / (table.sum(1, keepdims=True) + p.prior))
    beyond = staged(rows.unionByName(once.select("word", "c", F.lit(None).cast("int").alias("k"))), "beyond")
    unstage(around, chosen, counts)
    return Model(words, context, index, emission, base, steps, share, tail, int(tokens), int(distinct)), beyond


def score(docs: DataFrame, model: Model, beyond: DataFrame, p: Params = Params()) -> DataFrame:
    """docs(doc_id, text, held_out) -> a row each with n_tokens, n_known, base_score and score.

    Null texts are empty: they have the end alone. Repeated rows get a row each; null doc_ids stay null. An empty table
    gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    shared = spark_broadcast(docs.sparkSession, model)
    empty = model.tokens == 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        h = len(m.words)
        symbols = Symbols(m.words, range(h), h)
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            texts, docs_, tails = pdf["text"], [], ([], [], [], [])
            for text in texts:
                words = text.encode().lower().split() if text else []
                at = np.array([h + LENGTHS, *map(symbols.__getitem__, words), h + LENGTHS], np.int64)
                before, at = m.context[at[:-1]], at[1:]
                lone = (at >= h) & (at < h + LENGTHS)
                rare = np.nonzero(lone)[0]
                for (w, k), n in Counter(zip([words[i] for i in rare.tolist()], before[rare].tolist(), strict=True)).items():
                    tails[0].append(row)
                    tails[1].append(w)
                    tails[2].append(n)
                    tails[3].append(k)
                own = 0.0 if empty else m.steps[before, m.index[at]][~lone].sum() + m.emission[at].sum()
                docs_.append((row, len(words) + 1, len(words) + (not empty) - len(rare), m.base[at].sum(), own))
                row += 1
            r, t, k, b, s = map(list, zip(*docs_, strict=True)) if docs_ else ([], [], [], [], [])
            yield pd.DataFrame({"row": r, "doc_id": pdf["doc_id"].array, "held_out": pdf["held_out"].array, "t": t, "k": k, "b": b, "s": s, "word": None, "n": None, "context": None})
            for i in range(0, len(tails[0]), 100_000):
                cut = slice(i, i + 100_000)
                yield pd.DataFrame({"row": tails[0][cut], "doc_id": None, "held_out": None, "t": None, "k": None, "b": None, "s": None, "word": tails[1][cut], "n": tails[2][cut], "context": tails[3][cut]})

    schema = "row long, doc_id long, held_out boolean, t long, k long, b double, s double, word binary, n long, context int"
    rows = staged(docs.select("doc_id", "text", "held_out").mapInPandas(run, schema), "scores")
    z = model.tokens + 0.1 * (model.distinct + 1)
    groups, first = len(model.steps), len(model.steps) - LENGTHS - 1
    # A row for each context and class: a fixed number.
    steps = docs.sparkSession.createDataFrame(
        pd.DataFrame({"code": np.arange(groups * groups), "step": model.steps.ravel(), "share": np.tile(np.maximum(model.share, 1.0), groups)}), "code long, step double, share double"
    )
    c = F.coalesce("c", F.lit(0))
    kind = F.least(F.floor((F.octet_length("word") - 1) / 4), F.lit(LENGTHS - 1)).cast("int")
    total = F.element_at(F.array(*[F.lit(float(t + 1)) for t, _ in model.tail]), kind + 1)
    unseen = F.element_at(F.array(*[F.lit(p.discount * v + 1) for _, v in model.tail]), kind + 1)
    alone = F.log10(F.when(c > 0, c - p.discount).otherwise(unseen) / total)
    # Words beyond the head are at most a 1/head share of the tokens each, so no key of this join is hot.
    tails = rows.where("word is not null").select("row", "word", "n", "context").join(beyond, "word", "left")
    tails = tails.withColumn("code", F.col("context") * groups + F.coalesce(F.col("k"), first + kind)).join(F.broadcast(steps), "code")
    lone = F.lit(0.0) if empty else F.col("step") + F.when(F.col("k").isNull(), alone).otherwise(F.log10(F.col("c") / F.col("share")))
    tails = tails.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("t"), F.when(c > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.log10((c + 0.1) / F.lit(z))).alias("b"), (F.col("n") * lone).alias("s"))
    every = rows.where("word is null").select("row", "doc_id", "held_out", "t", "k", "b", "s").unionByName(tails)
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("t").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves 0 modulo 10."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    model, beyond = fit(docs.where("not held_out").select("text"))
    return score(docs, model, beyond)
