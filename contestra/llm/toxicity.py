"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed embedding of itself beside the mean of hashed embeddings of its character trigrams. Both
directions run over windows of WIDTH words that overlap by WIDTH - STRIDE; attention pools a window's states and a
linear unit scores it. A text scores as its worst window, so every word of a text of any length is read. Only labels
teach: source, language and ids are no inputs. The network is fitted on a bounded sample of labelled texts
(SAMPLE_DOCS documents by hash); every window of these is scored to pick the worst and to set the cut, a few of each
document take gradient steps. Scoring covers everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table

WIDTH, STRIDE = 48, 32
WORDS, GRAMS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 13, 8, 8, 8
#: Most documents that teach.
SAMPLE_DOCS = 4000
LEVEL = 0.3
#: Words that are scored together.
CHUNK = 200_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of all trigrams, where each word's begin). A word of n bytes has n trigrams."""
    own = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    raw = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.uint32)
    gram = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
    gram = ((gram ^ (gram >> np.uint32(15))) % np.uint32(GRAMS)).astype(np.int64)[raw[1:-1] != 10]
    length = np.fromiter(map(len, words), np.int64, len(words))
    return own, gram, np.cumsum(length) - length


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = WORD_DIM + GRAM_DIM
    make = lambda *s, x=1.0: (r.standard_normal(s) * x).astype(np.float32)
    out = {"word": make(WORDS, WORD_DIM, x=0.02), "gram": make(GRAMS, GRAM_DIM, x=0.1), "wa": make(2 * HIDDEN, HIDDEN, x=0.3), "ba": np.zeros(HIDDEN, np.float32), "va": make(HIDDEN, x=0.3), "wo": make(2 * HIDDEN, x=0.3), "bo": np.full(1, -2, np.float32)}
    for k in "fb":
        out |= {f"w{k}": make(d, 3 * HIDDEN, x=0.3), f"u{k}": make(HIDDEN, 3 * HIDDEN, x=0.3), f"c{k}": np.zeros(3 * HIDDEN, np.float32)}
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def embed(p: dict, words: list[bytes]) -> tuple[np.ndarray, tuple]:
    own, gram, at = word_features(words)
    n = np.diff(np.append(at, len(gram)))[:, None].astype(np.float32)
    return np.hstack([p["word"][own], np.add.reduceat(p["gram"][gram], at) / n]), (own, gram, n)


def _run(gates, u, at, mask, keep):
    """States over time of one direction. gates: table of input gates by word; at, mask: windows x time."""
    h, b = HIDDEN, len(at)
    state, states, saved = np.zeros((b, h), np.float32), np.empty((at.shape[1], b, h), np.float32), []
    for t in range(at.shape[1]):
        x, y, m = gates[at[:, t]], state @ u, mask[:, t, None]
        zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
        new = n + z * (state - n)
        new = state + m * (new - state)
        if keep:
            saved.append((state, z, r, n, y[:, 2 * h :], m))
        states[t] = state = new
    return states, saved


def forward(p: dict, gates: dict, at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window: at, mask are windows x time."""
    f, sf = _run(gates["f"], p["uf"], at, mask, keep)
    b, sb = _run(gates["b"], p["ub"], at[:, ::-1], mask[:, ::-1], keep)
    states = np.concatenate([f, b[::-1]], 2)  # time x windows x 2h
    a = np.tanh(states @ p["wa"] + p["ba"])
    e = np.where(mask.T > 0, a @ p["va"], np.float32(-1e9))
    e = np.exp(e - e.max(0)) * mask.T
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = (alpha[:, :, None] * states).sum(0)
    return pooled @ p["wo"] + p["bo"][0], (states, a, alpha, pooled, sf, sb)


def _back(u, saved, grads, reverse):
    """Gradients of one direction: of u and, by time, of the input gates."""
    h, dstate, du, dx = HIDDEN, 0.0, np.zeros_like(u), [None] * len(saved)
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, n, yn, m = saved[t]
        d = dstate + grads[len(saved) - 1 - t if reverse else t]
        dn, dz = d * m * (1 - z) * (1 - n * n), d * m * (state - n) * z * (1 - z)
        dr = dn * yn * r * (1 - r)
        dx[t] = np.hstack([dz, dr, dn])
        dy = np.hstack([dz, dr, dn * r])
        du += state.T @ dy
        dstate = d * (1 - m) + d * m * z + dy @ u.T
    return du, dx


def gradients(p: dict, words: list[bytes], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of windows over the distinct words, and its gradients."""
    x, (own, gram, n) = embed(p, words)
    gates = {k: x @ p[f"w{k}"] + p[f"c{k}"] for k in "fb"}
    logit, (states, a, alpha, pooled, sf, sb) = forward(p, gates, at, mask, True)
    q = _sigmoid(logit)
    loss = float(-np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)))
    dl = ((q - y) / len(y)).astype(np.float32)
    g = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()], np.float32)}
    dp = dl[:, None] * p["wo"]
    ds = alpha[:, :, None] * dp
    de = (states * dp).sum(2)
    de = alpha * (de - (alpha * de).sum(0))
    g["va"] = np.einsum("tb,tbk->k", de, a)
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.einsum("tbi,tbk->ik", states, da), da.sum((0, 1))
    ds = ds + da @ p["wa"].T
    dx = np.zeros_like(x)
    for k, saved, part, rev in (("f", sf, ds[:, :, :HIDDEN], False), ("b", sb, ds[:, :, HIDDEN:], True)):
        g[f"u{k}"], by_time = _back(p[f"u{k}"], saved, part, rev)
        dgate = np.zeros((len(words), 3 * HIDDEN), np.float32)
        order = at[:, ::-1] if rev else at
        np.add.at(dgate, order.T.ravel(), np.concatenate(by_time))
        g[f"w{k}"], g[f"c{k}"] = x.T @ dgate, dgate.sum(0)
        dx += dgate @ p[f"w{k}"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], own, dx[:, :WORD_DIM])
    np.add.at(g["gram"], gram, np.repeat(dx[:, WORD_DIM:] / n, n[:, 0].astype(int), 0))
    return loss, g


def windows_of(n: int) -> int:
    """How many windows cover n words; a text without words has one empty window."""
    return 1 if n <= WIDTH else -(-(n - WIDTH) // STRIDE) + 1


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end of the text) of every window, for texts of those lengths laid end to end."""
    count = np.where(lengths <= WIDTH, 1, -(-(lengths - WIDTH) // STRIDE) + 1)
    ends = np.cumsum(lengths)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(ends - lengths, count) + nth * STRIDE, np.repeat(ends, count)


def window_logits(p: dict, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window of the texts, and how many windows each has."""
    lengths = np.array([len(t) for t in texts])
    seen: dict[bytes, int] = {}
    flat = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t] + [0] * WIDTH, np.int64)
    x, _ = embed(p, list(seen) or [b"-"])
    gates = {k: (x @ p[f"w{k}"] + p[f"c{k}"]).astype(np.float32) for k in "fb"}
    first, end = layout(lengths)
    out, span = np.empty(len(first), np.float32), np.arange(WIDTH)
    for i in range(0, len(first), 2048):
        at = first[i : i + 2048, None] + span
        mask = at < end[i : i + 2048, None]
        out[i : i + 2048] = forward(p, gates, flat[np.where(mask, at, 0)], mask.astype(np.float32))[0]
    return out, np.where(lengths <= WIDTH, 1, -(-(lengths - WIDTH) // STRIDE) + 1)


def text_logits(p: dict, texts: list) -> np.ndarray:
    """Worst window of every text, null texts as empty ones."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text.encode().lower().split() if text else [])
        size += len(part[-1])
        if size >= CHUNK:
            logit, n = window_logits(p, part)
            out.append(np.maximum.reduceat(logit, np.cumsum(n) - n))
            part, size = [], 0
    if part:
        logit, n = window_logits(p, part)
        out.append(np.maximum.reduceat(logit, np.cumsum(n) - n))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def train(windows: list[list[list[bytes]]], labels: np.ndarray, rounds: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict | None:
    """Fits the network on documents' windows; None without both labels.

    First every window has its document's label; then only each document's worst window so far and, of label 0, one
    more. Last the output is shifted so that the best cut on these documents lies at LEVEL.
    """
    if len(set(labels.tolist())) < 2:
        return None
    r, p = np.random.default_rng(seed), initial()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    flat = [w for d in windows for w in d]
    doc = np.repeat(np.arange(len(windows)), [len(d) for d in windows])
    starts = np.searchsorted(doc, np.arange(len(windows)))

    def learn(chosen):
        nonlocal step
        chosen = r.permutation(chosen)
        for i in range(0, len(chosen), batch):
            part = chosen[i : i + batch]
            seen: dict[bytes, int] = {}
            at, mask = np.zeros((len(part), WIDTH), np.int64), np.zeros((len(part), WIDTH), np.float32)
            for j, k in enumerate(part):
                ids = [seen.setdefault(w, len(seen)) for w in flat[k]]
                at[j, : len(ids)], mask[j, : len(ids)] = ids, 1
            _, g = gradients(p, list(seen) or [b"-"], at, mask, labels[doc[part]].astype(np.float32))
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def scores():
        return np.concatenate([window_logits(p, flat[i : i + 20_000])[0] for i in range(0, len(flat), 20_000)])

    few = np.concatenate([s + r.permutation(len(d))[:6] for s, d in zip(starts, windows, strict=True)])
    learn(few)
    for _ in range(rounds):
        now = scores()
        order = np.lexsort((-now, doc))
        worst = order[starts]
        more = starts + (r.random(len(windows)) * [len(d) for d in windows]).astype(int)
        learn(np.unique(np.concatenate([worst, more[labels == 0]])))
    top = np.maximum.reduceat(scores(), starts)
    order = np.argsort(-top, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(top) + 1) + labels.sum())
    best = int(np.argmax(f1))
    cut = (top[order[best]] + top[order[min(best + 1, len(top) - 1)]]) / 2
    p["bo"] = p["bo"] + np.float32(np.log(LEVEL / (1 - LEVEL)) - cut)
    return p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> dict | float:
    """A network for docs(doc_id, text) and labels(doc_id, toxic), or the share of label 1 where it can't be fitted.

    Null labels and ids teach nothing; of several labels for one id the largest counts.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = text.encode().lower().split() if text else []
                out.append([b" ".join(words[i * STRIDE : i * STRIDE + WIDTH]) for i in range(windows_of(len(words)))])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "windows": out})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    got = rows.mapInPandas(cut, "doc_id long, toxic int, windows array<binary>").limit(2 * sample).toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    y = (got["toxic"].to_numpy() > 0).astype(np.int64)
    pool: dict[bytes, bytes] = {}  # windows share their words
    p = train([[[pool.setdefault(x, x) for x in bytes(w).split()] for w in d] for d in got["windows"]], y)
    return p if p is not None else float(y.mean()) if len(y) else 0.0


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """docs with `score` and `predicted` (score >= LEVEL) for docs.text, whose other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            pdf = pdf.copy()
            pdf["score"] = _sigmoid(text_logits(p, pdf["text"].tolist()).astype(float)) if isinstance(p, dict) else p
            pdf["predicted"] = (pdf["score"] >= LEVEL).astype("int32")
            yield pdf

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep).mapInPandas(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a network that learned from labelled documents not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
