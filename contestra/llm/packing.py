"""Vector bin packing of token runs for instruction data.

Documents are tokenized, cut at every `capacity` ids (those pieces fill a sequence alone), and what remains of each is
placed with others under simultaneous limits on tokens, segments and loss-bearing tokens. The dot-product heuristic
opens one sequence after another and always places the piece whose demand vector has the largest inner product with
the sequence's free capacity, so long as it fits in all three. Pieces are dealt by hash into batches of bounded size;
each batch is packed on its own, so nothing but one batch is ever held together.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, staged

#: Pieces in a batch, about. Batches are independent.
BATCH = 4096
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1_200_000
END = b"\x01\x00\x00\x00"


class WordIds(dict):
    """Bytes of a white-space free chunk -> its ids as little-endian uint32. Ids of a text are those of its chunks,
    since this tokenizer drops white space and never looks across it."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = out = array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        return out

    def of(self, text: str | None) -> bytes:
        """The ids of a text and the end id; a null text is empty."""
        return b"".join(map(self.__getitem__, text.encode().split())) + END if text else END


@cache
def word_ids(tokenizer_path: str) -> WordIds:
    """One for each tokenizer in a worker process, which serves many tasks."""
    return WordIds(tokenizer_path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        for pdf in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for at, ids in enumerate(map(words.of, pdf["text"])):
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    doc.append(at)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array[doc] if doc else pdf["doc_id"].array[:0], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def dot_product_bins(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sequence number of each row of demand (items x dimensions); every row fits within limits. Of equally good rows
    the larger goes first, then the earlier."""
    share = demand / limits
    order = np.lexsort((np.arange(len(share)), -share.sum(1)))
    want, part = np.ascontiguousarray(demand[order].T.astype(float)), np.ascontiguousarray(share[order].T)
    out, live, at = np.empty(len(demand), np.int64), order, 0
    while len(live):
        free, open_ = limits.astype(float), np.ones(len(live), bool)
        while True:
            fits = open_.copy()
            for w, f in zip(want, free, strict=True):
                fits &= w <= f
            if not fits.any():
                break
            score = np.zeros(len(live))
            for p, c in zip(part, free / limits, strict=True):
                score += p * c
            score[~fits] = -1
            k = int(np.argmax(score))
            out[live[k]], open_[k] = at, False
            free = free - want[:, k]
        live, want, part = live[open_], np.ascontiguousarray(want[:, open_]), np.ascontiguousarray(part[:, open_])
        at += 1
    return out


def pack(pieces: DataFrame, limits: tuple[int, int, int], keys: tuple[str, ...], batch: int = BATCH) -> DataFrame:
    """pieces(length, loss_tokens, ...) with `sequence_id` and `offset` (tokens before the piece in its sequence).

    limits: most tokens, segments and loss-bearing tokens of a sequence. A piece that alone exceeds one raises an
    error; null lengths count as 0. keys order the pieces before packing, and with them reruns agree; rows equal in
    all keys swap places freely. An empty table gives an empty one.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    total = pieces.count()
    n = max(1, -(-total // batch))
    dealt = pieces.select(*keep, F.pmod(F.xxhash64(*keys), F.lit(n)).alias("__batch"))
    most = np.array(limits)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(keys), kind="stable", na_position="first", ignore_index=True)
        want = np.stack([pdf["length"].fillna(0), np.ones(len(pdf)), pdf["loss_tokens"].fillna(0)], 1).astype(np.int64)
        if (want > most).any():
            raise ValueError("a piece exceeds the limits of a sequence")
        pdf["sequence_id"] = dot_product_bins(want, most) + (pdf["__batch"].to_numpy() << 32)
        pdf["offset"] = pdf["length"].fillna(0).astype("int64").groupby(pdf["sequence_id"]).cumsum() - pdf["length"].fillna(0).astype("int64")
        return pdf.drop(columns="__batch")

    fields = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", sequence_id long, offset long"
    return dealt.groupBy("__batch").applyInPandas(place, schema)


def op9_packing(spark: SparkSession, sf_dir: str, capacity: int = 2048, segments: int = 512, path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens. Null and empty texts are the end id alone.

    Every id bears loss here, so that limit equals the token limit. Repeated rows are packed as often as they occur.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_documents(docs, capacity, segments, path)


def packed_documents(docs: DataFrame, capacity: int = 2048, segments: int = 512, path: str | None = None) -> DataFrame:
    pieces = staged(token_pieces(docs, path or tokenizer_path(), capacity).withColumn("loss_tokens", F.col("length")), "pieces")
    return pack(pieces, (capacity, segments, capacity), ("doc_id", "start", "ids_crc32", "length")).drop("loss_tokens")
