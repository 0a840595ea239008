"""Packing by concatenate-and-cut.

The documents, each closed by an end id, form one long tape that is cut into windows of fixed length. Pass one writes
every document's ids with its place within its partition; the partitions' token totals give, by prefix sums, where each
partition starts on the tape; pass two cuts each document at the windows' borders. Only the last window can be short, so
there is no padding but there.

The tape's order is that of the written table's partitions. Every id lies in exactly one piece.

Defined results: a null or empty text is one end id; a null doc_id stays null; rows that repeat are packed as often as
they occur; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

WINDOW, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
CACHE_BYTES = 200 << 20

_CODERS: dict[str, WordCoder] = {}


class WordCoder:
    """Ids of whole texts, the same as the tokenizer's own, word by word with a bounded cache.

    The tokenizer drops white space and no token spans it, nor the border of a letter and the marks after it, so the ids
    of a text are those of its words in turn. Arrow lowers ASCII letters (as the tokenizer does later), cuts texts into
    words and numbers the distinct ones; only those are looked up or tokenised. Latin words skip the normaliser, which
    would only lower their case. A text with the start of a special token's name is left to the tokenizer as it is.
    The cache has two generations: when the young one is full it becomes the old one, and what is met again moves up."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = self.left = cache_bytes // 2

    @staticmethod
    def ids(tokenizer, texts: list[str]) -> list[bytes]:
        try:
            return [array("H", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        except OverflowError:
            raise ValueError("this packing keeps ids in 16 bits; the vocabulary has larger ones") from None

    def learn(self, words: list[str]) -> None:
        """Puts words that no generation holds in the young one."""
        plain, odd = [], []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or max(w) < "\u0250" and w.lower().isalpha()) else odd).append(w)
        for some, tokenizer, texts in ((plain, self.bare, [w.lower() for w in plain]), (odd, self.full, odd)):
            made = self.ids(tokenizer, texts)
            self.young.update(zip(some, made, strict=True))
            self.left -= 190 * len(some) + sum(map(len, some)) + sum(map(len, made))

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if "<|" in t}
        low = pc.ascii_lower(pa.array(["" if i in special else t for i, t in enumerate(texts)] if special else texts, pa.large_string()))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, "([a-z])([.,;:!?]+)([ \n]|$)", "\\1 \\2\\3"))
        numbered = pc.dictionary_encode(lists.values)
        words = numbered.dictionary.to_pylist()
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        if old:
            again = {w: old[w] for w in new if w in old}
            young.update(again)
            self.left -= 210 * len(again)
            new = [w for w in new if w not in again]
        if new:
            self.learn(new)
        ids = pa.array([young[w] for w in words], pa.large_binary()).take(numbered.indices)
        # The ids taken in turn lie end to end in one buffer; a text's are those between its first and last word.
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), ids.buffers()[2]
        cuts = ends[np.asarray(lists.offsets)].tolist()
        joined = [data[lo:hi].to_pybytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
        for i in special:
            joined[i] = self.ids(self.full, [texts[i]])[0]
        if self.left < 0:
            self.old, self.young, self.left = young, {}, self.room
        return joined


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows (part, doc_id, start, n, ids): start is the document's place within its partition, ids 16-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, end, words = TaskContext.get().partitionId(), 0, np.array([end_id], "<u2").tobytes(), coder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                ids = [x + end for x in words.encode([t or "" for t in some.column(1).to_pylist()])]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), some.column(0), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["part", "doc_id", "start", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "part int, doc_id long, start long, n long, ids binary")


def cut(doc_ids: list, starts: list[int], ids: list[bytes], window: int = WINDOW) -> pa.RecordBatch:
    """Pieces of documents that start at these places on the tape."""
    out: tuple[list, ...] = ([], [], [], [], [], [], [])
    for doc, at, raw in zip(doc_ids, starts, ids, strict=True):
        wide = memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
        n, lo = len(raw) // 2, 0
        while lo < n:
            seq, off = divmod(at + lo, window)
            hi = min(n, lo + window - off)
            for col, v in zip(out, (doc, lo, hi - lo, zlib.crc32(wide[4 * lo : 4 * hi]), n, seq, off), strict=True):
                col.append(v)
            lo = hi
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tape = written(tokenise(docs, path, id_col, text_col, end_id), "tape")
    # One row of two numbers per partition of the input, as many as tasks: the prefix sum over them is a window over all of
    # them (16 MB for a million partitions), and the join broadcasts the written table only where its size allows it.
    totals = tape.groupBy("part").agg(F.sum("n").alias("total"))
    base = written(totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("base")), "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                yield cut(*(some.column(i).to_pylist() for i in range(3)), window)

    placed = tape.join(base, "part").select("doc_id", (F.col("start") + F.coalesce("base", F.lit(0))).alias("at"), "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
