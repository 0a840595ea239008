"""Importance resampling towards a target: documents are drawn by how much likelier their words are in target texts.

Three steps:

* **Weights from arrays.** Words fall in a fixed number of buckets. Tasks count buckets in one array each; the sums (one
  number per bucket, so their size is fixed) give an array of gains, and a document's weight is the sum of its buckets'
  entries. A keyed pseudo-random Gumbel term turns the greatest scores into a draw without replacement.
* **Sorted runs.** Keys (score, then doc_id) sampled from all eligible rows give ranges of about equal size. Each task
  sorts what it reads into runs, cut at the ranges' borders. Ranges beyond the draw's last row make no runs at all.
* **External merge.** The runs of a range meet in one task, which spools their blocks to a file of its own and merges them
  by a tournament (loser) tree that holds a block of each; with more runs than FAN_IN it merges some of them into longer
  ones first. Counts of ranges say at which rank each begins. The tree of the range with the last row drawn stops there.

Every row comes out once: those of drawn ranges from the merge, all others as they were scored, so nothing is joined.

Defined results: a null or empty text has no features and weight 0; a null doc_id is hashed as an empty text and comes last
among ties; rows that repeat are counted and drawn as often as they occur (among rows that are the same in score and
doc_id, any order); empty documents give an empty table; without target texts the gains are those of zero counts.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import zlib
from collections.abc import Iterator
from typing import IO, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

BUCKETS, ORDER, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Rows of a range (where MOST_RANGES allows), ranges at most, keys sampled for each, rows of a run and of a block, runs merged at once.
RANGE_ROWS, MOST_RANGES, KEYS_EACH, RUN_ROWS, BLOCK_ROWS, FAN_IN = 4096, 8192, 32, 1 << 20, 4096, 256
#: Bytes with A-Z lowered, and which of those are parts of words.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LAST_ID = np.iinfo(np.int64).max
_KEY = lambda: F.coalesce("doc_id", F.lit(int(_LAST_ID)))

#: A row of a run. none: doc_id is null.
ROW = np.dtype([("score", "<i8"), ("doc_id", "<i8"), ("none", "<i8"), ("n_features", "<i8"), ("weight", "<i8")])
_SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def buckets_of(texts: pa.Array, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature of the texts in turn, where each text's features begin, and how many words each has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    # Pieces are maximal runs of bytes of words, or of none, within a text.
    inside, begins = _WORD[raw], np.zeros(len(raw) + 1, bool)
    begins[1:-1] = inside[1:] != inside[:-1]
    begins[ends] = True
    starts = np.flatnonzero(begins)
    real = inside[starts[:-1]]
    at = np.concatenate([[0], np.cumsum(real)])[np.searchsorted(starts, ends)]
    n_words = np.diff(at)
    if not real.any():
        return np.zeros(0, np.int64), at, n_words
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)])
    numbered = pc.dictionary_encode(pieces)
    ids, names = numbered.indices.to_numpy()[real], numbered.dictionary.to_pylist()
    if order == 1:
        return np.array([zlib.crc32(w) for w in names], np.int64)[ids] % buckets, at, n_words
    # Longer runs: a CRC goes on where the run one word shorter ended.
    out, crc, last = [], np.array([zlib.crc32(names[i]) for i in ids], np.int64), np.repeat(at[1:], n_words)
    place, row = np.arange(len(ids)), np.repeat(np.arange(len(n_words)), n_words)
    rows = [row]
    out.append(crc % buckets)
    for k in range(1, order):
        keep = np.flatnonzero(place + k < last)
        crc[keep] = [zlib.crc32(b" " + names[ids[p + k]], int(crc[p])) for p in keep]
        out.append(crc[keep] % buckets)
        rows.append(row[keep])
    row = np.concatenate(rows)
    by_row = np.argsort(row, kind="stable")
    return np.concatenate(out)[by_row], np.searchsorted(row[by_row], np.arange(len(n_words) + 1)), n_words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs: an array of fixed size, added up from one array per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            total += np.bincount(buckets_of(b.column(0), buckets, order)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths: the logarithm of its share in the target over that in the source, each count
    raised by one, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(n)) / ((s + 1.0) * (t_all + float(n))))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def chance(doc_id: int | None, seed: int = SEED) -> int:
    """The Gumbel term of a document in thousandths, from a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, order: int = ORDER, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, eligible)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, at, n_words = buckets_of(b.column(1), len(gains), order)
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            weight = sums[at[1:]] - sums[at[:-1]]
            score = weight + np.array([chance(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(weight), pa.array(score), pa.array(n_words >= min_words)], ["doc_id", "n_features", "weight", "score", "eligible"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCORED)


def packed(b: pa.RecordBatch) -> np.ndarray:
    """(doc_id, n_features, weight, score) as rows of a run."""
    out = np.zeros(b.num_rows, ROW)
    out["none"] = pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
    out["doc_id"] = pc.fill_null(b.column(0), _LAST_ID).to_numpy()
    for i, name in enumerate(("n_features", "weight", "score"), 1):
        out[name] = b.column(i).to_numpy()
    return out


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["doc_id"], -rows["score"]))]


class Cuts(NamedTuple):
    """Where ranges end: keys (score, doc_id), in order; a range holds what comes after its predecessor's key up to its own."""

    score: np.ndarray
    doc_id: np.ndarray

    def ranges(self, rows: np.ndarray) -> np.ndarray:
        """The range of each of these sorted rows: how many keys come before it."""
        score, doc_id = np.concatenate([self.score, rows["score"]]), np.concatenate([self.doc_id, rows["doc_id"]])
        is_row = np.arange(len(score)) >= len(self.score)
        # A key that equals a row comes after it, so that the row is in the range which the key ends.
        order = np.lexsort((~is_row, doc_id, -score))
        flags = is_row[order]
        return np.cumsum(~flags)[flags]

    def beyond(self, r: int) -> Column:
        """Whether a row of a scored table comes after range r."""
        s, d = int(self.score[r]), int(self.doc_id[r])
        return (F.col("score") < s) | (F.col("score") == s) & (_KEY() > d)


def cuts_of(table: DataFrame, n: int) -> Cuts:
    """Keys that cut n eligible rows into ranges, from a sample of bounded size (KEYS_EACH * MOST_RANGES and its spread)."""
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    share = min(1.0, KEYS_EACH * ranges / max(1, n))
    keys = table.where("eligible").where(F.pmod(F.xxhash64("doc_id", "score"), F.lit(1 << 30)) < F.lit(max(1, round(share * (1 << 30)))))
    found = keys.select("score", _KEY().alias("doc_id")).distinct()
    rows = found.sort(F.desc("score"), "doc_id").toPandas() if ranges > 1 else pd.DataFrame({"score": [], "doc_id": []})
    at = np.unique(np.arange(1, ranges) * len(rows) // ranges) if len(rows) else np.zeros(0, int)
    return Cuts(*(rows[c].to_numpy(np.int64)[at] for c in ("score", "doc_id")))


def count_ranges(table: DataFrame, cuts: Cuts) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts.score) + 1, np.int64)
        for b in batches:
            total += np.bincount(cuts.ranges(in_order(packed(b))), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["range", "n"])

    out = np.zeros(len(cuts.score) + 1, np.int64)
    for r, n in table.where("eligible").select("doc_id", "n_features", "weight", "score").mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n")).collect():
        out[r] = n
    return out


def sorted_runs(table: DataFrame, cuts: Cuts, last: int) -> DataFrame:
    """Runs of the ranges up to the last: rows (range, run, block, rows), rows sorted within a run, blocks numbered in it."""

    def blocks(run: int, rows: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        rows = in_order(rows)
        edges = np.searchsorted(cuts.ranges(rows), np.arange(last + 2))
        for r in range(last + 1):
            for i, lo in enumerate(range(edges[r], edges[r + 1], BLOCK_ROWS)):
                yield r, run, i, rows[lo : min(lo + BLOCK_ROWS, edges[r + 1])].tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(blocks(first + made, np.concatenate(held)))
            for lo in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 64], strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["range", "run", "block", "rows"])

        for b in batches:
            held.append(packed(b))
            n += b.num_rows
            if n >= RUN_ROWS:
                yield from flush()
                held, n, made = [], 0, made + 1
        if n:
            yield from flush()

    rows = table.where("eligible")
    if last < len(cuts.score):  # what comes after the last range's end needs no run
        rows = rows.where(~cuts.beyond(last))
    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(make, "range int, run long, block int, rows binary")


class Spool:
    """Blocks of sorted runs in a file of the task's own, which goes with it."""

    def __init__(self) -> None:
        self.file: IO[bytes] = tempfile.TemporaryFile()
        self.at = 0
        self.runs: list[list[tuple[int, int]]] = []

    def begin(self) -> None:
        self.runs.append([])

    def add(self, raw: bytes) -> None:
        self.file.seek(self.at)
        self.file.write(raw)
        self.runs[-1].append((self.at, len(raw)))
        self.at += len(raw)

    def rows(self, run: int) -> Iterator[tuple[tuple[int, int, int], np.void]]:
        for at, size in self.runs[run]:
            self.file.seek(at)
            block = np.frombuffer(self.file.read(size), ROW)
            yield from zip(zip((-block["score"]).tolist(), block["doc_id"].tolist(), block["none"].tolist(), strict=True), block, strict=True)


class LoserTree:
    """A tournament of sorted runs: each inner place keeps the loser of its match, so that a new head plays only the matches
    on its way up."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self.play(i)

    def before(self, a: int, b: int) -> bool:
        """Whether run a's head comes out before run b's; a run that has ended comes last, ties go by the run's number."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or x[0] == y[0] and a < b

    def play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at:
            if self.tree[at] < 0:  # while the tree is built, the first to come waits for the other
                self.tree[at] = winner
                return
            if self.before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[np.void]:
        while self.heads[top := self.tree[0]] is not None:
            yield self.heads[top][1]
            self.heads[top] = next(self.runs[top], None)
            self.play(top)


def merged(spool: Spool) -> Iterator[np.void]:
    """All rows of the runs in order, through as many rounds as it takes to have FAN_IN runs at most."""
    while len(spool.runs) > FAN_IN:
        longer = Spool()
        for lo in range(0, len(spool.runs), FAN_IN):
            longer.begin()
            block: list[np.void] = []
            for row in LoserTree([spool.rows(r) for r in range(lo, min(lo + FAN_IN, len(spool.runs)))]):
                block.append(row)
                if len(block) == BLOCK_ROWS:
                    longer.add(np.array(block, ROW).tobytes())
                    block = []
            if block:
                longer.add(np.array(block, ROW).tobytes())
        spool.file.close()
        spool = longer
    return iter(LoserTree([spool.rows(r) for r in range(len(spool.runs))]))


def draw(table: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank) of a scored table (one that is cheap to read again, such as a written
    one): rank is 1, 2, 3 and so on among percent of a hundred of the eligible rows, null for all others."""
    n = table.where("eligible").count()
    wanted = percent * n // 100
    plain = table.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return plain
    cuts = cuts_of(table, n)
    ends = np.cumsum(count_ranges(table, cuts))
    last = int(np.searchsorted(ends, wanted))
    bases = np.concatenate([[0], ends])[: last + 1]

    def ranked(spool: Spool, r: int) -> Iterator[pa.RecordBatch]:
        rank, block = int(bases[r]), []
        rows = merged(spool)
        for row in rows:
            rank += 1
            block.append(row)
            if len(block) == BLOCK_ROWS or rank == wanted:
                yield given(np.array(block, ROW), rank)
                block = []
            if rank == wanted:
                break
        if block:
            yield given(np.array(block, ROW), rank)
        if rank == wanted:
            block = []
            for row in rows:  # the draw is over; what is left of its last range comes out without a rank
                block.append(row)
                if len(block) == BLOCK_ROWS:
                    yield given(np.array(block, ROW), None)
                    block = []
            if block:
                yield given(np.array(block, ROW), None)

    def given(rows: np.ndarray, last_rank: int | None) -> pa.RecordBatch:
        ranks = pa.nulls(len(rows), pa.int64()) if last_rank is None else pa.array(np.arange(last_rank - len(rows) + 1, last_rank + 1), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64(), mask=rows["none"] > 0), *(pa.array(rows[c], pa.int64()) for c in ("n_features", "weight", "score")), ranks], ["doc_id", "n_features", "weight", "score", "rank"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, at, run = Spool(), None, None
        for b in batches:
            for r, k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if at is not None and r != at:
                    yield from ranked(spool, at)
                    spool, run = Spool(), None
                if run != k:
                    spool.begin()
                at, run = r, k
                spool.add(raw.as_py())
        if at is not None:
            yield from ranked(spool, at)

    runs = sorted_runs(table, cuts, last).repartition("range").sortWithinPartitions("range", "run", "block")
    drawn = runs.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    if last == len(cuts.score):
        return drawn.union(plain.where(~table["eligible"]))
    return drawn.union(table.where(~F.col("eligible") | cuts.beyond(last)).select(*plain.columns[:4], F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank) of all docs, drawn towards the texts of target."""
    gains = gains_of(bucket_counts(docs, buckets, order, text_col), bucket_counts(target, buckets, order))
    return draw(written(scored(docs, gains, order, seed, min_words, id_col, text_col), "scores"), percent)
