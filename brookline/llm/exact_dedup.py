"""Exact deduplication by Grace hashing.

Texts are equal if they are the same after every ASCII white space character is deleted. Each task first folds its own
rows in an open-addressing table (so a text that a third of all rows hold leaves a task once), the shuffle deals the
folded texts into buckets by hash, and a bucket that does not fit in memory is split again into spill files by another
hash, until an open-addressing table that compares complete contents holds it.

Defined results: a null text counts as empty; a null doc_id sorts after every other; rows that repeat the doc_id of the
row that stays stay with it (doc_id names a row); an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, tasks_for

#: Bytes of text that a table may hold before it is split, spill files a split, how often; and bytes of the input for each bucket
#: of the shuffle.
TABLE_BYTES, FAN_OUT, MAX_LEVEL, BUCKET_BYTES = 96 << 20, 16, 8, 64 << 20
SENT = 1000  # entries a batch that a task sends
DELETE = SPACES.encode()
LAST = 1 << 63  # stands for a null doc_id: after every long


class OpenTable:
    """Open addressing with linear probing; an entry is [hash, content, rows, most code points, smallest doc_id there]."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def add(self, content: bytes, rows: int, length: int, doc_id: int, seed: int = 0) -> None:
        h = xxhash.xxh64_intdigest(content, seed)
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            e = self.entries[i]
            if e[0] == h and e[1] == content:
                e[2] += rows
                if (-length, doc_id) < (-e[3], e[4]):
                    e[3], e[4] = length, doc_id
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, rows, length, doc_id])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, e in enumerate(self.entries):
                at = e[0] & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i


def grace(rows: Iterator[tuple], level: int = 0, limit: int = TABLE_BYTES) -> Iterator[list]:
    """Entries of the distinct contents among rows (content, rows, length, doc_id)."""
    table = OpenTable()
    for row in rows:
        table.add(*row, seed=level)
        if table.bytes > limit and level < MAX_LEVEL and len(table.entries) > 1:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory() as folder:
        files = [open(f"{folder}/{i}", "w+b") for i in range(FAN_OUT)]

        def spill(row: tuple) -> None:
            pickle.dump(row, files[xxhash.xxh64_intdigest(row[0], 1000 + level) % FAN_OUT], protocol=5)

        def read(file) -> Iterator[tuple]:
            file.seek(0)
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

        for e in table.entries:
            spill(tuple(e[1:]))
        del table
        for row in rows:
            spill(row)
        for file in files:
            yield from grace(read(file), level + 1, limit)
            file.close()


FOLDED = pa.schema([("sha", pa.string()), ("content", pa.binary()), ("n", pa.int64()), ("length", pa.int64()), ("doc", pa.int64())])
KEEP = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _sent(entries: list[list]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(entries), SENT):
        some = [{"sha": hashlib.sha256(c).hexdigest(), "content": c, "n": n, "length": length, "doc": None if doc == LAST else doc} for _, c, n, length, doc in entries[lo : lo + SENT]]
        yield pa.RecordBatch.from_pylist(some, FOLDED)


def fold_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = OpenTable()
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            table.add(text.encode().translate(None, DELETE), 1, len(text), LAST if doc is None else doc)
            if table.bytes > TABLE_BYTES // 3:
                yield from _sent(table.entries)
                table = OpenTable()
    yield from _sent(table.entries)


def settle_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in slices(batches):
            for c, n, length, doc in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                yield c, n, length, LAST if doc is None else doc

    settled = ({"sha": hashlib.sha256(content).hexdigest(), "keep_id": None if doc == LAST else doc, "group_size": n} for _, content, n, _, doc in grace(rows()))
    while some := list(islice(settled, SENT)):
        yield pa.RecordBatch.from_pylist(some, KEEP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. See the module's head for odd cases."""
    n = partitions or tasks_for(docs, BUCKET_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folded = rows.mapInArrow(fold_locally, "sha string, content binary, n long, length long, doc long")
    keep = folded.repartition(n, "sha").mapInArrow(settle_bucket, "sha string, keep_id long, group_size long")
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256)
    return (
        rows.select("doc_id", sha.alias("sha"))
        .join(keep, "sha")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
