"""Token ids as ORC files.

A data set is a folder of two ORC tables. `ids` has a row per document, in ascending doc_id within a file and from file to
file: doc_id, the number of the file, the count of ids before it in that file, its own count, and the ids as a list of
integers, which ORC keeps in its run-length encoding. Files are cut into stripes, which Spark reads in parallel; stripes
and their row groups carry minimum, maximum and a Bloom filter of doc_id, so that a search for some documents reads only
the row groups that may hold them. `files` has a row per file: its documents, its ids and the ids of all files before it.

Texts are dealt by ranges of doc_id first (the sample that finds the ranges reads texts, but encodes none) and encoded in
the sorted order, row by row, so a task holds a batch and never a file. Ids are the tokenizer's own: `PieceCoder` encodes
each distinct piece of a batch once, where pieces are cut only at places which the tokenizer always cuts at too.

Defined results: a null or empty text is one end id; null doc_ids come first and stay null; of rows with one doc_id those
of the smaller hash of the text come first, and rows that repeat are written as often as they occur; an empty table gives
an empty data set; other columns are left out.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shared_dir, slices, tasks_for

END_ID, VOCABULARY = 0, "byte_bpe_50k.json"
#: Bytes of texts for one file, of a stripe before compression, and rows of a row group.
FILE_BYTES, STRIPE_BYTES, GROUP_ROWS = 64 << 20, 8 << 20, 1000
CACHE_BYTES = 200 << 20

#: White space beyond ASCII, as the tokenizer's pattern sees it; texts that hold any are encoded whole.
_WIDE_SPACE = "[\u0085   -     　]|<\\|"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and for a pair of classes (6 * left + right) whether the tokenizer always cuts between."""
    space, letter, digit, quote, other, high = range(6)
    kind = np.full(256, other, np.uint8)
    kind[128:] = high
    kind[ord("'")] = quote
    kind[[9, 10, 11, 12, 13, 32]] = space
    kind[ord("0") : ord("9") + 1] = digit
    for a in "aA":
        kind[ord(a) : ord(a) + 26] = letter
    cut = np.zeros(36, bool)
    # A run of letters ends where an ASCII byte that is none follows, and so for digits. Other signs end at a letter or
    # digit, but a quote may go with the letter after it. White space begins after whatever is none.
    for left, rights in ((letter, (space, digit, quote, other)), (digit, (space, letter, quote, other)), (quote, (space, digit)), (other, (space, letter, digit)), (high, (space,))):
        cut[[6 * left + r for r in rights]] = True
    return kind, cut


_KIND, _CUT = _tables()


class PieceCoder:
    """Ids of whole texts, the same as the tokenizer's own, by distinct pieces with a bounded cache of two generations."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.room = self.left = cache_bytes // 2

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        made = self.ids([p.decode() for p in pieces])
        self.young.update(zip(pieces, made, strict=True))
        self.left -= 200 * len(pieces) + sum(map(len, pieces)) + sum(map(len, made))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _WIDE_SPACE)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(whole) else texts
        ends = np.frombuffer(plain.buffers()[1], np.int64, len(plain) + 1, plain.offset * 8) if len(plain) else np.zeros(1, np.int64)
        raw = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        kind = _KIND[raw]
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = _CUT[kind[:-1] * 6 + kind[1:]]
        begins[ends] = True
        starts = np.flatnonzero(begins)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
        numbered = pc.dictionary_encode(pieces)
        words = numbered.dictionary.to_pylist()
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        if old and new:
            again = {w: old[w] for w in new if w in old}
            young.update(again)
            self.left -= 220 * len(again)
            new = [w for w in new if w not in again]
        if new:
            self.learn(new)
        ids = pa.array([young[w] for w in words], pa.large_binary()).take(numbered.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(starts, ends)] // 4 if len(ids) else np.zeros(len(ends), np.int64)
        flat = np.frombuffer(ids.buffers()[2], "<u4")[: at[-1]] if at[-1] else np.zeros(0, "<u4")
        if len(whole):  # their ids go where the empty texts in their stead stand
            own = [np.frombuffer(x, "<u4") for x in self.ids([texts[int(i)].as_py() for i in whole])]
            flat = np.insert(flat, np.repeat(at[whole], [len(x) for x in own]), np.concatenate(own))
            more = np.zeros(len(at), np.int64)
            more[whole + 1] = [len(x) for x in own]
            at = at + np.cumsum(more)
        if self.left < 0:
            self.old, self.young, self.left = young, {}, self.room
        return flat, at


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, file, before, n_tokens, ids) in the order of the rows of docs' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, words = TaskContext.get().partitionId(), 0, coder(tokenizer)
        for b in slices(batches, 1000):
            flat, ends = words.encode(b.column(1))
            flat = np.insert(flat.astype(np.int32), ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            n = np.diff(ends)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([file] * len(n), pa.int32()), pa.array(at + ends[:-1], pa.int64()), pa.array(n, pa.int64()), ids], ["doc_id", "file", "before", "n_tokens", "ids"])
            at += int(ends[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, file int, before long, n_tokens long, ids array<int>")


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Writes the data set. files: how many (default: by the size of docs)."""
    spark = docs.sparkSession
    files = files or tasks_for(docs, FILE_BYTES)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ids = encoded(kept.repartitionByRange(files, *order).sortWithinPartitions(*order), tokenizer, end_id=end_id)
    options = {"compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(GROUP_ROWS), "orc.rows.between.memory.checks": "500", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ids.write.options(**options).orc(f"{path}/ids")
    totals = spark.read.schema(ids.schema).orc(f"{path}/ids").groupBy("file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # A row per file, as many as tasks wrote; the sums before each are a window over all of those rows.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals.withColumn("base", before).write.option("compression", "zstd").orc(f"{path}/files")


IDS_SCHEMA = "doc_id long, file int, before long, n_tokens long, ids array<int>"
FILES_SCHEMA = "file int, docs long, n_tokens long, first_doc long, last_doc long, base long"


def read_ids(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the data set; start counts the ids of all documents before.

    doc_ids, or a range from first to last, are filters that reach the files: what stripes' and row groups' minima, maxima
    and Bloom filters rule out isn't read."""
    rows = spark.read.schema(IDS_SCHEMA).orc(f"{path}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    files = spark.read.schema(FILES_SCHEMA).orc(f"{path}/files").select("file", "base")
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            lists = b.column(3)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch(spark: SparkSession) -> str:
    """A new folder for a data set in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/brookline/token-ids-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path
