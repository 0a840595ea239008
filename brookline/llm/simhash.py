"""Near-duplicates by SimHash with multi-index hashing.

A fingerprint has 64 bits, in two segments of 32. There is a table for each segment: rows (segment, value, fingerprint).
Two fingerprints within distance 2 differ by one bit at most in one of the segments, so each fingerprint enumerates the
Hamming ball of radius 1 within each of its segments, fetches what the tables hold under those values, and what it fetches
is verified by its complete distance. (Of two values that differ by one bit only the one that has it asks for the other,
so a ball's probes are the value and the value with each set bit cleared, and no link is fetched twice that way.)

Only distinct fingerprints take part, so copies cost nothing. A segment value that more than HOT of them share is split by
the other segment: there the tables are keyed by the values within one bit of it as well, and a probe asks for its ball
there (for its own value, if a bit went already), which finds all that can be within distance 2 and keeps every key's group
below 33 by 65 rows. Results do not depend on HOT.

Defined results: a null or empty text (or one of white space only) has fingerprint zero and links like any other; fewer
words than the shingle size make one shingle; a null doc_id never is a component's id unless all of its ids are null;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

SEED, SHINGLE, SEGMENT, HOT = 42, 3, 32, 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of one whole text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # both are about ASCII alone
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    made = np.array(hashes, np.uint64).view(np.uint8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(made), 8 * 65_536):  # blocks bound the memory of a very long text
        ones += np.unpackbits(made[at : at + 8 * 65_536], bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(value: Column) -> Column:
    """The values of SEGMENT bits within one bit of value, itself first."""
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT)])
    return F.transform(bits, lambda bit: value.bitwiseXOR(bit))


def candidates(fps: DataFrame, hot_from: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp, a table that is cheap to read again) that the segments' tables
    give: all pairs within distance 2, and others; a pair may come several times."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long")), F.shiftrightunsigned("fp", SEGMENT)
    halves = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value"), high.alias("rest")), F.struct(F.lit(1).alias("seg"), high.alias("value"), low.alias("rest")))
    tables = fps.select("fp", F.inline(halves))
    # Rarely any; read from a written table, it is broadcast only where its measured size allows it.
    hot = written(tables.groupBy("seg", "value").count().where(F.col("count") > hot_from).select("seg", "value", F.lit(True).alias("hot")), "hot")
    whole = F.array(F.lit(-1).cast("long"))
    held = tables.join(hot, ["seg", "value"], "left").select("seg", "value", F.col("fp").alias("a"), F.explode(F.when(F.col("hot"), _ball(F.col("rest"))).otherwise(whole)).alias("inner"))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(SEGMENT)])
    asked = F.concat(F.array("value"), F.transform(F.filter(bits, lambda bit: F.col("value").bitwiseAND(bit) != 0), lambda bit: F.col("value").bitwiseXOR(bit)))
    probes = tables.select("seg", F.col("value").alias("own"), "rest", F.col("fp").alias("b"), F.explode(asked).alias("value"))
    inner = F.when(F.col("hot") & (F.col("own") == F.col("value")), _ball(F.col("rest"))).when(F.col("hot"), F.array("rest")).otherwise(whole)
    probes = probes.join(hot, ["seg", "value"], "left").select("seg", "value", "own", "b", F.explode(inner).alias("inner"))
    # Spark estimates both sides by the file of fps, whatever they explode to, and would broadcast millions of probes.
    met = held.join(probes.hint("merge"), ["seg", "value", "inner"])
    return met.where((F.col("own") != F.col("value")) | (F.col("a") < F.col("b"))).select("a", "b")


def near_links(fps: DataFrame, hot_from: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of which 2 or fewer bits differ, each once."""
    found = candidates(fps, hot_from).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    signed = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    root = components(near_links(distinct.select("fp")))
    # The same: what has a row per fingerprint or document grows with the input and never goes through the driver.
    placed = distinct.join(root.hint("merge"), distinct.fp == root.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")).hint("merge"), "root").select("fp", "component_id")
    return signed.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
