"""Exact top-k search by BM25 on an inverted index, with a matrix of common terms in every shard.

Each input partition is indexed in shards of SHARD_BYTES of text at most. A shard's documents are put in order of their
commonest term and length, so that alike ones lie together, and cut into blocks of BLOCK_DOCS; its posting lists are one
row. Document counts, the mean length and document frequencies are taken over all shards, so that scores are global.

All distinct terms of a query count, however long it is. Queries go in blocks of about BLOCK_TERMS terms (a query is never
parted), the only thing that is broadcast. In a shard, the impacts of its commonest
terms (at most COMMON, those in one document of RARE at least) are also the rows of a matrix, which gives the sums over
these terms of some queries at once by one product; the posting lists of all other terms are added to it. Documents whose
sums reach the threshold, the k-th best score of the query in all that the task has seen, in this shard and in those
before, within what single precision may lose, are scored again exactly, in the order of terms, from the same postings by
document. A shard whose greatest impacts cannot reach it is passed over.
What is left out cannot be among the k best. A task sends its k best of each query, and they are merged exactly. Equal
scores rank by smaller id.

Defined results: null or empty texts have no terms; as queries they find nothing; documents with a null id are searched
and rank last among equals; rows that repeat are separate documents; queries with a null qid are left out, and queries of
one qid are one query; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

K1, B, TOP, BLOCK_TERMS, BLOCK_DOCS, GAP, SHARD_BYTES = 1.2, 0.75, 10, 1 << 20, 32, 2, 24 << 20
SLACK = 1e-4  # 512 terms in single precision may lose 512 / 2 ** 24 of a sum, a third of this
COMMON, RARE, CELLS, TOGETHER = 512, 100, 1 << 22, 32
LAST = (1 << 63) - 1  # stands for a null id


def analysed(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts: lower-cased runs of letters and digits, in any script."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return pc.ascii_split_whitespace(pc.replace_substring_regex(low, r"[^\pL\pN]+", " "))


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and (row, term number, tf) sorted by row and term; the rows' lengths in words."""
    lists = analysed(texts)
    ends = np.asarray(lists.offsets)
    words = pc.dictionary_encode(lists.values)
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    code, n = np.asarray(words.indices).astype(np.int64), max(1, len(words.dictionary))
    empty = pc.index(words.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        rows, code = rows[code != empty], code[code != empty]
    key, tf = np.unique(rows * n + code, return_counts=True)
    return words.dictionary, key // n, key % n, tf.astype(np.int32), np.bincount(rows, minlength=len(texts)).astype(np.int32)


INDEX = "shard long, term string, df long, words long, ids binary, lengths binary, terms binary, ends binary, docs binary, counts binary"
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def shard_rows(ids: np.ndarray, texts: pa.Array, shard: int) -> Iterator[pa.RecordBatch]:
    """The shard's row (without a term; df is its number of documents), then a row (term, df) per term."""
    terms, row, code, tf, length = counted(texts)
    # Documents in order of their commonest term, then length: blocks of like documents have tight bounds.
    commonest = np.full(len(ids), -1, np.int64)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    most = np.repeat(np.maximum.reduceat(tf, first), np.diff(np.append(first, len(row)))) if len(first) else tf
    at = np.flatnonzero(tf == most)[::-1]
    commonest[row[at]] = code[at]
    order = np.lexsort((ids, length, commonest))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    by = np.argsort(code * len(ids) + place[row])
    code, row, tf = code[by], place[row[by]], tf[by]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    names = terms.take(pa.array(code[starts]))
    ends = np.append(starts[1:], len(code))[: len(starts)]
    joined = "\n".join(names.to_pylist()).encode()  # no term holds white space
    values = [shard, None, len(ids), int(length.sum()), ids[order].astype("<i8").tobytes(), length[order].astype("<i4").tobytes(), joined, ends.astype("<i8").tobytes(), row.astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], NAMES)
    n = len(starts)
    rest = [pa.array(np.full(n, shard)), names.cast(pa.string()), pa.array(ends - starts), *(pa.nulls(n, t) for t in kinds[3:])]
    whole = pa.RecordBatch.from_arrays(rest, NAMES)
    for lo in range(0, n, 20_000):
        yield whole.slice(lo, 20_000)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index as a written table: of every shard the row with its lists, and its terms with their df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                ids.append(np.asarray(pc.fill_null(some.column(0), LAST)))
                texts.append(some.column(1).cast(pa.large_string()))
                held += texts[-1].nbytes
                if held > shard_bytes:
                    yield from shard_rows(np.concatenate(ids), pa.concat_arrays(texts), shard)
                    shard, ids, texts, held = shard + 1, [], [], 0
        if ids:
            yield from shard_rows(np.concatenate(ids), pa.concat_arrays(texts), shard)

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "index")


def query_terms(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """queries (qid, text): rows (qid, term, idf) of each query's distinct terms that occur in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                some = b.slice(lo, 200)
                names, row, code, *_ = counted(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), names.take(pa.array(code)).cast(pa.string())], ["qid", "term"])

    asked = queries.select(F.col("qid").cast("long"), "text").where("qid is not null").mapInArrow(run, "qid long, term string").distinct()
    df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "term").select("qid", "term", idf.alias("idf"))


class Asked:
    """A block of queries: its distinct terms in order, their idf, and for each query the numbers of its terms."""

    def __init__(self, table: pa.Table) -> None:
        qid, idf = np.asarray(table.column("qid")), np.asarray(table.column("idf"))
        names = table.column("term").combine_chunks().dictionary_encode()
        by_name = np.asarray(pc.sort_indices(names.dictionary))
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        self.terms = names.dictionary.take(pa.array(by_name)).to_pylist()
        term = rank[np.asarray(names.indices)]
        self.idf = np.zeros(len(self.terms))
        self.idf[term] = idf
        by = np.lexsort((term, qid))
        self.term, starts = term[by], np.flatnonzero(np.diff(qid[by], prepend=~qid[by][:1]))
        self.qid, self.cuts = qid[by][starts], np.append(starts, len(by))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shard:
    """What a shard has for the terms of a block of queries: postings with their impacts, by term and by document, and for
    each term how many there are and the greatest impact in each block of documents."""

    def __init__(self, row: dict, asked: Asked, mean: float) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        weight = K1 * (1 - B + B * np.frombuffer(row["lengths"], "<i4") / mean)
        ends = np.frombuffer(row["ends"], "<i8")
        at = pc.index_in(pa.array(asked.terms, pa.string()), pa.array(row["terms"].decode().split("\n"), pa.string())) if len(ends) else pa.nulls(len(asked.terms), pa.int32())
        here = np.flatnonzero(np.asarray(at.is_valid()))
        at = np.asarray(at.drop_null()).astype(np.int64)
        starts = np.append(0, ends)[at]
        self.n = np.zeros(len(asked.terms), np.int64)
        self.n[here] = ends[at] - starts if len(at) else starts
        self.begin = np.cumsum(self.n) - self.n
        which = ranges(starts, starts + self.n[here])
        self.docs = np.frombuffer(row["docs"], "<i4")[which]
        tf = np.frombuffer(row["counts"], "<i4")[which].astype(float)
        term = np.repeat(here.astype(np.int32), self.n[here])
        self.impact = asked.idf[term] * tf * (K1 + 1) / (tf + weight[self.docs])
        self.n_blocks = max(1, -(-len(self.ids) // BLOCK_DOCS))
        del which, tf
        key = term.astype(np.int64) * self.n_blocks + self.docs // BLOCK_DOCS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.block = (key[first] % self.n_blocks).astype(np.int32)
        self.starts = np.arange(0, max(1, len(self.ids)), BLOCK_DOCS * GAP)
        self.entries = np.searchsorted(key[first], np.arange(len(asked.terms) + 1) * self.n_blocks)
        self.top = np.zeros(len(asked.terms))
        if len(here):
            self.top[here] = np.maximum.reduceat(self.most, self.entries[here])
        del key, first
        # The commonest terms' impacts as a matrix of CELLS numbers at most.
        often = np.argsort(-self.n, kind="stable")[: min(COMMON, CELLS // max(1, len(self.ids)))]
        often = often[self.n[often] * RARE > len(self.ids)]
        self.column = np.full(len(asked.terms), -1)
        self.column[often] = np.arange(len(often))
        self.common = np.zeros((len(often), len(self.ids)), np.float32)
        for i, (lo, n) in enumerate(zip(self.begin[often].tolist(), self.n[often].tolist(), strict=True)):
            self.common[i, self.docs[lo : lo + n]] = self.impact[lo : lo + n]
        # The same by document, each one's terms in order (of 16 bits, numbers are sorted by radix).
        by = np.argsort(self.docs.astype(np.uint16) if len(self.ids) <= 1 << 16 else self.docs, kind="stable")
        self.doc_term, self.doc_impact = term[by], self.impact[by]
        self.doc_begin = np.append(0, np.cumsum(np.bincount(self.docs, minlength=len(self.ids))))
        self.asked = np.zeros(len(asked.terms), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """The scores of these documents for the terms that are marked, summed in the order of terms."""
        if not len(docs):
            return np.empty(0)
        at = list(zip(self.doc_begin[docs].tolist(), self.doc_begin[docs + 1].tolist(), strict=True))
        mine = np.flatnonzero(self.asked[np.concatenate([self.doc_term[a:b] for a, b in at])])
        impact = np.concatenate([self.doc_impact[a:b] for a, b in at])[mine]
        return np.bincount(np.searchsorted(np.cumsum([b - a for a, b in at]), mine, "right"), impact, len(docs))

    def reached(self, part: np.ndarray, k: int) -> float:
        """What k documents reach at least: the k-th of the greatest sums in groups of BLOCK_DOCS * GAP documents, or of all."""
        sums = np.maximum.reduceat(part, self.starts)
        sums = sums if len(sums) >= 4 * k else part
        return float(np.partition(sums, -k)[-k]) if len(sums) >= k else 0.0

    def common_sums(self, queries: list[np.ndarray]) -> np.ndarray:
        """For each of these queries (their terms) all documents' sums over the common terms."""
        wanted = np.zeros((len(queries), len(self.common)), np.float32)
        for i, terms in enumerate(queries):
            own = self.column[terms]
            wanted[i, own[own >= 0]] = 1
        return wanted @ self.common

    def best(self, terms: np.ndarray, k: int, score: np.ndarray, ids: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this shard's documents and of those that are known (scores, ids), best first. common: the query's row of
        common_sums(), where it is made."""
        floor = score[-1] if len(score) == k else 0.0
        if not self.n[terms].any() or self.top[terms].sum() * (1 + SLACK) < floor:
            return score, ids
        part = (self.common_sums([terms])[0] if common is None else common).astype(float)
        rare = terms[(self.column[terms] < 0) & (self.n[terms] > 0)]
        if len(rare):
            at = list(zip(self.begin[rare].tolist(), (self.begin[rare] + self.n[rare]).tolist(), strict=True))
            part += np.bincount(np.concatenate([self.docs[a:b] for a, b in at]), np.concatenate([self.impact[a:b] for a, b in at]), len(part))
        floor = max(floor, self.reached(part, k) * (1 - SLACK))
        found = np.flatnonzero((part * (1 + SLACK) >= floor) & (part > 0))
        if len(found) > k:
            found = found[part[found] * (1 + SLACK) >= np.partition(part[found], -k)[-k] * (1 - SLACK)]
        self.asked[terms] = True
        sums = self.scores(found)
        self.asked[terms] = False
        if len(found) > k:
            keep = sums >= np.partition(sums, -k)[-k]
            found, sums = found[keep], sums[keep]
        score, ids = np.append(score, sums), np.append(ids, self.ids[found])
        best = np.lexsort((ids, -score))[:k]
        return score[best], ids[best]


def _searched(asked, mean: float, k: int):
    """The function that searches a task's shards for a broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Asked = asked.value
        known = [(np.empty(0), np.empty(0, np.int64))] * len(block.qid)
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], block, mean)
                some = max(1, min(TOGETHER, CELLS // max(1, len(shard.ids))))
                for lo in range(0, len(block.qid), some):
                    queries = [block.term[a:b] for a, b in pairwise(block.cuts[lo : lo + some + 1])]
                    for q, (terms, sums) in enumerate(zip(queries, shard.common_sums(queries), strict=True), lo):
                        known[q] = shard.best(terms, k, *known[q], sums)
        for lo in range(0, len(known), 1000):
            some = known[lo : lo + 1000]
            qids = np.repeat(block.qid[lo : lo + 1000], [len(s) for s, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(qids), *(pa.array(np.concatenate([x[j] for x in some])) for j in (1, 0))], ["qid", "id", "score"])

    return run


def _blocks(asked: DataFrame, block_terms: int) -> int:
    """Into how many hash classes of queries to part the asked terms so that none has many more than block_terms beside its longest query."""
    n = max(1, -(-asked.count() // block_terms))
    while True:
        sizes = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(n)).alias("block"), "qid").count().groupBy("block").agg(F.sum("count").alias("n"), F.max("count").alias("one"))
        worst = sizes.select(F.max(F.when(F.col("n") > F.col("one") + 2 * block_terms, F.col("n")))).first()[0]
        if not worst:
            return n
        n *= 2


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """queries (qid, text) against docs: rows (qid, rank, doc_id, score), exact."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, shard_bytes)
    shards = index.where("term is null")
    n, words = shards.agg(F.sum("df"), F.sum("words")).first()
    if not n:
        return spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
    mean = max(words, 1) / n
    asked = written(query_terms(queries, index, n), "queries")
    lists = shards.select("ids", "lengths", "terms", "ends", "docs", "counts")
    by_score = W.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    n_blocks, parts = _blocks(asked, block_terms), []
    for i in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == i).toArrow()  # about block_terms rows, or one query's
        if not mine.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Asked(mine))
        found = lists.mapInArrow(_searched(sent, mean, k), "qid long, id long, score double")
        best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        parts.append(written(best.select("qid", "rank", F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "score"), "found"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "qid long, rank int, doc_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
