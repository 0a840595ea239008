"""Search against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from brookline.llm import bm25

WORD = re.compile(r"[^\W_]+")


def brute(docs, queries, k=bm25.TOP):
    bags = [(d, WORD.findall((t or "").lower())) for d, t in docs]
    n, mean, df = len(bags), max(1, sum(len(b) for _, b in bags)) / max(1, len(bags)), {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    out = []
    for q, t in queries:
        words = WORD.findall((t or "").lower())
        chosen = {w for w in words if w in idf}
        scored = []
        for d, b in bags:
            s = 0.0
            for w in sorted(chosen):
                tf = b.count(w)
                if tf:
                    s += idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
            if s:
                scored.append((-round(s, 9), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def rounded(df):
    """Rows with ranks made anew on rounded scores, as the brute force ranks."""
    rows = {}
    for r in df.collect():
        rows.setdefault(r.qid, []).append((-round(r.score, 9), r.doc_id))
    return sorted((q, i + 1, d, -s) for q, v in rows.items() for i, (s, d) in enumerate(sorted(v)))


def test_search_matches_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{int(r.expovariate(0.02))}" for _ in range(400)] + ["Über", "naïve", "日本", "x1"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "under_score,comma;w1")]
    queries = [(i, t) for i, t in docs if i % 10 == 0] + [(5000, "w1 w2 w3 nowhere"), (5001, "nowhere"), (5002, None)]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, term string, shard int").repartition(5)
    got = bm25.search(frame, spark.createDataFrame(queries, "qid long, text string"), block_terms=500, shard_bytes=4000)
    assert rounded(got) == sorted(brute(docs, queries))


def test_wand_skips_only_what_cannot_win(monkeypatch):
    """Of random shards, the blocks that are left out hold none of the k best, whatever the floor."""
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    monkeypatch.setattr(bm25, "GAP", 1)
    r, skipped = random.Random(9), 0
    for _ in range(60):
        texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 150))]
        ids = np.arange(len(texts)) * 7 % 1009
        row = next(bm25.shard_rows(ids, pa.array(texts, pa.large_string()), 0)).to_pylist()[0]
        terms = sorted({w for t in r.sample(texts, min(3, len(texts))) for w in t.split()})
        if not terms:
            continue
        asked = bm25.Asked(pa.table({"qid": [1] * len(terms), "term": terms, "idf": [r.random() + 0.1 for _ in terms]}))
        mean = max(1, sum(len(t.split()) for t in texts)) / len(texts)
        shard, total = bm25.Shard(row, asked, mean), []
        for d, t in zip(ids.tolist(), texts, strict=True):
            words, score = t.split(), 0.0
            for w, idf in zip(asked.terms, asked.idf, strict=True):
                if words.count(w):
                    score += idf * words.count(w) * 2.2 / (words.count(w) + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if score:
                total.append((-score, d))
        k = r.choice([1, 3, 10])
        want = sorted(total)[:k]
        plain = lambda got: [(round(-s, 9), d) for s, d in zip(*(x.tolist() for x in got), strict=True)]
        near = lambda rows: [(round(s, 9), d) for s, d in rows]
        none = np.empty(0), np.empty(0, np.int64)
        got = plain(shard.best(asked.term, k, *none))
        assert [s for s, _ in got] == [s for s, _ in near(want)]
        assert set(got) <= set(near(total))
        if want:
            known = np.full(k, -want[len(want) // 2][0]), np.full(k, 10**6)  # k better ids than half of them
            merged = sorted([*total, *((-s, d) for s, d in zip(*(x.tolist() for x in known), strict=True))])[:k]
            assert [s for s, _ in plain(shard.best(asked.term, k, *known))] == [round(s, 9) for s, _ in merged]
            bound = np.bincount(shard.block, shard.most, shard.n_blocks)
            skipped += int((bound < -want[-1][0]).sum()) if len(want) == k else 0
    assert skipped > 50  # the bounds do leave blocks out


def test_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = [x for x in rows if x[0] % 100 == 0]
    got = bm25.search(docs, docs.where("doc_id % 100 = 0").selectExpr("doc_id as qid", "text"))
    assert rounded(got) == sorted(brute(rows, queries))


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (None, "red fox"), (2, "blue")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "fox")], "qid long, text string")
    assert [(r.rank, r.doc_id) for r in bm25.search(docs, queries).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, None)]
    assert bm25.search(docs.limit(0), queries).count() == 0 and bm25.search(docs, queries.limit(0)).count() == 0


def test_all_terms_of_a_long_query_count(spark):
    """Document 1 shares only words of the query beyond its 16 strongest, the others one or two of the strongest."""
    strong, weak = [f"a{i}" for i in range(16)], [f"b{i}" for i in range(20)]
    docs = [(1, " ".join(weak)), (2, "a0 " + " ".join(f"c{i}" for i in range(19)))] + [(10 + i, f"d{i} {strong[i]}") for i in range(16)]
    query = [(7, " ".join(strong * 2 + weak))]
    got = bm25.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(query, "qid long, text string"))
    assert rounded(got) == brute(docs, query) and rounded(got)[0][2] == 1


def test_common_terms_are_summed_for_many_queries_at_once(monkeypatch):
    """Long queries of common words: the long posting lists are a matrix, and what it leaves to single lists is short; results
    are those of plain sums in double precision, ties too."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(300)], k=r.randint(1, 80))) for _ in range(900)]
    texts += texts[:50]
    row = next(bm25.shard_rows(np.arange(950), pa.array(texts, pa.large_string()), 0)).to_pylist()[0]
    queries = [(q, sorted(set(texts[q].split()))) for q in range(0, 950, 19)]
    df = {w: sum(w in t.split() for t in texts) for w in words}
    rows = [(q, w, np.log1p((950 - df[w] + 0.5) / (df[w] + 0.5))) for q, own in queries for w in own]
    asked = bm25.Asked(pa.table({n: list(c) for n, c in zip(("qid", "term", "idf"), zip(*rows, strict=True), strict=True)}))
    mean = sum(len(t.split()) for t in texts) / 950
    shard, lists = bm25.Shard(row, asked, mean), [asked.term[a:b] for a, b in zip(asked.cuts[:-1], asked.cuts[1:], strict=True)]
    left = sum(int(shard.n[t][shard.column[t] < 0].sum()) for t in lists)
    assert left * 10 < sum(int(shard.n[t].sum()) for t in lists)
    none = np.empty(0), np.empty(0, np.int64)
    for terms, sums in zip(lists, shard.common_sums(lists), strict=True):
        shard.asked[terms] = True
        plain = shard.scores(np.arange(950))
        shard.asked[terms] = False
        want = np.lexsort((shard.ids, -plain))[: bm25.TOP]
        for got in (shard.best(terms, bm25.TOP, *none, sums), shard.best(terms, bm25.TOP, *none)):
            assert got[0].tolist() == plain[want].tolist() and got[1].tolist() == shard.ids[want].tolist()
