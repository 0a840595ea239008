"""SimHash and exact deduplication against brute force."""

import hashlib
import random

import pytest
import xxhash
from brookline.llm import exact_dedup as ed
from brookline.llm import simhash as sh
from brookline.llm.common import components

SCHEMA = "doc_id long, text string, sha string, fp long"


def odd_docs(seed=3):
    r = random.Random(seed)
    words = ["the", "river", "Stone", "über", "naïve", "x", "日本", "42"]
    texts = [None, "", " \t\n", "one", "one two", "a\tb c", "ab c", "a b\x0bc", " a\r\nbc ", "NBSP here", "NBSPhere"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    near = [t + " tail" for t in base[:15]]
    rows = [(i, t) for i, t in enumerate(texts + base + base[:10] + near + ["long " * 30_000])]
    rows += [(None, "one"), (None, "only null id"), (3, "one")]
    r.shuffle(rows)
    return [(i, t, "clash", 1) for i, t in rows]


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def test_simhash_matches_brute_force(spark):
    rows = odd_docs()
    got = sh.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_simhash_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sh.simhash_groups(docs).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("hot_from", [0, 3, 1 << 30])
def test_segments_fetch_every_pair_within_two_bits(spark, hot_from):
    """All pairs within two bits, whether segment values are split or not; others are fetched too, and rejected."""
    r = random.Random(1)
    fps = {0, 1, 3, 7, 1 << 63}
    for _ in range(30):
        x = r.getrandbits(64)
        fps |= {x, *(x ^ 1 << r.randrange(64) for _ in range(3)), *(x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(6))}
    fps |= {0xABCD0123 << 32 | r.getrandbits(32) for _ in range(60)}  # a hot segment value
    fps |= {r.getrandbits(32) << 32 | 0x77 ^ (i % 3 == 0) << 5 for i in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    distance = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {(x, y) for x in signed for y in signed if x < y and distance(x, y) <= 2}
    fetched = [(min(x.a, x.b), max(x.a, x.b)) for x in sh.candidates(frame, hot_from).collect()]
    assert want <= set(fetched)
    assert any(distance(x, y) > 2 for x, y in fetched) == (hot_from > 0)  # a split value's keys meet within two bits
    links = [tuple(x) for x in sh.near_links(frame, hot_from).collect()]
    assert len(links) == len(set(links)) and set(links) == want


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (None, 3)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {root[i] for i in range(61)} == {0} and {root[i] for i in range(1000, 1300)} == {1000} and {root[5000 + i] for i in range(3)} == {5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((d, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


def test_exact_dedup_matches_brute_force(spark):
    rows = odd_docs(5)
    got = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ed.exact_dedup(docs).count() == 0
    assert sh.simhash_groups(docs).count() == 0


@pytest.mark.parametrize("limit", [1, 3_000, 1 << 30])
def test_grace_splits_until_a_bucket_fits(limit):
    r = random.Random(2)
    rows = [(str(r.randrange(300)).encode() * 5, 1, r.randrange(9), r.randrange(1000)) for _ in range(3000)]
    want = {}
    for c, n, length, doc in rows:
        old = want.get(c, (0, -1, 0))
        best = min((-length, doc), (-old[1], old[2]))
        want[c] = (old[0] + n, -best[0], best[1])
    got = {e[1]: tuple(e[2:]) for e in ed.grace(iter(rows), limit=limit)}
    assert got == want


def test_simhash_broadcasts_nothing_that_grows_with_the_input(spark):
    """A fingerprint explodes to 34 probes and more, which Spark's estimates do not see: by them the probes of a small file were
    broadcast, however many they became."""
    from brookline.llm.common import written
    from pyspark.sql import functions as F

    fps = written(spark.range(2000).select(F.xxhash64("id").alias("fp")), "fps")
    plans = [sh.candidates(fps), sh.simhash_groups(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))]
    for df in plans:
        df.collect()
    met, groups = (df._jdf.queryExecution().executedPlan().toString() for df in plans)
    assert "SortMergeJoin [seg" in met and "BroadcastHashJoin" not in groups
    joins = [line for line in met.split("\n") if "BroadcastHashJoin [seg" in line]
    assert all("inner" not in line for line in joins)
