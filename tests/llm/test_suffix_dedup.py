"""Repeated substrings against brute force, and the merge against sorting."""

import hashlib
import random

import pytest
from brookline.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for d, t, *_ in rows:
        b, d = (t or "").encode(), sd.LAST if d is None else d
        for i in range(len(b) - sd.SPAN + 1):
            s = b[i : i + sd.SPAN]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - sd.SPAN + 1):
            if first[b[i : i + sd.SPAN]] < (sd.LAST if d is None else d):
                gone[i : i + sd.SPAN] = [True] * sd.SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


def passages(seed, alphabet):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [word(r.choice([30, 49, 50, 51, 52, 80, 200])) for _ in range(25)]
    texts = ["".join(r.choice([word(r.randint(0, 60)), r.choice(shared)]) for _ in range(r.randint(0, 9))) for _ in range(120)]
    texts += texts[:20] + [t[3:] + "x" for t in texts[20:40]]
    rows = [(r.randrange(10_000) if r.random() < 0.95 else None, t, "clash", 1) for t in texts]
    return rows + [(1, None, "c", 1), (2, "", "c", 1), (77, "a" * 400, "c", 1), (78, "b" + "a" * 300 + "c", "c", 1), (3, "é" * 40, "c", 1), (4, "x" + "é" * 40, "c", 1), (5, shared[0] * 3, "c", 1), (5, shared[0] * 3, "c", 1)]


SCHEMA = "doc_id long, text string, seg string, ids int"


@pytest.mark.parametrize(
    ("seed", "alphabet", "segment", "hot", "fan_bits"),
    [(1, "abcdefgh éß", 12 << 20, 50_000, 8), (2, "ab", 3_000, 50_000, 8), (3, "abcdefghijklmnopqrstuvwxyz \0", 700, 50_000, 2), (4, "abcdefgh \0", 2_000, 0, 1), (5, "ab", 12 << 20, 3, 6), (6, "abcdefghijklm", 700, 8, 1), (7, "ab ", 500, 8, 2)],
)
def test_matches_brute_force(spark, seed, alphabet, segment, hot, fan_bits):
    """One level of exchange, or up to six of them."""
    rows = passages(seed, alphabet)
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), segment_bytes=segment, hot=hot, fan_bits=fan_bits)
    assert result(got) == brute(rows)


def test_rows_of_the_exchange_grow_with_the_segments(spark):
    """Four times the segments make about four times the rows of hashes and of runs, on every level, not sixteen times."""
    r, counts = random.Random(5), {}
    line = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [line(200) for _ in range(40)]
    for n in (10, 40):
        texts = [line(300) + "".join(r.sample(shared, 8)) + line(300) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        held = sd.written(sd.segments(docs, "doc_id", "text", 2_500), "test")
        levels = sd.Levels(held.count(), 2)
        assert levels.segments >= n and levels.count >= 2
        levels.cuts = sd.sampled_cuts(held, levels)
        hashes = sd.hash_levels(held, levels)
        runs = sd.run_levels(held, sd.known_hashes(hashes, levels), levels)
        counts[n] = [[df.count() for df in kind] for kind in (hashes, runs)]
        assert all(c <= 8 * levels.segments * 4 for kind in counts[n] for c in kind)
        assert result(sd.remove_repeats(docs, segment_bytes=2_500, fan_bits=2)) == brute([(i, t) for i, t in enumerate(texts)])
    for few, many in zip(counts[10], counts[40], strict=True):
        assert max(many) <= 6 * max(few)


def test_anchors_are_shared_by_equal_spans():
    r = random.Random(3)
    shared = "".join(r.choice("abc d") for _ in range(90))
    texts = [("".join(r.choice("abc d") for _ in range(r.randint(0, 200))) + shared).encode() for _ in range(30)]
    ends = sd.np.cumsum([len(t) for t in texts], dtype="<i8")
    s = sd.Segment(sd.np.arange(30, dtype="<i8").tobytes(), ends.tobytes(), sd.zstandard.compress(b"".join(texts)))
    a, b = s.anchors(500), s.anchors()
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    mine = [set((b[0][b[1] == i] - s.ends[i]).tolist()) for i in range(30)]
    for lo in range(-90, -49):  # whatever span of the shared part is looked at, all documents have an anchor in common there
        assert {x for x in set.intersection(*mine) if lo <= x <= lo + sd.SPAN - sd.K}


def test_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sd.remove_repeats(docs)
    assert result(got) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.limit(50).collect())


def test_a_very_long_text_and_empty_tables(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(300_000))
    rows = [(9, long), (8, long[1000:1060]), (10, "q" + long[5000:90_000])]
    got = {x.doc_id: (x.n_removed, len(x.spans)) for x in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).collect()}
    assert got == {8: (0, 0), 9: (60, 1), 10: (85_000, 1)}
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_sorts_and_gives_common_prefixes():
    r = random.Random(6)
    for _ in range(100):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(sd.WIDTH - 60)) + b"z" * 60 for _ in range(r.randint(0, 20))}) for _ in range(r.randint(1, 9))]
        lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        coded = []
        for run in runs:
            common = bytes(lcp(a, b) for a, b in zip([b"", *run], run, strict=False))
            coded.append(sd.decoded(common, b"".join(x[c:] for x, c in zip(run, common, strict=True)), sd.WIDTH))
        got = list(sd.merge(coded))
        want = sorted((x, i) for i, run in enumerate(runs) for x in run)
        assert [(x, i) for i, _, x in got] == want
        assert [c for _, c, _ in got] == [lcp(a, b) for a, b in zip([b"", *(x for x, _ in want)], [x for x, _ in want], strict=False)]
