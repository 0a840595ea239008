"""Importance resampling against a plain version, with many ranges, runs and rounds of merging."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brookline.llm import importance as im


def features(text, order=1):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets=10_000, order=1, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in features(x, order)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, order)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    wanted = percent * len(ranked) // 100
    rank = {id(r): n for n, r in enumerate(ranked[:wanted], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def same(got, want):
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_table(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    same(im.resample(docs, target).collect(), want)


@pytest.mark.parametrize("percent", [0, 1, 50, 99, 100])
def test_many_ranges_runs_and_rounds(spark, monkeypatch, percent):
    """Ranges of a few rows, runs of 40, blocks of 3, merged four at a time; copies under one id; null ids; ties."""
    for name, value in (("RANGE_ROWS", 60), ("RUN_ROWS", 40), ("BLOCK_ROWS", 3), ("FAN_IN", 4)):
        monkeypatch.setattr(im, name, value)
    r = random.Random(7)
    words = ["alpha", "beta", "Gamma", "naïve", "x1", "delta"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 19, 20, 25])))) for i in range(700)]
    docs += [(5, docs[5][1])] * 150 + [(None, "alpha " * 22)] * 20 + [(9000, None), (9001, ""), (9002, "--- ... !!!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = im.resample(df, spark.createDataFrame([("alpha beta",)], "text string"), percent=percent).collect()
    want = plain(docs, ["alpha beta"], percent=percent)
    same([x[:4] for x in got], [x[:4] for x in want])
    # Rows that are alike in score and id take any order among themselves.
    same([(x.score, x.rank) for x in got], [(x[3], x[4]) for x in want])
    assert sorted(x.rank for x in got if x.rank) == list(range(1, sum(x[4] is not None for x in want) + 1))


def test_runs_of_words(spark):
    docs = [(1, "One two  three; one TWO"), (2, "é two 3"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = im.resample(df, spark.createDataFrame([("one two three",)], "text string"), order=3, buckets=50, min_words=2, percent=60).collect()
    same(got, plain(docs, ["one two three"], buckets=50, order=3, min_words=2, percent=60))


def test_buckets_of_slices_and_odd_texts():
    texts = ["x", None, "", "Äa-b c", "..", "word"]
    for lo in range(3):
        found, at, n = im.buckets_of(pa.array(texts).slice(lo), 1 << 40)
        want = [[zlib.crc32(w.encode()) for w in features(t)[0]] for t in texts[lo:]]
        assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want and n.tolist() == list(map(len, want))


def test_loser_tree():
    r = random.Random(1)
    for k in range(1, 12):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(im.LoserTree([iter([(x, x) for x in run]) for run in runs])) == sorted(x for run in runs for x in run)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(i, "w " * 30, 1, i) for i in range(40)], "doc_id long, text string, score int, rank int")
    target = spark.createDataFrame([("w",)], "text string")
    assert sum(r.rank is not None for r in im.resample(df, target).collect()) == 4
    assert im.resample(df.limit(0), target).collect() == []
    assert im.resample(df, target.limit(0)).count() == 40


def test_ranges_follow_keys():
    cuts = im.Cuts(np.array([9, 5]), np.array([1, 4]))
    rows = np.zeros(5, im.ROW)
    rows["score"], rows["doc_id"] = [9, 9, 5, 5, 1], [1, 2, 4, 5, 0]
    assert cuts.ranges(rows).tolist() == [0, 1, 1, 2, 2]
