"""Token files against the tokenizer itself, by a round trip, and what a search reads of them."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from brookline.llm import token_files as tf
from pyarrow import orc
from tokenizers import Tokenizer

PATH = public_tokenizers.path(tf.VOCABULARY)
SIGNS = list("abzXY 019  '\"().,-_$\n\n\t\r\x0b\x0c\x1c\x00\x7f") + ["'s", "'ll", "don't", "é", "é", "日本", "²", " ", "\u0085", " ", "　", "​", "👩‍👩", "<|endoftext|>", "<|", "٣"]


def reference(texts):
    return [e.ids + [tf.END_ID] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_coder_gives_the_tokenizers_ids():
    r = random.Random(5)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 25))) for _ in range(8000)]
    texts += [f"a{chr(i)}  b{chr(i)} {chr(i)}c" for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    coder = tf.PieceCoder(PATH, cache_bytes=50_000)  # generations change on the way
    for _ in range(2):
        got = []
        for lo in range(0, len(texts), 700):
            flat, at = coder.encode(pa.array(texts[lo : lo + 700]))
            got += [flat[a:b].tolist() + [tf.END_ID] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == reference(texts)


def check(rows, docs):
    """rows against (doc_id, text) in the order that the files should have."""
    at = 0
    rows = sorted(rows, key=lambda r: r.start)
    for r, (doc, _), ids in zip(rows, docs, reference([t for _, t in docs]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_whole_table(spark, sf_dir):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), tf.scratch(spark)
    tf.write_ids(docs, path, PATH, files=3)
    check(tf.digests(tf.read_ids(spark, path)).collect(), sorted((r.doc_id, r.text) for r in docs.collect()))
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/ids/*.orc"))
    last = -1
    for f in files:  # ascending within files and from file to file
        own = orc.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert own == sorted(own) and own[0] > last
        last = own[-1]


def test_odd_rows(spark):
    docs = [(3, None), (1, "same"), (1, "same"), (None, "x y"), (2, ""), (None, "zz"), (7, "long " * 50_000), (-4, " \n <|endoftext|>")]
    df, path = spark.createDataFrame([(i, t, 5, "q") for i, t in docs], "doc_id long, text string, ids int, file string"), tf.scratch(spark)
    tf.write_ids(df.repartition(4), path, PATH)
    got = tf.digests(tf.read_ids(spark, path)).collect()
    nulls = sorted((r for r in got if r.doc_id is None), key=lambda r: r.start)
    texts = {zlib.crc32(np.array(ids, "<u4").tobytes()): t for t, ids in zip(("x y", "zz"), reference(("x y", "zz")), strict=True)}
    check(got, [(None, texts[r.ids_crc32]) for r in nulls] + sorted(d for d in docs if d[0] is not None))
    empty = tf.scratch(spark)
    tf.write_ids(df.limit(0), empty, PATH)
    assert tf.digests(tf.read_ids(spark, empty)).collect() == []


def scanned(df):
    """Rows that the scan of the ids gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan().toString()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        while "QueryStage" in p.nodeName():
            p = p.plan()
        if p.nodeName().startswith("Scan orc") and "before#" in p.toString():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert found, node
    return max(found)


def test_searches_prune_row_groups_and_stripes(spark, monkeypatch):
    monkeypatch.setattr(tf, "STRIPE_BYTES", 1 << 16)
    r = random.Random(2)
    docs = spark.createDataFrame([(i * 2, " ".join(str(r.random()) for _ in range(12))) for i in range(30_000)], "doc_id long, text string")
    path = tf.scratch(spark)
    tf.write_ids(docs, path, PATH, files=2)
    files = glob.glob(f"{path.removeprefix('file:')}/ids/*.orc")
    assert len(files) == 2 and all(orc.ORCFile(f).nstripes > 3 for f in files)
    assert tf.read_ids(spark, path).count() == 30_000
    one = tf.read_ids(spark, path, doc_ids=[20_000])
    assert [r.doc_id for r in one.collect()] == [20_000] and scanned(one) <= 2 * tf.GROUP_ROWS
    assert scanned(tf.read_ids(spark, path, doc_ids=[20_001])) == 0  # between a row group's ends, but not in its Bloom filter
    few = tf.read_ids(spark, path, first=100, last=300)
    assert few.count() == 101 and scanned(few) <= 2 * tf.GROUP_ROWS
    whole = {x.doc_id: x.ids for x in tf.read_ids(spark, path).where("doc_id < 600").collect()}
    assert all(x.ids == whole[x.doc_id] for x in few.collect())
