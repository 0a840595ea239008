"""The pipeline against a plain version of its stages on the smallest tables."""

import hashlib

import corpus_pipeline as cp
import public_tokenizers
from brookline.llm import mixing, packing, quality
from brookline.llm.common import table
from tokenizers import Tokenizer

from .test_dedup import brute_components, brute_exact
from .test_packing import check_pieces


def plain_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = [r for r in docs.collect() if model.score(quality.np.array([quality.features(r.text)]))[0] >= quality.THRESHOLD]
    keep = {d for d, k, *_ in brute_exact([(r.doc_id, r.text) for r in rows]) if d == k}
    rows = [r for r in rows if r.doc_id in keep]
    keep = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in rows]) if d == c}
    rows = [r for r in rows if r.doc_id in keep]
    chance = {r.doc_id: r.probability for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    rows = [r for r in rows if int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 2**52 < chance[r.doc_id]]
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}


def test_pipeline_matches_a_plain_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(got.collect(), plain_run(spark, sf_dir))


def test_stages_return_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= n
        n = docs.count()


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "A text of some words, which is fine.", "en", "s", 9), (None, None, "en", None, 9),
    (4, "word " * 30_000, "de", None, 5), (4, "word " * 30_000, "de", None, 5), (5, "word " * 29_999 + " word", "de", "x", 5), (6, "Another text, which repeats an id.", None, "s", 1), (6, "And one more text with that id.", None, "s", 1),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids: whole rows against plain versions."""
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    score = quality.learn(docs, table(spark, sf_dir, "labels")).score
    good = [r for r in ODD if score(quality.np.array([quality.features(r[1])]))[0] >= quality.THRESHOLD]
    assert rows(cp.quality_stage(spark, docs, sf_dir)) == sorted(good, key=str)
    distinct = [ODD[0], ODD[3], ODD[5], ODD[8], ODD[9]]  # of equal texts the longest, then the smallest id, null last
    assert rows(cp.exact_stage(spark, docs, sf_dir)) == sorted(distinct, key=str)
    assert rows(cp.near_stage(spark, docs, sf_dir)) == sorted(distinct, key=str)
    drawn = lambda r: int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) / 2**52
    want = [tuple(r)[:5] for r in mixing.mix(docs).select(*docs.columns, "probability").collect() if drawn(r) < r.probability]
    assert rows(cp.mixing_stage(spark, docs, sf_dir)) == sorted(want, key=str)
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = cp.packing_stage(spark, docs, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    ends = sorted((r.sequence_id * packing.WINDOW + r.offset, r.length) for r in pieces)
    assert [a for a, _ in ends] == [0, *(a + n for a, n in ends)][:-1]


def test_stages_on_an_empty_table_and_clashing_columns(spark, sf_dir):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    more = docs.selectExpr("*", "1 as _quality_score", "1 as quality_score", "12 as row_key", "13 as key", "14 as n", "2 as sha", "3 as fp", "4 as component_id", "5 as tokens", "6 as topic", "7 as probability", "8 as sampled", "9 as cell_lang", "10 as keep_id", "11 as part")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if name != "packing":
            plain, clash = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
            assert clash.columns == more.columns, name
            assert sorted(map(tuple, clash.select(*docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
            assert clash.select(*more.columns[5:]).distinct().count() <= 1, name  # the other columns keep their values


def test_dedup_stages_decide_by_row(spark, sf_dir):
    a, b, c = ("alpha river stone green walks over hills", "quick market numbers fell by nine percent today", "seven cooks boil a soup of leek and barley")
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, ""), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, a), (5, b), (7, ""), (None, c)]
    for stage in (cp.exact_stage, cp.near_stage):
        got = [(r.doc_id, r.text or "") for r in stage(spark, docs, sf_dir).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), stage.__name__
