"""Packing against the tokenizer itself and by an exact round trip."""

import zlib

import numpy as np
import public_tokenizers
from brookline.llm import packing as pk
from tokenizers import Tokenizer

PATH = public_tokenizers.path(pk.VOCABULARY)
ODD = ["", None, "Hello, World!! it's 'tis don't 42nd x_y", "ΟΔΟΣ ΣΊΣΥΦΟΣ Σ.", "İstanbul ét́ ́x café", "a b c\x1cd\x85e", "<|endoftext|> a<|startoftext|>b", "日本語 mixed文字 123.45%", "Word's WORD'S WoRd, Mixed; ###", "ǅ ǅungla ﬁne ﬀ Ⅷ ²³ x²", "𝔘nicode 👩‍👩‍👧 zero​width", "word " * 9000, "Ångström Ångström", "naïve, Über. ÜBER"]


def reference(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_coder_gives_the_tokenizers_ids(spark, sf_dir):
    texts = ODD[:1] + ODD[2:] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    coder = pk.WordCoder(PATH)
    for _ in range(2):  # learned, then known
        assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(texts)] == reference(texts)


def check_pieces(rows, ids):
    """Round trip: pieces rebuild each document, sequences have no gap, and all but the last are full."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or s == len(by_seq) - 1 and at <= 2048


def test_pack_round_trip(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string").repartition(3)
    got = pk.pack(docs, PATH).collect()
    check_pieces(got, {i: x + [1] for i, x in enumerate(reference(ODD))})


def test_pack_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    check_pieces(pk.pack(docs, PATH).collect(), {r.doc_id: x + [1] for r, x in zip(rows, reference([r.text for r in rows]), strict=True)})


def test_pack_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    got = pk.pack(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == sorted([(1, len(reference(["same"])[0]) + 1)] * 2 + [(-1, 1)])
    assert pk.pack(docs.limit(0), PATH).count() == 0
