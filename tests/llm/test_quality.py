"""The quality classifier by held-out accuracy, and its odd cases."""

import zlib

import numpy as np
from brookline.llm import quality as q


def auc(good, bad):
    both = np.concatenate([good, bad])
    rank = both.argsort().argsort()[: len(good)]
    return (rank.sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = q.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = (np.array([r.score for r in held if r.quality == k]) for k in (1, 0))
    assert auc(good, bad) > 0.99
    assert (good >= 0.7).mean() > 0.99 and (bad < 0.7).mean() > 0.95


def test_prior_estimate():
    r = np.random.default_rng(0)
    pos = r.normal(1, 1, 4000)
    for share in (0.3, 0.8):
        unl = np.where(r.random(4000) < share, r.normal(1, 1, 4000), r.normal(-3, 1, 4000))
        assert abs(q.estimated_prior(pos, unl) - share) < 0.08


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "some text", 9.0), (2, "", 9.0), (3, "x " * 200_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert q.classify(docs.limit(0), labels).count() == 0


def test_scores_are_those_of_a_plain_pass(spark):
    """The distributed scores against a plain forward pass, text by text."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = q.learn(docs, labels)
    w, b, v, c = model.net.p
    for r in q.classify(docs, labels).join(docs, "doc_id").orderBy("doc_id").limit(200).collect():
        x = (np.array(q.features(r.text)) - model.net.mean) / model.net.scale
        z = sum(v[j] * np.tanh(sum(min(8, max(-8, x[i])) * w[i, j] for i in range(len(x))) + b[j]) for j in range(len(v))) + c[0]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.7)


def test_held_out_labels_do_not_matter(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", q.F.when(q.held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    score = lambda got: {r.doc_id: r.score for r in got.collect()}
    assert score(q.classify(docs, labels)) == score(q.classify(docs, turned))


def test_a_few_positives_are_learnt_from(spark):
    """No least number of labels: scores part from the few on, and only without any they are all alike."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = labels.where("quality = 1").where(~q.held_out(q.F.col("doc_id"))).orderBy("doc_id")
    for n in (0, 1, 19, 21):
        scores = [r.score for r in q.classify(docs, few.limit(n)).collect()]
        assert (len(set(scores)) > 1) == (n > 0) and all(0 <= s <= 1 for s in scores)


def test_no_feature_jumps_with_the_number_of_words():
    texts = [" ".join(f"w{i}" for i in range(n)) + " w0" for n in (18, 19, 20, 21)]
    steps = np.abs(np.diff([q.features(t) for t in texts], axis=0))
    assert steps.max() < 0.05
