import numpy as np
import pytest
from support import SF
from llm_data import ODD
from pyspark.sql import functions as F

from pixelframe.llm import pu

BIG = SF.parent / "sf0.01"


def test_features_are_finite_and_of_one_size():
    for _, text, _ in ODD:
        x = pu.features_of(None if text is None else text.encode())
        assert x.shape == (pu.N_FEATURES,) and np.isfinite(x).all()


def test_prior_and_risk_on_made_data():
    """Two Gaussians: the prior is near the truth, and the fit separates them without a negative label."""
    r = np.random.default_rng(0)
    good = lambda n: r.normal(1.5, 1, (n, 3))
    bad = lambda n: r.normal(-1.5, 1, (n, 3))
    for prior in (0.3, 0.7, 0.9):
        u = np.vstack([good(int(4000 * prior)), bad(int(4000 * (1 - prior)))])
        model = pu.fit(good(3000), u)
        assert abs(model.prior - prior) < 0.08
        assert (model.scores(good(1000)) > 0.5).mean() > 0.95 and (model.scores(bad(1000)) < 0.5).mean() > 0.9


def test_nothing_to_learn_from(spark, docs_of):
    model = pu.fit(np.zeros((0, pu.N_FEATURES)), np.zeros((0, pu.N_FEATURES)))
    assert [r.score for r in pu.score(pu.features(docs_of(ODD)), model).collect()] == [0.5] * len(ODD)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert pu.score(pu.features(docs_of([])), pu.train(pu.features(docs_of([])), labels)).count() == 0


def test_odd_rows(spark, docs_of):
    import zlib

    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (5, 1, None), (None, 1, 0), (5, 1, None), (10, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(ODD)
    described = pu.features(docs)
    model = pu.train(described, labels)
    got = pu.score(described, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = pu.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    again = pu.train(pu.features(docs.repartition(3)), labels)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_held_out_labels_and_extra_columns_do_not_matter(spark, docs_of):
    rows = [(i, ("good words in a row, as they come. " * (i % 7 + 3)) if i % 4 else "BAD!! " * (i % 9 + 5), "a") for i in range(200)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)]
    one = pu.train(pu.features(docs_of(rows)), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    flipped = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("quality", F.when(pu.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    two = pu.train(pu.features(docs_of(rows, clash=False).withColumn("source", F.lit("z"))), flipped)
    assert np.array_equal(one.weights, two.weights)


@pytest.mark.skipif(not BIG.exists(), reason="no test tables")
def test_query_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(str(BIG / f"{t}.parquet")) for t in ("documents", "labels"))
    described = pu.features(docs)
    got = pu.score(described, pu.train(described, labels)).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got)
    kept = [r.predicted for r in got if r.quality == 1]
    assert len(got) > 50 and right / len(got) >= 0.93 and sum(kept) / len(kept) >= 0.97


def test_gradient_is_that_of_the_risk():
    """Numerically, on both sides of the point where the negative part is zero."""
    r = np.random.default_rng(1)
    p, u = (pu.scaled(r.normal(m, 1, (300, 4)), np.zeros(4), np.ones(4)) for m in (0.8, 0.0))
    signs = set()
    for w in (r.normal(0, 0.1, 5), r.normal(0, 2, 5), np.array([2.0, 2, 2, 2, 0])):
        for prior in (0.2, 0.95):
            vp, vu = p.astype(float) @ w, u.astype(float) @ w
            negative = np.logaddexp(0, vu).mean() - prior * np.logaddexp(0, vp).mean()
            signs.add(bool(negative < 0))

            def value(w):
                vp, vu = p.astype(float) @ w, u.astype(float) @ w
                part = np.logaddexp(0, vu).mean() - prior * np.logaddexp(0, vp).mean()
                shrink = 0.005 * w[:-1] @ w[:-1]
                return (-part if negative < 0 else prior * np.logaddexp(0, -vp).mean() + part) + shrink

            eye = np.eye(5) * 1e-5
            want = [(value(w + d) - value(w - d)) / 2e-5 for d in eye]
            assert np.allclose(pu.risk_gradient(w, p, u, np.full(300, 1 / 300), prior, 0.01)[1], want, atol=2e-4)
    assert signs == {True, False}


def test_repeated_rows_of_one_id_are_one_of_the_sample(spark, docs_of):
    """Rows of a sampled id neither fill the sample nor empty the other side of it."""
    rows = [(1, "all rows say this. " * 20, "a")] * 3000 + [(i, ("good words as they come, in order. " * 9) if i % 2 else "BAD!! $$ " * 9, "a") for i in range(2, 400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 400)], "doc_id bigint, quality int, toxic int")
    described = pu.features(docs_of(rows))
    n, near = 3398, 399
    ids = pu._sampled(described.select("doc_id"), near, 50, 7).collect()
    assert len(ids) == len(set(ids)) == 50 and n == described.count()
    model = pu.train(described, labels, sample=1000)
    got = {r.doc_id: r.predicted for r in pu.score(described, model).collect()}
    assert len({got[i] for i in range(2, 400)}) == 2 and sum(got[i] == i % 2 for i in range(2, 400)) > 380
