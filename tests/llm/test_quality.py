import numpy as np

from loomstat.llm import quality as op


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = op.score_documents(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert out.count() == docs.count()
    assert out.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.7)").count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, op.score_documents(docs.repartition(3), labels).collect()))


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    pos = rng.normal(1, 1, (4000, op.FEATURES))
    unl = np.concatenate([rng.normal(1, 1, (2400, op.FEATURES)), rng.normal(-1, 1, (1600, op.FEATURES))])
    rng.shuffle(unl)
    model = op.fit(pos, unl)
    assert abs(model.prior - 0.6) < 0.08
    assert (model.score(rng.normal(1, 1, (500, op.FEATURES))) > 0.7).mean() > 0.95
    assert (model.score(rng.normal(-1, 1, (500, op.FEATURES))) < 0.3).mean() > 0.95


def test_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "x", 1), (2, "", 0), (2, "", 0), (3, "w " * 100000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in op.score_documents(docs, labels).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert op.score_documents(docs, labels).count() == 5
    assert op.score_documents(docs.limit(0), labels).count() == 0


def test_steps_are_the_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    for shift, prior in ((0.0, 0.4), (-4.0, 0.7), (3.0, 0.5), (-6.0, 0.9)):
        zp, zu = rng.normal(2, 1, 7), rng.normal(shift, 1, 9)
        total = lambda a, b, prior=prior: sum(op.risk(a, b, prior)) if op.risk(zp, zu, prior)[1] >= 0 else -op.risk(a, b, prior)[1]
        for own, got, put in ((zp, op.risk_step(zp, zu, prior)[0], lambda x: (x, zu)), (zu, op.risk_step(zp, zu, prior)[1], lambda x: (zp, x))):
            for i in range(len(own)):
                e = np.zeros(len(own))
                e[i] = 1e-5
                assert abs((total(*put(own + e)) - total(*put(own - e))) / 2e-5 - got[i]) < 1e-8
    assert op.risk(zp, zu, prior)[1] < 0 <= op.risk(np.zeros(3), np.zeros(3), 0.5)[1]  # both branches were met
    written_out = 0.4 * sum(np.log(1 + np.exp(-z)) for z in zp) / 7, sum(np.log(1 + np.exp(z)) for z in zu) / 9 - 0.4 * sum(np.log(1 + np.exp(z)) for z in zp) / 7
    assert np.allclose(op.risk(zp, zu, 0.4), written_out)


def test_one_id_with_texts_held_out_and_not(spark):
    """An id decides for all of its rows; other texts of a labelled id are positives as well."""
    docs = spark.createDataFrame([(k % 50, f"text {k} of some words " * (1 + k % 4)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    out = op.score_documents(docs, labels)
    assert out.count() == 200 and out.groupBy("doc_id").agg({"held_out": "max"}).count() == 50
    assert out.select("doc_id", "held_out").distinct().count() == 50 and 0 < out.where("held_out").count() < 200
