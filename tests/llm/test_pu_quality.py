import numpy as np
from pyspark.sql import functions as F

from wardenlog.llm import pu_quality as Q

from .edge import no_documents, odd_documents


def test_prior_and_risk_on_two_clusters():
    rng = np.random.default_rng(1)
    d = len(Q.FEATURES)
    positive = rng.normal(2, 1, (3000, d))
    unlabelled = np.concatenate([rng.normal(2, 1, (1800, d)), rng.normal(-2, 1, (1200, d))])[rng.permutation(3000)]
    prior = Q.estimate_prior(positive, unlabelled)
    assert abs(prior - 0.6) < 0.06
    net = Q.Network(np.concatenate([positive, unlabelled])).train(positive, unlabelled, prior)
    assert (net.scores(rng.normal(2, 1, (500, d))) > 0.5).mean() > 0.95
    assert (net.scores(rng.normal(-2, 1, (500, d))) < 0.3).mean() > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    net = Q.fit(odd_documents(spark), labels, F.lit(True))
    got = Q.score(odd_documents(spark), net).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert Q.score(no_documents(spark), net).count() == 0
    assert Q.fit(no_documents(spark), labels, F.lit(True)) is None
    assert {r.score for r in Q.score(odd_documents(spark), None).collect()} == {0.5}


def test_held_out_quality(spark):
    from wardenlog.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_pu_quality"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
