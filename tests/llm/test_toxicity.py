"""The non-negative risk against finite differences and a plain sum, the prior, and answers that more steps don't change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import toxicity
from skein.llm.common import held_out, table


def test_risk_and_gradient():
    r = np.random.default_rng(3)
    x_p, x_u = np.hstack([r.random((9, 4)), np.ones((9, 1))]), np.hstack([r.random((30, 4)), np.ones((30, 1))])
    for prior in (0.1, 0.7):
        w = r.normal(size=5)
        positive, negative, g_positive, g_negative = toxicity.nn_risk(w, x_p, x_u, prior)
        plus = sum(np.log(1 + np.exp(-(x @ w))) for x in x_p) / 9
        minus = sum(np.log(1 + np.exp(x @ w)) for x in x_u) / 30 - prior * sum(np.log(1 + np.exp(x @ w)) for x in x_p) / 9
        assert np.allclose([positive, negative], [prior * plus, minus])
        for i in range(5):
            e = np.zeros(5)
            e[i] = 1e-6
            up, down = toxicity.nn_risk(w + e, x_p, x_u, prior), toxicity.nn_risk(w - e, x_p, x_u, prior)
            assert np.allclose([(up[k] - down[k]) / 2e-6 for k in (0, 1)], [g_positive[i], g_negative[i]], atol=1e-6)


def test_prior():
    r = np.random.default_rng(1)
    features = lambda n, toxic: (r.random((n, 6)) < np.where(toxic[:, None], 0.7, 0.01)).astype(np.float32)
    x_p, x_u = features(300, np.ones(300, bool)), features(5000, r.random(5000) < 0.08)
    assert 0.05 < toxicity.class_prior(x_p, x_u, 0.3) < 0.095 and toxicity.class_prior(x_p, x_u, 0.02) == 0.02
    none = np.zeros((4, 0), np.float32)
    assert toxicity.class_prior(none, none, 0.2) == 0.2


@pytest.mark.parametrize("sf,clean,toxic", [("sf0.001", 0, 0), ("sf0.01", 0, 3), ("sf0.1", 4, 12)])
def test_more_steps_change_nothing(spark, monkeypatch, sf, clean, toxic):
    """Held-out documents on the wrong side are few, and four times the steps call the same documents toxic."""
    d = f"/root/testdata/{sf}"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    train, seen = toxicity.train_nnpu, {}

    def once(x_p, x_u, prior):
        seen["short"], seen["long"] = train(x_p, x_u, prior), train(x_p, x_u, prior, steps=6400, settled=0.0)
        z = lambda w: np.hstack([x_u, np.ones((len(x_u), 1))]) @ w >= 0
        seen["differ"] = int((z(seen["short"]) != z(seen["long"])).sum())
        return seen["short"]

    monkeypatch.setattr(toxicity, "train_nnpu", once)
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    wrong = got.join(labels, "doc_id").where(held_out(F.col("doc_id")) & (F.col("predicted") != F.col("toxic"))).select("predicted").collect()
    assert sum(x.predicted for x in wrong) <= clean and sum(1 - x.predicted for x in wrong) <= toxic
    assert seen["differ"] <= 0.001 * docs.count() and got.where("predicted = 1").count() <= 0.2 * docs.count()


def test_pipeline_keeps_clean_documents_with_few_positives(spark):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").count() > 0.8 * docs.count()
