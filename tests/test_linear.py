"""Trained scanners: held-out accuracy, calibration, the gradient against plain numpy, and sentiment rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragweave import plans
from ragweave.operators import guards, linear

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "sf", "least"), [("toxicity_trained", "/root/testdata/sf0.1", 0.92), ("language_trained", SF, 0.95)])
def test_held_out_rows(spark, name, sf, least):
    """The most frequent label alone would be right for 0.88 of the one and 0.6 of the other."""
    rows = [r for r in plans.load().QUERIES[name](spark, sf).collect() if r.held_out and r.label is not None]
    right = np.array([r.label == r.predicted for r in rows])
    assert len(rows) > 200 and right.mean() >= least
    assert abs(np.mean([r.probability for r in rows]) - right.mean()) < 0.1


def test_gradient_equals_plain_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(map(int, rng.choice(linear.DIMS, rng.integers(0, 9), replace=False))), int(rng.integers(0, 3))) for _ in range(50)]
    weights = rng.normal(0, 0.1, (linear.DIMS + 1, 3)).astype(np.float32)
    used = rng.random(linear.DIMS) < 0.8
    got, n = linear._gradient(spark.createDataFrame(rows, "features array<int>, y int").repartition(5), weights, used)
    counts = linear._counts(spark.createDataFrame(rows, "features array<int>, y int"), 3)
    assert counts[-1].tolist() == [sum(y == c for _, y in rows) for c in range(3)] and counts[:-1].sum() == sum(len(at) for at, _ in rows)
    want = np.zeros(weights.shape)
    for at, y in rows:
        at = [a for a in at if used[a]]
        x = 1 / np.sqrt(max(1, len(at)))
        p = weights[-1] + x * weights[at].sum(0)
        p = np.exp(p - p.max())
        p /= p.sum()
        p[y] -= 1
        want[at] += x * p
        want[-1] += p
    assert n == 50 and np.abs(got - want).max() < 1e-4


def test_odd_labels(spark):
    df = spark.createDataFrame([("a b", None), (None, "x"), ("c", "x"), ("d", "x")], "text string, label string")
    assert {(r.predicted, r.probability) for r in linear.predict(df, linear.fit(df)).collect()} == {("x", 1.0)}
    none = linear.fit(df.limit(0))
    assert {r.predicted for r in linear.predict(df, none).collect()} == {None} and linear.predict(df.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        linear.predict(df.withColumn("Predicted", F.lit(1)), none)
    with pytest.raises(ValueError):
        linear.fit(spark.range(200).selectExpr("'t' text", "cast(id as string) label"))


def test_sentiment_rules(spark):
    v = linear.valence
    assert v("good") > 0 > v("bad") and v("very good") > v("good") > v("slightly good") and v("not good") < 0 < v("not so bad")
    assert v(None) == v("") == v("plain words") == 0 and -1 < v("terrible " * 500) < -0.99
    df = spark.createDataFrame([("Great!",), (None,), ("the worst, really",)], "t string")
    rows = df.select(linear.sentiment("t").alias("s"), guards.by_score("t", linear.sentiment("t"), 0.0, invert=True).valid.alias("ok")).collect()
    assert [(np.sign(r.s), r.ok) for r in rows] == [(1, True), (0, True), (-1, False)]
