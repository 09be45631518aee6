import math

import edge
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import mixing as M

SIZES = {"big": 400, "mid": 60, "small": 8, "": 3}


def docs(spark, each=5):
    rows = [(k, " ".join(["w"] * (each - 1)), s or None) for s, n in SIZES.items() for k in range(hash(s) % 7, hash(s) % 7 + n)]
    rows = [(i, t, s, 9, 0.1) for i, (_, t, s) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block int, weight double")


def share(a):
    p = {s: n / sum(SIZES.values()) for s, n in SIZES.items()}
    z = sum(x**a for x in p.values())
    return {s: x**a / z for s, x in p.items()}


def bisected(fits):
    low, high = 0.0, M.MAX_EXPONENT
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


@pytest.mark.parametrize("target", [M.Target(4.0), M.Target(None, 0.5), M.Target(1.0), M.Target(1e9)])
def test_exponent_and_weights(spark, target):
    p = share(1)

    def fits(a):
        w = share(a)
        entropy = -sum(x * math.log(x) for x in w.values() if x)
        most = max(x / p[s] for s, x in w.items()) / min(x / p[s] for s, x in w.items())
        return (target.entropy is None or entropy <= target.entropy) and (target.repeats is None or most <= target.repeats or a > 1)

    a = bisected(fits)
    found = M.mixture(docs(spark), target, block_tokens=20)
    weights = {r.source: r.weight for r in found.select("source", "weight").distinct().collect()}
    for s, w in share(a).items():
        assert math.isclose(weights[s], w, rel_tol=1e-6)


def test_uses_follow_the_budget(spark):
    found = M.mixture(docs(spark), M.Target(4.0), block_tokens=20).cache()
    uses = {r.source: (r.n, r.least, r.most) for r in found.groupBy("source", "doc_id").count().groupBy("source").agg(F.count("*").alias("n"), F.min("count").alias("least"), F.max("count").alias("most")).collect()}
    assert {s: u[0] for s, u in uses.items()} == SIZES
    assert uses["big"][1:] == (1, 1) and uses[""][1:] == (4, 4)
    w = share(1)
    total = found.agg(F.sum("n_tokens")).first()[0]
    for r in found.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("weight").alias("w")).collect():
        assert abs(r.t / total - r.w) < 0.03, (r, w)
    # No document twice in an epoch, each epoch whole but the last, another order in each.
    assert found.groupBy("doc_id", "epoch").count().filter("count > 1").isEmpty()
    half = found.filter("position < 0.5").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    for r in half:
        if r.source in ("big", "mid"):
            assert abs(r.t / sum(x.t for x in half) - found.filter(F.col("source") == r.source).first().weight) < 0.08


def test_budget_may_be_smaller(spark):
    found = M.mixture(docs(spark), M.Target(4.0), budget=300, block_tokens=20)
    assert 200 < found.agg(F.sum("n_tokens")).first()[0] < 400


def test_odd_rows(spark):
    found = M.mixture(edge.docs(spark)).collect()
    assert {r.doc_id for r in found} == set(edge.TEXTS)
    assert {r.doc_id: r.n_tokens for r in found} == {k: len((t or "").encode().split()) + 1 for k, t in edge.TEXTS.items()}
    assert M.mixture(edge.empty(spark)).collect() == []
    twice = edge.docs(spark).filter("doc_id = 4")
    assert M.mixture(twice.union(twice)).count() == 2
