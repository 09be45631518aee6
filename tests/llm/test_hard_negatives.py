import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vector array<long>, score double, part int, anchor string"


def brute(rows, every, k, positives, low, high):
    """Plain selection over all pairs; rows as (vec_id, label, vector)."""
    one = {}
    for r in sorted((r for r in rows if None not in r and None not in r[2]), key=lambda r: (r[0], r[1], r[2])):
        one.setdefault(r[0], r)
    rows, out = list(one.values()), []
    for a, own, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in rows if i != a)
        for minus, p, _ in [s for s in scored if s[2] == own][:positives]:
            fit = [s for s in scored if s[2] != own and -minus * low[0] <= -s[0] * low[1] and -s[0] * high[1] <= -minus * high[0]]
            out += [(a, p, n + 1, i, -minus, -m) for n, (m, i, _) in enumerate(fit[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 3, "x") for r in rows], SCHEMA)


def found(spark, rows, every=3, **kw):
    out = H.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **kw)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def some(n, seed, dims=4, size=6):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randint(-2, size) for _ in range(dims)]) for i in range(n)]


def test_equals_brute_force_with_ties_in_several_groups(spark):
    rows = some(120, 1)
    for kw in ({}, {"k": 2, "positives": 7}, {"low": (-1, 2), "high": (1, 1)}, {"low": (1, 7), "high": (5, 7)}):
        full = {"k": 10, "positives": 5, "low": (3, 10), "high": (9, 10)} | kw
        expected = brute(rows, 3, **full)
        assert expected and found(spark, rows, group_rows=16, **kw) == expected


def test_odd_rows(spark):
    rows = some(30, 2)
    rows += [(None, 1, [1, 1, 1, 1]), (100, None, [1, 2, 3, 4]), (101, 1, None), (102, 1, [1, None, 2, 3])]
    rows += [(200, 0, []), (201, 1, [3]), (202, 2, [1, 2, 3, 4, 5, 6]), (-3, 1, [5, 5, 5, 5]), (6, 0, [9, 9, 9, 9]), rows[4], rows[4]]
    assert found(spark, rows) == brute(rows, 3, 10, 5, (3, 10), (9, 10))


def test_one_common_vector_and_negative_scores(spark):
    rows = [(i, i % 2, [3, 3]) for i in range(200)] + [(i, 0, [-5, 1]) for i in range(300, 312)]
    assert found(spark, rows, 100, group_rows=32) == brute(rows, 100, 10, 5, (3, 10), (9, 10))


def test_no_rows_no_anchor_no_partner(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, [1]), (2, 1, [1])]) == []
    assert found(spark, [(3, 0, [1])]) == []


def test_scores_are_exact_or_raise():
    big = np.array([[1 << 40, 3]], np.int64)
    assert H.scores(big, np.array([[1 << 20, 1]], np.int64))[0, 0] == (1 << 60) + 3
    with pytest.raises(ValueError, match="64 bits"):
        H.scores(big, big)


def test_limits_round_to_the_inside(spark):
    values = [-101, -100, -1, 0, 1, 9, 10, 11, 99, (1 << 62) + 7]
    df = spark.createDataFrame([(v,) for v in values], "score long")
    for num, den in ((9, 10), (3, 10), (1, 7)):
        got = df.select(H._floor("score", num, den), -H._floor("-score", num, den)).collect()
        assert [tuple(r) for r in got] == [(v * num // den, -(-v * num // den)) for v in values]


def test_slots_are_disjoint_and_lists_stay_short(spark):
    """What tasks emit for an anchor is at most k rows a slot, however many rows pass it."""
    import pyarrow as pa

    n = 500
    part = {"part": [0] * n, "anchor": [False] * n, "vec_id": list(range(n)), "label": [1] * n, "vector": [[i] for i in range(n)]}
    rows = pa.RecordBatch.from_pydict(part | {"limits": pa.array([None] * n, pa.list_(pa.int64())), "floor": pa.array([None] * n, pa.int64())})
    asked = pa.RecordBatch.from_pydict(
        {"part": [0], "anchor": [True], "vec_id": [1000], "label": [0], "vector": [[1]], "limits": [[400, 300, 100]], "floor": [50]}
    )
    (out,) = H._in_groups(H._slots(4), ("anchor_id", "slot", "other", "score"))(iter([rows, asked.cast(rows.schema)]))
    got = list(zip(out.column("slot").to_pylist(), out.column("score").to_pylist()))
    assert got == [(s, top - i) for s, top in enumerate((400, 300, 100)) for i in range(4)]
