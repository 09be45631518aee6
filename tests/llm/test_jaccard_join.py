import itertools
import random

import edge
import numpy as np
import pytest
from test_near_dedup import brute, family

from seasonframe.llm import jaccard_join as J
from seasonframe.llm.common import mix


def found(spark, texts, size, num, den=100):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(edge.docs(spark, texts), size, num, den).collect()}


def expected(texts, size, num, den=100):
    return {k: v[:2] for k, v in brute(texts, size, num, den).items()}


def test_equals_brute_force_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_DOCS", 6)
    monkeypatch.setattr(J, "RUN_DOCS", 5)
    texts = dict(edge.TEXTS)
    # Families whose members lie on both sides of the threshold, copies, and short texts.
    made = [*family(30, 6, 3), *family(25, 12, 4), *family(20, 30, 5), *family(5, 0, 6)]
    base = edge.words(30, 21)
    made += [" ".join(base[:n] + base[n + 1 :]) for n in range(0, 30, 3)] + [" ".join(base[:n]) for n in range(1, 30, 2)]
    for k, t in enumerate(made):
        texts[100 + k] = t
    for size, num in ((3, 90), (1, 80)):
        assert found(spark, texts, size, num) == expected(texts, size, num)


def test_linked_sets_always_share_a_signature():
    """All sizes of bands, differences up to the very threshold, adversarial or random."""
    rng = random.Random(5)
    for num in (50, 80, 90, 95):
        for _ in range(300):
            union = rng.choice([rng.randint(2, 40), rng.randint(40, 300), rng.randint(300, 900)])
            apart = union * (100 - num) // 100
            x = mix(np.array(rng.sample(range(10**9), union), np.uint64))
            left = rng.randint(0, apart)
            a, b = np.sort(x[: union - left]), np.sort(np.r_[x[: union - apart], x[union - left :]])
            assert 100 * len(np.intersect1d(a, b)) >= num * union
            if len(a) and len(b) and not np.array_equal(a, b):
                owner, keys = J.signatures(np.r_[a, b], np.r_[0, len(a), len(a) + len(b)], num, 100)
                assert set(keys[owner == 0]) & set(keys[owner == 1]), (num, union, apart, left)


def test_bands_cover_every_linked_pair_of_sizes():
    for num in (50, 80, 90):
        all_bands = J.bands(2000, num, 100)
        for big, b in ((n, b) for b in all_bands for n in range(b.low, b.high + 1)):
            least = -(-big * num // 100)
            assert b.join <= least
            # pigeonhole: some part has at most ``left_out`` of the differences
            assert (big + least) * (100 - num) // (100 + num) < b.parts * (b.left_out + 1)
        assert [b.low for b in all_bands[1:]] == [b.high + 1 for b in all_bands[:-1]]


def test_unlike_sets_share_few_signatures():
    rng = np.random.default_rng(3)
    sets = [np.sort(mix(rng.integers(0, 1 << 62, 500).astype(np.uint64))) for _ in range(40)]
    half = [np.sort(np.r_[sets[0][:250], s[:250]]) for s in sets]
    both = sets + half
    owner, keys = J.signatures(np.concatenate(both), np.r_[0, np.cumsum([len(s) for s in both])], 90, 100)
    of = [set(keys[owner == i]) for i in range(len(both))]
    met = sum(bool(of[i] & of[j]) for i, j in itertools.combinations(range(len(both)), 2))
    assert met < 0.1 * len(both) ** 2 / 2


def test_empty_table_and_threshold_one(spark):
    assert J.similar_documents(edge.empty(spark)).collect() == []
    assert found(spark, edge.TEXTS, 3, 100) == expected(edge.TEXTS, 3, 100)
    with pytest.raises(ValueError, match="similarity"):
        J.similar_documents(edge.empty(spark), num=0)


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(edge.words(40, s)) for s in (1, 2, 3))
    rows = [(None, a), (7, a), (7, b), (5, b), (9, c), (9, c), (None, c + " x"), (11, c + " x y z u v"), (None, "alone here")]
    got = [tuple(r) for r in J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 5), (7, 5), (7, 5), (5, 5), (9, 9), (9, 9), (None, None), (11, 11), (None, None)], key=str
    )


def test_family_of_one_first_document_is_not_compared_again(spark, monkeypatch):
    """What the first document links needs no group."""

    def fail(group):
        raise AssertionError("compared in a group")

    monkeypatch.setattr(J, "_links", lambda num, den: fail)
    base = edge.words(300, 8)
    texts = {i: " ".join(base[:150] + [f"y{i}"] + base[150:]) for i in range(40)}
    assert {c for _, c in found(spark, texts, 3, 90).values()} == {0}
