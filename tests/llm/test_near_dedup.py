import random

import edge
import numpy as np

from seasonframe.llm import near_dedup as N
from seasonframe.llm.common import LOWER, Words


def sets(texts, size):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().translate(LOWER).split()
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size, num, den):
    s, label = sets(texts, size), {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if a < b and s[a] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return {k: (len(s[k]), label[k], label[k] == k) for k in texts}


def family(size, edits, seed):
    rng, base, out = random.Random(seed), edge.words(200, seed), []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_DOCS", 8)  # families of several parts
    texts = dict(edge.TEXTS)
    # Families whose members lie on both sides of the threshold, and copies of them.
    for k, t in enumerate([*family(40, 8, 3), *family(30, 16, 4), *family(20, 30, 5), *family(5, 0, 6)]):
        texts[100 + k] = t
    for size, num in ((3, 85), (5, 80)):
        found = N.near_duplicates(edge.docs(spark, texts), size, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(texts, size, num, 100)


def test_empty_table(spark):
    assert N.near_duplicates(edge.empty(spark)).collect() == []


def test_row_without_id_stands_alone_or_follows_its_copy(spark):
    rows = [(None, "a b c d e f g"), (None, "q r s t u v w"), (4, "a b c d e f g")]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.component_id is None, r.kept) for r in found) == [(False, False), (False, True), (True, True)]


def test_signature_estimates_similarity():
    a = edge.words(2000, 1, 10**9)
    b = a[:1000] + edge.words(1000, 2, 10**9)
    found, offset = N.shingle_sets(Words([" ".join(x).encode() for x in (a, b)], LOWER), 1)
    s = N.signatures(found, offset)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12
    assert (s >> np.uint64(32)).max() < 4, "long sets stop after a few layers"


def test_bands_leave_no_chance_to_miss():
    for num in (80, 85):
        rows, count = N.bands(num, 100)
        assert (1 - (num / 100) ** rows) ** count <= N.MISS and rows * count <= N.SLOTS


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b").repartition(7)
    assert {r.component for r in N.components(links).collect()} == {0}
