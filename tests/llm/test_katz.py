import math
from collections import Counter, defaultdict

import edge
from pyspark.sql import functions as F

from seasonframe.llm import katz as K
from seasonframe.llm.common import LOWER


def brute(rows):
    """Score, base and known tokens of (id, text, train) by plain dictionaries; the probability function."""
    tokens = {k: [*(t or "").encode().translate(LOWER).split(), None] for k, t, _ in rows}
    one, two, context = Counter(), Counter(), Counter()
    for k, _, train in rows:
        if train:
            one.update(tokens[k])
            two.update(zip(["<s>", *tokens[k]], tokens[k]))
            context.update(["<s>", *tokens[k][:-1]])
    n, v = sum(one.values()), len(one)
    gt = [K.good_turing([Counter(c.values())[r] for r in range(1, K.CUT + 2)]) for c in (one, two)]

    def kept(g, c):
        return g.small[c] * c if c <= K.CUT else c - g.large

    unknown = 1 - sum(kept(gt[0], c) for c in one.values()) / n if n else 1.0
    seen, lower = defaultdict(float), defaultdict(float)

    def uni(w):
        return kept(gt[0], one[w]) / n if one[w] else unknown

    for (a, w), c in two.items():
        seen[a] += kept(gt[1], c) / context[a]
        lower[a] += uni(w)

    def p(a, w):
        if two[a, w]:
            return kept(gt[1], two[a, w]) / context[a]
        return (1 - seen[a]) / (1 - lower[a]) * uni(w) if context[a] else uni(w)

    out = {}
    for k, s in tokens.items():
        score = sum(math.log10(p(a, w)) for a, w in zip(["<s>", *s], s))
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)
        out[k] = (len(s), sum(one[w] > 0 for w in s), n, base, score)
    return out, p, one, context


def rows():
    texts = dict(edge.TEXTS)
    texts[8] = " ".join(edge.words(3000, 9, 400))
    for k in range(40):
        texts[50 + k] = " ".join(edge.words(80, 3 * k + 1, 60))
    return [(k, t, k % 5 != 1) for k, t in texts.items()]


def test_scores_equal_plain_model(spark):
    docs = edge.docs(spark, {k: t for k, t, _ in rows()}).withColumn("train", F.col("doc_id") % 5 != 1)
    expected = brute(rows())[0]
    found = K.katz_scores(docs, block_bytes=4000).collect()
    assert len(found) == len(expected)
    for r in found:
        e = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == e[:3]
        assert math.isclose(r.base_score, e[3], rel_tol=1e-9) and math.isclose(r.score, e[4], rel_tol=1e-9)


def test_each_context_sums_to_one():
    _, p, one, context = brute(rows())
    for a in list(context)[:20] + ["<s>", "never seen"]:
        assert math.isclose(sum(p(a, w) for w in one) + p(a, "unknown word"), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = edge.docs(spark, {1: "a b", 2: None}).withColumn("train", F.lit(None).cast("boolean"))
    assert [(r.score, r.n_known, r.train_tokens) for r in K.katz_scores(docs).collect()] == [(0.0, 0, 0)] * 2
    assert K.katz_scores(edge.empty(spark).withColumn("train", F.lit(True))).collect() == []


def test_keys_survive_packing():
    import numpy as np

    keys = np.unique(np.array([0, 5, 2**63, 2**64 - 1, 77], np.uint64))
    assert (K.unpack_keys(K.pack_keys(keys)) == keys).all()
    assert K.cuts(keys, 4).tolist() == [0, 3, 3, 4, 5]
