import random

import edge

from seasonframe.llm import substring_dedup as S


def brute(texts, window):
    seen, out = set(), {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_windows_equal_brute_force(spark):
    rng, texts = random.Random(3), dict(edge.TEXTS)
    passages = [edge.words(rng.randint(15, 60), 50 + k) for k in range(6)]
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            cut = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [*edge.words(rng.randint(0, 30), 1000 * k + len(parts)), *cut[a : rng.randint(a, len(cut))]]
        texts[100 + k] = " ".join(parts)
    texts[200] = " ".join(["again"] * 70)
    found = S.substring_dedup(edge.docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute(texts, 20)
    for r in found:
        covered = {p for f in r.factors for p in range(f.start, f.stop)}
        assert len(covered) == r.n_removed and all(f.source <= r.doc_id for f in r.factors)


def test_copied_document_is_one_factor(spark):
    found = S.substring_dedup(edge.docs(spark, {3: edge.LONG, 8: edge.LONG})).filter("doc_id = 8").first()
    assert [(f.start, f.stop, f.source) for f in found.factors] == [(0, 60000, 3)] and found.kept == ""


def test_empty_table_and_missing_ids(spark):
    assert S.substring_dedup(edge.empty(spark)).collect() == []
    text = " ".join(edge.words(30))
    rows = [(None, text), (None, text), (2, text)]
    found = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_removed) for r in found] == [(30, 0)] * 3
