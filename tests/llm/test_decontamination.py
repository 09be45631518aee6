import edge
import numpy as np

from seasonframe.llm import decontamination as D
from seasonframe.llm.common import ALNUM


def split(text):
    return (text or "").encode().translate(ALNUM).split()


def brute(texts, items, window):
    out = {}
    for k, t in texts.items():
        w, hit, ids = split(t), set(), set()
        for name, phrase in items:
            p = split(phrase)
            size = min(window, len(p))
            for q in range(len(p) - size + 1) if size else ():
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == p[q : q + size]:
                        hit |= set(range(i, i + size))
                        ids.add(str(name))
        out[k] = (len(w), sorted(hit), sorted(ids))
    return out


ITEMS = [
    (1, " ".join(edge.words(40, 5)[10:25])),
    (2, "few WORDS no"),
    (3, None),
    (4, "..."),
    (5, " ".join(edge.words(40, 5)[15:30])),
    (1, "same line"),
    (6, "never anywhere at all"),
]


def test_spans_equal_brute_force(spark):
    texts = edge.TEXTS | {8: " ".join(edge.words(2000, 9)), 20: " ".join(edge.words(40, 5)[12:24]) + " tail"}
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    expected = brute(texts, ITEMS, 10)
    for bytes_ in (D.BLOCK_BYTES, 60):
        for r in D.find_spans(edge.docs(spark, texts), items, block_bytes=bytes_).collect():
            hit = [p for s in r.spans for p in range(s.start, s.stop)]
            assert (r.n_words, hit, list(r.items)) == expected[r.doc_id]


def test_spans_are_cut_and_documents_of_nothing_else_go(spark):
    passage = " ".join(edge.words(40, 5)[10:25])
    texts = {1: f"Before. {passage}, after!", 2: passage, 3: "Clean text.", 4: None, 5: ""}
    items = spark.createDataFrame(ITEMS[:1], "item_id int, text string")
    found = D.decontaminate(edge.docs(spark, texts), items, carry=("lang", "spans")).collect()
    assert {r.doc_id: r.text for r in found} == {1: "Before. , after!", 3: "Clean text.", 4: None, 5: ""}
    assert found[0].spans == "x"


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id int, text string")
    assert [r.contaminated for r in D.contamination(edge.docs(spark), items).collect()] == [False] * len(edge.TEXTS)
    assert D.contamination(edge.empty(spark), items).collect() == []


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = np.r_[rng.integers(1, 4, 3000), 0]
    order = D.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = D.FmIndex(text, 4)
    phrases = rng.integers(1, 4, (50, 5))
    live, low, high = index.search(phrases)
    for k, phrase in enumerate(phrases):
        where = [i for i in range(len(text) - 5) if (text[i : i + 5] == phrase).all()]
        rows = np.arange(low[live == k][0], high[live == k][0]) if (live == k).any() else np.empty(0, int)
        assert sorted(index.locate(rows).tolist()) == where
