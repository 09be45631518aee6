import random
import zlib
from collections import Counter

import edge
import pytest

from seasonframe.llm import spelling as S


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def found(df, ratio=5):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df, ratio).collect()}


def made(seed, n=400, alphabet="abcé", longest=7):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): rng.choice([1, 2, 6, 30, 31, 200, 1000]) for _ in range(n)}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "STATES", 16)  # nodes with several salts
    long = "lang" * 3000
    counts = made(1) | {long: 5, long[:-1] + "h": 40, long[:5000] + long[5001:]: 300, long + "s": 1}
    assert found(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)) == brute(counts)


def test_words_from_an_alphabet_of_one(spark):
    counts = {"a" * k: 3**k for k in range(1, 12)}
    assert found(spark.createDataFrame(list(counts.items()), "word string, n long"), 3) == brute(counts, 3)


def test_odd_rows(spark):
    rows = [(None, 3, 1), ("abc", None, 1), ("abc", 2, 1), ("abc", 3, 2), ("abd", 25, 1), ("", 1, 1), ("x", 5, 1), ("\U0001f600bc", 1, 1)]
    got = found(spark.createDataFrame(rows, "word string, n long, root int"))
    assert got == brute({"abc": 5, "abd": 25, "": 1, "x": 5, "\U0001f600bc": 1})
    assert found(spark.createDataFrame([], "word string, n long")) == {}
    assert found(spark.createDataFrame([("one", 1)], "word string, n long")) == {"one": (None, "one", 1, 0, None)}
    with pytest.raises(Exception, match="end mark"):
        found(spark.createDataFrame([("a\0b", 1)], "word string, n long"))


def test_ties_go_to_the_smaller_word(spark):
    counts = {"cart": 2, "card": 50, "care": 50, "cärt": 50}
    assert found(spark.createDataFrame(list(counts.items()), "word string, n long"))["cart"][:2] == ("card", "card")


def plain_counts(texts, least, times, slips):
    out = Counter()
    for k, text in texts:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{k}:{run}".encode())
                if slips and k is not None and h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= least:
                    out[run] += 1
            run = ""
    return {w: n for w, n in out.items() if n >= times}


def test_vocabulary_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 50)
    monkeypatch.setattr(S, "_HELD", 20)
    texts = dict(edge.TEXTS) | {20: " ".join("ÀÉlà naïveté Straße×÷ x" for _ in range(9)), 21: "Zwölfter" * 40, 22: "1zwei2drei3vier4" * 30}
    rows = [*texts.items(), (None, "lettering lettering Ärgerliches"), (20, texts[20])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, word string")
    for least, times, slips in ((6, 5, 3), (1, 1, 2), (3, 2, None)):
        assert {r.word: r.n for r in S.vocabulary(df, least, times, slips).collect()} == plain_counts(rows, least, times, slips)
    assert S.vocabulary(edge.empty(spark)).collect() == []
