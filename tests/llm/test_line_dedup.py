import random

import edge
import pytest

from seasonframe.llm import line_dedup as L


def brute(texts, n):
    seen, out = set(), {}
    for k in sorted(texts):
        lines = texts[k].split("\n") if texts[k] is not None else []
        gone = set()
        for p in range(len(lines) - n + 1):
            key = tuple(lines[p : p + n])
            if key in seen:
                gone |= set(range(p, p + n))
            seen.add(key)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[k] = (len(lines), len(gone), None if texts[k] is None else kept)
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_equal_brute_force(spark, n):
    rng, texts = random.Random(n), dict(edge.TEXTS)
    for k in range(60):
        texts[100 + k] = "\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randint(1, 12)))
    texts[300] = "\n".join(f"l{k}" for k in range(3000))
    texts[301] = texts[300]
    found = L.line_dedup(edge.docs(spark, texts), n, carry=("rank", "lang")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == brute(texts, n)


def test_maximal_runs(spark):
    texts = {1: "a\nb\nc\nd", 2: "x\na\nb\nc\ny", 3: "b\nc\nd\nz\na\nb"}
    found = L.repeated_runs(edge.docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in found) == [(2, 1, 4), (3, 0, 3), (3, 4, 6)]


def test_empty_table_and_missing_ids(spark):
    assert L.line_dedup(edge.empty(spark)).collect() == []
    rows = [(None, "a\nb"), (None, "a\nb"), (1, "a\nb")]
    found = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in found] == ["a\nb"] * 3


def weigh(run):
    solid = ["".join(c for c in line if c.isalnum() or c.isspace()) for line in run]
    return sum(max(len(x.split()), len("".join(x.split())) // 8) for x in solid)


def brute_words(texts, n, words):
    seen, out = set(), {}
    for k in sorted(texts):
        lines, gone = texts[k].split("\n"), set()
        for p in range(len(lines)):
            for size in range(1, min(n, len(lines) - p) + 1):
                key = tuple(lines[p : p + size])
                if key in seen and (size == n or weigh(key) >= words):
                    gone |= set(range(p, p + size))
                seen.add(key)
        out[k] = (len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_long_line_between_different_neighbours_goes(spark):
    long = " ".join(edge.words(52, 3))
    texts = {1: f"a\n{long}\nb", 2: f"c\n{long}\nd", 3: f"e\n{long}\na", 4: "\n".join(["漢字" * 30, "-" * 80, "漢字" * 30, "", "-" * 80, "x", ""])}
    docs = edge.docs(spark, texts)
    found = {r.doc_id: r.text for r in L.line_dedup(docs, min_words=L.MIN_WORDS).collect()}
    assert found == {1: texts[1], 2: "c\nd", 3: "e\na", 4: "\n".join(["漢字" * 30, "-" * 80, "", "-" * 80, "x", ""])}


@pytest.mark.parametrize("n,words", [(1, 9), (2, 3), (3, 5)])
def test_runs_by_words_equal_brute_force(spark, n, words):
    rng, texts = random.Random(n), {}
    for k in range(60):
        texts[k] = "\n".join(" ".join(["w"] * (j % 4) + [str(j)]) for j in (rng.randrange(14) for _ in range(rng.randint(1, 12))))
    found = L.line_dedup(edge.docs(spark, texts), n, min_words=words).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in found} == brute_words(texts, n, words)
