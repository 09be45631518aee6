import random
import re

import pytest
from pyspark.sql import functions as F

from seasonframe.operators.availability import availability, long_absence_flag, shown_status

CASES = [
    ("PPPPPPPPBPPPPPPPPX", 1, 17, [], 0, False),
    ("PDDPPDPPPPPPPPPPPP", 1, 18, [(2, 3), (6, 6)], 2, True),
    ("PDBDPPPPPPPPPPPPPP", 1, 18, [(2, 2), (4, 4)], 1, True),
    ("PDXDPPPPPPPPPPPPPP", 1, 18, [(2, 2), (4, 4)], 1, True),
    ("DDPPPPPPPPPPPPDDDD", 3, 14, [], 0, False),
    ("XXXXXXXXPXXXXXXXXX", 9, 9, [], 0, False),
    ("DDDDBDDDDDDDDDDDDX", None, None, [], 0, False),
]


def evaluate(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").withColumn("s", F.split("t", ""))
    rows = df.select("t", availability("s").alias("a")).collect()
    return {r.t: r.a for r in rows}


def test_fixed_vectors(spark):
    got = evaluate(spark, [c[0] for c in CASES])
    for text, first, last, segments, longest, returned in CASES:
        a = got[text]
        assert (a.firstWeek, a.lastWeek, a.longestAbsence, a.returnedFromAbsence) == (first, last, longest, returned)
        assert [(s.start, s.end) for s in a.absenceSegments] == segments
        assert all(s.length == s.end - s.start + 1 for s in a.absenceSegments)


def test_random_vectors_match_runs_found_by_pattern(spark):
    rng = random.Random(3)
    texts = {"".join(rng.choice("PDBXDD") for _ in range(18)) for _ in range(800)}
    for text, a in evaluate(spark, texts).items():
        first, last = text.find("P") + 1, text.rfind("P") + 1
        runs = [
            (m.start() + 1, m.end()) for m in re.finditer("D+", text) if first and first < m.start() + 1 and m.end() < last
        ]
        assert [(s.start, s.end) for s in a.absenceSegments] == runs
        assert a.longestAbsence == max((e - s + 1 for s, e in runs), default=0)
        assert a.returnedFromAbsence == bool(runs)


@pytest.mark.parametrize("season, n", [(2020, 17), (2021, 18)])
def test_shown_weeks(spark, season, n):
    df = spark.createDataFrame([(season, ["P"] * 18)], "season INT, s ARRAY<STRING>")
    assert len(df.select(shown_status("s", "season").alias("x")).first().x) == n


def test_long_flag(spark):
    df = spark.createDataFrame([(2,), (3,)], "n INT")
    assert [r[0] for r in df.select(long_absence_flag(F.col("n"))).collect()] == [False, True]
