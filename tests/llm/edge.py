"""Documents with what data holds: NULLs, empty and long texts, ties, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, rank int, n_words int, label int"


def words(n, seed=1, size=5000):
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % size}")
    return out


LONG = " ".join(words(60000, 9, 50000))

TEXTS = {
    0: None,
    1: "",
    2: " \n\t ",
    3: "one",
    4: "A few words, no more.\nAnd a line",
    5: "A few words, no more.\nAnd a line",
    6: " ".join(words(300, 5)),
    7: " ".join(words(300, 5)[:290] + words(10, 77)),
    8: LONG,
    9: "\n".join(["same line"] * 50),
    10: " ".join(words(300, 5)).upper(),
    11: "Straße über\u00a0Ärger, naïve \U0001f600 text " * 3,
}


def docs(spark, texts=TEXTS):
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 0.5, "x", 1, 2, 3) for k, t in texts.items()]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
