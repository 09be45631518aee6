import edge
import numpy as np
from pyspark.sql import functions as F

from seasonframe.llm import queries
from seasonframe.llm import toxicity as T
from seasonframe.llm.common import ALNUM, Words


def fitted(rows, penalty):
    hashes = [np.unique(Words([t.encode()], ALNUM).hash) for t, _ in rows]
    return T.fit(hashes, np.array([y for _, y in rows]), penalty)


def logit(model, text):
    h = np.unique(Words([text.encode()], ALNUM).hash)
    return model.bias + model.weights[np.isin(model.words, h)].sum()


def biased():
    """Slurs that come once each, always with one group; neutral texts name another."""
    rows = []
    for k in range(500):
        filler = " ".join(edge.words(12, k + 1, 400))
        if k % 5 == 0:
            rows.append((f"muslim slur{k} {filler}", 1))
        elif k % 5 < 4:
            rows.append((f"christian {filler}", 0))
        else:
            rows.append((f"scum {filler}", 1) if k % 2 else (filler, 0))
    return rows


def test_penalty_frees_neutral_mentions():
    plain, fair = fitted(biased(), 0.0), fitted(biased(), T.PENALTY)
    gap = [abs(logit(m, "muslim friends") - logit(m, "christian friends")) for m in (plain, fair)]
    assert gap[1] < 0.1 * gap[0]
    assert logit(plain, "muslim friends") > 0 > logit(fair, "muslim friends")
    assert logit(fair, "scum") > 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0] and n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))


def test_odd_rows_and_labels(spark):
    docs = edge.docs(spark, {k: t for k, t, in edge.TEXTS.items()})
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (6, None), (None, 1), (99, 1), (7, 0)], "doc_id long, toxic int")
    for given in (labels, labels.filter("false"), labels.filter("toxic = 1")):
        found = T.score(docs, T.train(docs, given), carry=("label", "lang")).collect()
        assert len(found) == len(edge.TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.label == 3 for r in found)
    model = T.train(docs, labels)
    assert T.score(edge.empty(spark), model).collect() == []
    texts = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert texts[0] == texts[1] == texts[2]


def test_sample_is_bounded(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert T.train(docs, labels, sample=10).bias < 1
