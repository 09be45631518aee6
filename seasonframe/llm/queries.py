"""The operators over whole tables, each beside the SQL that gives the same rows, if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm import (
    chat,
    decontamination,
    hard_negatives,
    jaccard_join,
    katz,
    line_dedup,
    mixing,
    near_dedup,
    spelling,
    substring_dedup,
    tiff,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
),
items AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all windows of ten words of the benchmark."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def _linked_sql(percent: int) -> str:
    """Sets of three-word shingles, links and what they reach, as ``c``, with ``n`` and ``d`` beside it."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b, c FROM reach JOIN ways ON a = doc_id)"""


@query(
    f"""{_linked_sql(85)}
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, min(c) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""
)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike by at least 85 % of their shingles of three words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


@query(
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
v AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
),
c AS (SELECT doc_id, p FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM c),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no window of twenty words repeats, for every document."""
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every document in a mixture that repeats no source more than four times."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def fold(number: int) -> Column:
    """Whether a document's checksum has this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == number, F.lit(False))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~fold(0)))
    return toxicity.score(docs, model).select("doc_id", fold(0).alias("held_out"), "score", "predicted")


@query()
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its roles repaired and rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query()
def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file, written and read back."""
    return tiff.text_media(table(spark, sf_dir, "documents"))


@query(
    """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM l),
w AS (
  SELECT doc_id, pos, ls[pos] || chr(10) || ls[pos + 1] AS k FROM p WHERE pos < len(ls)
),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM f WHERE nth > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(ls[pos], chr(10) ORDER BY pos) AS t FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END) AS kept_sha256
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of runs of two lines or more."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _url_sql() -> str:
    """The rules and both models in SQL, with the operator's parameters."""
    cases = {"given": "", "rule": ""}
    for kind, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN "
        cases["given"] += f"{fits}'{kind}' "
        cases["rule"] += f"{fits}'{text}' "
    n, smooth = url_filter.ORDER + 1, url_filter.SMOOTHING
    tables, joins, p = "", "", {c: f"{1 / len(url_filter.ALPHABET)!r}::DOUBLE" for c in "ab"}
    for k in range(1, n + 1):
        tables += f"e{k} AS (SELECT right(gram, {k}) AS g, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1),\n"
        tables += f"t{k} AS (SELECT substr(gram, {n + 1 - k}, {k - 1}) AS g, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1),\n"
        joins += f" JOIN e{k} ON e{k}.g = right(gram, {k}) JOIN t{k} ON t{k}.g = substr(gram, {n + 1 - k}, {k - 1})"
        p = {x: f"(e{k}.{x} + {smooth} * {p[x]}) / (t{k}.{x} + {smooth})" for x in "ab"}
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
u AS (SELECT *, CASE {cases["given"]} END AS given, CASE {cases["rule"]} END AS rule,
             '^^^' || regexp_replace(translate(lower(host || path), '123456789', '000000000'), '[^a-z0./_:-]', '?', 'g') || '$' AS s
      FROM h),
g AS (SELECT page_id, given, substr(s, i, {n}) AS gram FROM (SELECT *, unnest(range(1, length(s) - {n - 2})) AS i FROM u)),
c AS (SELECT gram, count(*) FILTER (given = 'allow' AND page_id % 5 <> 0) AS a,
             count(*) FILTER (given = 'block' AND page_id % 5 <> 0) AS b FROM g GROUP BY gram),
{tables}
ratio AS (SELECT gram, ln(({p["a"]}) / ({p["b"]})) AS x FROM c{joins}),
sc AS (SELECT page_id, avg(x) AS score FROM g JOIN ratio USING (gram) GROUP BY page_id),
bins AS (SELECT CAST(greatest(-1000, least(1000, floor(score * 100))) AS INTEGER) AS bin,
                count(*) FILTER (given = 'allow') AS a, count(*) FILTER (given = 'block') AS b
         FROM u JOIN sc USING (page_id) WHERE page_id % 5 = 0 AND given IS NOT NULL GROUP BY 1),
errs AS (SELECT bin, round(coalesce(sum(a) OVER below, 0) / sum(a) OVER () + 1 - coalesce(sum(b) OVER below, 0) / sum(b) OVER (), 9) AS err
         FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT bin / 100 AS cut FROM errs WHERE err IS NOT NULL ORDER BY err, bin LIMIT 1)
SELECT u.page_id, host, path, rule,
       coalesce(given, CASE WHEN NOT EXISTS (SELECT 1 FROM cut) OR score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN sc USING (page_id)"""


@query(_url_sql())
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the four rules, or else by the models."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), RULES).drop("score")


_CRC_TABLE = """tb AS (
  SELECT range AS i, 0 AS n, range AS c FROM range(256)
  UNION ALL SELECT i, n + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM tb WHERE n < 8)"""


def _katz_sql() -> str:
    """The model and its folds in SQL; an end is one blank, a beginning two."""

    def discounts(name: str, table: str) -> str:
        n = ", ".join(f"count(*) FILTER (c = {r})" for r in range(1, katz.CUT + 2))
        common = f"({katz.CUT + 1} * n[{katz.CUT + 1}] / n[1]::DOUBLE)"
        return f"""
{name}n AS (SELECT [{n}] AS n FROM {table}),
{name}r AS (SELECT r, n, CASE WHEN n[1] > 0 AND n[r] > 0 AND {common} <> 1
                   THEN ((r + 1) * n[r + 1] / n[r]::DOUBLE / r - {common}) / (1 - {common}) END AS d,
              CASE WHEN n[1] > 0 THEN least(0.9, greatest(0.1, n[1] / (n[1] + 2 * n[2])::DOUBLE)) ELSE 0.5 END AS part
            FROM {name}n, range(1, {katz.CUT + 1}) t(r)),
{name}d AS (SELECT list(CASE WHEN fit THEN d ELSE (r - part) / r END ORDER BY r) AS d, any_value(n) AS n
            FROM (SELECT *, bool_and(coalesce(d > 0 AND d < 1, false)) OVER () AS fit FROM {name}r)),"""

    def kept(name: str, c: str) -> str:
        return f"(CASE WHEN {c} <= {katz.CUT} THEN {name}d.d[{c}] * {c} ELSE {c} - {katz.CUT} * (1 - {name}d.d[{katz.CUT}]) END)"

    return f"""
WITH RECURSIVE {_CRC_TABLE},
cr AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS c FROM documents
  UNION ALL SELECT doc_id, s, k + 1, xor(cr.c >> 8, tb.c)
  FROM cr JOIN tb ON tb.n = 8 AND tb.i = xor(cr.c & 255, ascii(substr(s, k + 1, 1))) WHERE k < length(s)),
d AS (
  SELECT doc_id, xor(c, 4294967295) % 5 = 1 AS held_out, list_append(regexp_extract_all({_LOWER.format("text")}, {_WORD}), ' ') AS ws
  FROM documents JOIN cr USING (doc_id) WHERE k = length(s)),
t AS (
  SELECT doc_id, held_out, ws[p] AS w, CASE WHEN p = 1 THEN '  ' ELSE ws[p - 1] END AS v
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM d)),
one AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
ctx AS (SELECT v, sum(c) AS c FROM two GROUP BY v),{discounts("u", "one")}{discounts("b", "two")}
m AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS types FROM one),
unk AS (
  SELECT (list_sum(list_transform(range(1, {katz.CUT + 1}), lambda r: ud.n[r] * r * (1 - ud.d[r])))
          + (types - list_sum(ud.n[1:{katz.CUT}])) * {katz.CUT} * (1 - ud.d[{katz.CUT}])) / m.n AS p
  FROM ud, m),
p1 AS (SELECT w, c, {kept("u", "c")} / m.n AS p FROM one, ud, m),
al AS (
  SELECT v, (1 - sum({kept("b", "two.c")} / ctx.c)) / (1 - sum(p1.p)) AS a
  FROM two JOIN ctx USING (v) JOIN p1 USING (w), bd GROUP BY v)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(p1.c) AS n_known, any_value(m.n) AS train_tokens,
  sum(log10((coalesce(p1.c, 0) + 0.5) / (m.n + 0.5 * (m.types + 1)))) AS base_score,
  sum(log10(CASE WHEN two.c > 0 THEN {kept("b", "two.c")} / ctx.c WHEN ctx.c > 0 THEN al.a * coalesce(p1.p, unk.p)
            ELSE coalesce(p1.p, unk.p) END)) AS score
FROM t LEFT JOIN p1 USING (w) LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN ctx ON ctx.v = t.v LEFT JOIN al ON al.v = t.v, bd, m, unk
GROUP BY doc_id"""


@query(_katz_sql())
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~fold(1)).alias("train"))
    return katz.katz_scores(docs).withColumn("held_out", ~F.col("train")).drop("train")


@query(
    """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1::BIGINT) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each positive of every hundredth vector, at 0.3 to 0.9 of its score."""
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    vectors = rows.filter(finite).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query(
    f"""{_linked_sql(90)}
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""
)
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike by at least 90 % of their shingles of three words."""
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


@query(
    f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
cr AS (
  SELECT doc_id, run, hex(encode(concat(doc_id, ':', run))) AS s, 0 AS k, 4294967295 AS h FROM runs WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, run, s, k + 1, xor(cr.h >> 8, tb.c)
  FROM cr JOIN tb ON tb.n = 8 AND tb.i = xor(cr.h & 255, ('0x' || substr(s, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(s)),
slip AS (SELECT doc_id, run, xor(h, 4294967295) AS h FROM cr WHERE 2 * k = length(s)),
words AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, c
        FROM runs LEFT JOIN slip USING (doc_id, run))
  WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5),
gap AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT gap.word, words.word FROM gap JOIN words ON words.word = gap.v
  UNION SELECT words.word, gap.word FROM gap JOIN words ON words.word = gap.v),
best AS (
  SELECT near.word, o.word AS other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN words o ON o.word = near.other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, o.word) = 1),
forms AS (
  SELECT words.word, n, CASE WHEN other_n >= 5 * n THEN other END AS form, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk USING (word) JOIN forms last ON last.word = walk.at AND last.form IS NULL"""
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of the documents, some of them with planted slips, and their usual forms."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), least_length=6, least_count=5, slips=199)
    return spelling.variants(words, ratio=5)
