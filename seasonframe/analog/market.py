"""Queries over market values, college rows and listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.functions import snapshot_date_of
from seasonframe.operators import college, listing
from seasonframe.operators import market as M
from seasonframe.sources.documents import array_documents

_ROW_JSON = """'{"name":"' || name || '","position":"' || position || '","team":"' || team || '","value":' || value || '}'"""
_PRINTS = f"""fp AS (
  SELECT snapshot_date, count(*) AS n,
         sum(CAST('0x' || substr(sha1({_ROW_JSON}), 1, 15) AS UBIGINT)) AS lo,
         sum(CAST('0x' || substr(sha1({_ROW_JSON}), 16, 15) AS UBIGINT)) AS hi
  FROM mk GROUP BY snapshot_date)"""


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which both engines render alike."""
    return df.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query(f"WITH {V.MARKET} SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, name, team, value, position, tier FROM mk")
def q_market(spark: SparkSession, sf: str) -> DataFrame:
    """Market rows rendered as documents, pieces of dated snapshots, and read back by file name."""
    rows = V.market(spark, sf)
    file = F.concat(F.lit("landing/snapshot-"), F.col("snapshot_date").cast("string"), F.lit(".json"))
    item = F.struct("name", "team", "value", "position")
    docs = rows.groupBy(file.alias("file"), "tier", (F.xxhash64("name") % 997).alias("piece"))
    docs = docs.agg(F.to_json(F.collect_list(item)).alias("value"))
    dated = docs.select("value", "tier", snapshot_date_of(F.col("file")).alias("snapshot_date"))
    return _dated(array_documents(dated, S.MARKET_ROW).drop("ord"))


@query(f"""WITH {V.MARKET}
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, name, team, value, position FROM mk
WHERE snapshot_date = (SELECT max(snapshot_date) FROM mk)""")
def q_market_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the newest snapshot."""
    return _dated(M.latest_snapshot(V.market(spark, sf)).drop("ord", "tier"))


@query(f"""WITH {V.MARKET}
SELECT name, CAST(snapshot_date AS VARCHAR) AS snapshot_date, value, lag(value) OVER w AS previous,
       CAST(value - lag(value) OVER w AS INTEGER) AS delta
FROM mk WINDOW w AS (PARTITION BY name ORDER BY snapshot_date)""")
def q_market_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Value of a name against its snapshot before."""
    return _dated(M.value_trend(V.market(spark, sf)))


@query(f"""WITH {V.MARKET}, {_PRINTS}
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, n, CAST(lo AS VARCHAR) AS hash_lo, CAST(hi AS VARCHAR) AS hash_hi FROM fp""")
def q_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Content fingerprint per snapshot."""
    return _dated(M.fingerprints(V.market(spark, sf))).select(
        "snapshot_date", "n", F.col("hash_lo").cast("string"), F.col("hash_hi").cast("string")
    )


_TREE = f"""{V.MARKET},
rw AS (SELECT snapshot_date, name, {_ROW_JSON} AS text FROM mk),
rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY name, text) - 1 AS rank FROM rw)"""


@query(f"""WITH {_TREE}
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS n, sha256('[' || string_agg(text, ',' ORDER BY rank) || ']') AS digest
FROM rk GROUP BY snapshot_date HAVING count(*) <= 10000
UNION ALL SELECT CAST(snapshot_date AS VARCHAR), CAST(sum(n) AS BIGINT), sha256(string_agg(d, '' ORDER BY place))
FROM (SELECT snapshot_date, rank // 10000 AS place, count(*) AS n, sha256('[' || string_agg(text, ',' ORDER BY rank) || ']') AS d FROM rk GROUP BY ALL)
GROUP BY snapshot_date HAVING count(*) > 1""")
def q_digest(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of each snapshot's rows in name order."""
    return _dated(M.content_digests(V.market(spark, sf)))


@query(f"""WITH {_TREE},
l0 AS (SELECT snapshot_date, rank // 20 AS place, count(*) AS n, sha256('[' || string_agg(text, ',' ORDER BY rank) || ']') AS d FROM rk GROUP BY ALL),
l1 AS (SELECT snapshot_date, place // 20 AS up, count(*) AS c, sum(n) AS n, any_value(d) AS one, sha256(string_agg(d, '' ORDER BY place)) AS d FROM l0 GROUP BY ALL),
m1 AS (SELECT snapshot_date, up AS place, n, CASE WHEN c = 1 AND up = 0 THEN one ELSE d END AS d FROM l1),
l2 AS (SELECT snapshot_date, place // 20 AS up, count(*) AS c, sum(n) AS n, any_value(d) AS one, sha256(string_agg(d, '' ORDER BY place)) AS d FROM m1 GROUP BY ALL),
m2 AS (SELECT snapshot_date, up AS place, n, CASE WHEN c = 1 AND up = 0 THEN one ELSE d END AS d FROM l2),
l3 AS (SELECT snapshot_date, place // 20 AS up, count(*) AS c, sum(n) AS n, any_value(d) AS one, sha256(string_agg(d, '' ORDER BY place)) AS d FROM m2 GROUP BY ALL)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(n AS BIGINT) AS n, CASE WHEN c = 1 AND up = 0 THEN one ELSE d END AS digest FROM l3""")
def q_digest_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a tree of twenty rows or digests a node."""
    return _dated(M.content_digests(V.market(spark, sf), leaf=20))


@query(f"""WITH {V.MARKET}, {_PRINTS}
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, n IS DISTINCT FROM lag(n) OVER w OR lo IS DISTINCT FROM lag(lo) OVER w
                      OR hi IS DISTINCT FROM lag(hi) OVER w AS changed
FROM fp WINDOW w AS (ORDER BY snapshot_date)""")
def q_snapshot_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Does a snapshot differ from the one before."""
    return _dated(M.snapshot_changes(V.market(spark, sf)))


@query(f"""WITH {V.MARKET},
cal AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev
        FROM (SELECT DISTINCT snapshot_date FROM mk)),
r AS (SELECT n.snapshot_date, count(*) FILTER (o.name IS NULL OR o.tier <> n.tier) AS changed_n
      FROM mk n JOIN cal USING (snapshot_date)
      LEFT JOIN mk o ON o.snapshot_date = cal.prev AND o.name = n.name
      WHERE cal.prev IS NOT NULL GROUP BY n.snapshot_date)
SELECT CAST(r.snapshot_date AS VARCHAR) AS snapshot_date, changed_n, count(*) AS prev_n, CAST(changed_n AS DOUBLE) / count(*) AS ratio,
       CAST(changed_n AS DOUBLE) / count(*) <= 0.70 AS passed
FROM r JOIN cal USING (snapshot_date) JOIN mk o ON o.snapshot_date = cal.prev
GROUP BY r.snapshot_date, changed_n""")
def q_delta_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Share of rows that changed since the snapshot before, and the guard's verdict."""
    return _dated(M.guard_ratio(M.change_history(V.market(spark, sf), value="tier")))


@query("""WITH mkt AS (
  SELECT DISTINCT year(o_orderdate) AS y, c_name AS name, c_mktsegment AS position
  FROM orders JOIN customer ON o_custkey = c_custkey),
dim AS (SELECT upper(replace(c_name, '#', ' ')) AS name, c_mktsegment AS position, 'c' || c_custkey AS player_id
        FROM customer
        UNION ALL SELECT upper(replace(c_name, '#', '. ')) || ' Jr.', c_mktsegment, 's' || s_suppkey
        FROM supplier JOIN customer ON c_custkey = s_suppkey),
one AS (SELECT replace(replace(replace(lower(name), ' jr.', ''), '. ', ''), ' ', '') AS k, position,
               CASE WHEN count(DISTINCT player_id) = 1 THEN min(player_id) END AS player_id
        FROM dim GROUP BY 1, 2)
SELECT CAST(y AS INTEGER) AS season, name, mkt.position, player_id
FROM mkt LEFT JOIN one ON one.k = replace(lower(name), '#', '') AND one.position = mkt.position""")
def q_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Market names matched to player ids; names that two players share stay open."""
    customer = V.table(spark, sf, "customer")
    supplier = V.table(spark, sf, "supplier")
    position = F.col("c_mktsegment").alias("position")
    own = customer.select(
        F.upper(F.regexp_replace("c_name", "#", " ")).alias("name"), position,
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("player_id"),
    )
    twins = supplier.join(customer, F.col("c_custkey") == F.col("s_suppkey")).select(
        F.concat(F.upper(F.regexp_replace("c_name", "#", ". ")), F.lit(" Jr.")).alias("name"), position,
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("player_id"),
    )
    listed = (
        V.table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.year("o_orderdate").alias("season"), F.col("c_name").alias("name"), position)
        .distinct()
    )
    return M.match_names(listed, own.union(twins)).select("season", "name", "position", "player_id")


# College ----------------------------------------------------------------------------------------


@query(f"WITH {V.COLLEGE} SELECT * FROM co")
def q_college_long(spark: SparkSession, sf: str) -> DataFrame:
    """College rows in long form, from a document per player of each category and season."""
    rows = V.college(spark, sf)
    docs = rows.groupBy("season", "category", "playerId").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    return array_documents(docs.select("value"), S.COLLEGE_STATS).select(rows.columns)


@query(f"""WITH {V.COLLEGE}
SELECT season, category, "playerId",
       max(CASE WHEN "statType" = 'click' THEN CAST(stat AS DOUBLE) END) AS click,
       max(CASE WHEN "statType" = 'error' THEN CAST(stat AS DOUBLE) END) AS error,
       max(CASE WHEN "statType" = 'purchase' THEN CAST(stat AS DOUBLE) END) AS purchase,
       max(CASE WHEN "statType" = 'signup' THEN CAST(stat AS DOUBLE) END) AS signup,
       max(CASE WHEN "statType" = 'view' THEN CAST(stat AS DOUBLE) END) AS view
FROM co GROUP BY season, category, "playerId" """)
def q_college_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One row per player, season and category."""
    types = ["click", "error", "purchase", "signup", "view"]
    return college.pivot_college(V.college(spark, sf), types, ["season", "category", "playerId"])


# Listings ---------------------------------------------------------------------------------------

_LINKS = """li AS (
  SELECT page_id, CAST(generate_subscripts(href, 1) - 1 AS INTEGER) AS pos, unnest(href) AS href,
         unnest(label) AS label
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS href,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS label FROM pages))"""


@query(f"WITH {_LINKS} SELECT page_id, pos, href, label FROM li WHERE href <> ''")
def q_listing_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Listing items of every page."""
    return listing.link_rows(V.table(spark, sf, "pages"))


def _cutoff_sql(page_rows: int) -> str:
    return f"""WITH {_LINKS},
first AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1),
pg AS (SELECT page_id, count(*) AS n, count(f.href) AS fresh
       FROM li LEFT JOIN first f USING (page_id, pos) GROUP BY page_id),
walk AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS turn,
                lead(page_id) OVER (ORDER BY page_id) AS next FROM pg),
stop AS (SELECT min(CASE WHEN page_id <> turn THEN turn - 1
                         WHEN n < {page_rows} OR fresh = 0 OR next IS DISTINCT FROM page_id + 1 THEN page_id END) AS last_page
         FROM walk)
SELECT page_id, pos, href FROM first WHERE page_id <= (SELECT last_page FROM stop)"""


@query(_cutoff_sql(4))
def q_listing_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen items up to the page where a crawl would have ended."""
    rows = listing.link_rows(V.table(spark, sf, "pages"))
    kept = listing.crawl_cutoff(rows, ["href"], page="page_id", page_rows=4)
    return kept.select("page_id", "pos", "href")


@query(_cutoff_sql(5))
def q_listing_short_page(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a limit that makes a page count as short earlier."""
    rows = listing.link_rows(V.table(spark, sf, "pages"))
    kept = listing.crawl_cutoff(rows, ["href"], page="page_id", page_rows=5)
    return kept.select("page_id", "pos", "href")


@query("""SELECT CAST(c_custkey // 50 AS BIGINT) AS page,
       c_name || CASE c_custkey % 3 WHEN 0 THEN ' & Co''s' WHEN 1 THEN chr(160) || chr(8217) ELSE '' END AS name,
       CASE WHEN n_regionkey < 4 THEN n_name END AS team,
       CAST(floor(abs(c_acctbal)) AS INTEGER) AS value,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'RB' WHEN 'MACHINERY' THEN 'QB' WHEN 'FURNITURE' THEN 'K' END AS position
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""")
def q_listing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Listing blocks parsed back from pages that are rendered from the customers.

    A page holds 50 customers; a negative balance is rendered as an empty value, which
    makes the row invalid. Names hold entities, and class names come in all three quotings.
    """
    kind = F.col("c_custkey") % 3
    entities = F.when(kind == 0, " &amp; Co&#x27;s").when(kind == 1, "&nbsp;&rsquo;").otherwise("")
    opening = (
        F.when(kind == 0, '<div class="onePlayer row">')
        .when(kind == 1, "<div id='x' class='row onePlayer'>")
        .otherwise("<div class=onePlayer>")
    )
    nation = V.table(spark, sf, "nation")
    segment = F.col("c_mktsegment")
    position = (
        F.when(segment == "BUILDING", "rb12")
        .when(segment == "MACHINERY", "QB1")
        .when(segment == "FURNITURE", "kc RB1")
        .otherwise("RDP")
    )
    team = F.when(F.col("n_regionkey") < 4, F.col("n_name")).otherwise("")
    value = F.when(F.col("c_acctbal") >= 0, F.format_number(F.floor("c_acctbal"), 0)).otherwise("")
    block = F.concat(
        opening,
        F.lit('<div class="player-name"><p><a href="#"> '),
        F.col("c_name"), entities,
        F.lit('</a></p><span class="player-team"> '), team,
        F.lit(' </span></div><div class="position-team"><p>'), position,
        F.lit('</p></div><div class="value"><p>'), value, F.lit("</p></div></div>"),
    )
    pages = (
        V.table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.floor(F.col("c_custkey") / 50).alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("c_custkey", block.alias("html")))).alias("blocks"))
        .select("page", F.concat(
            F.lit("<html><body>"), F.array_join(F.transform("blocks", lambda b: b["html"]), "\n"),
            F.lit("</body></html>")).alias("html"))
    )
    return listing.listing_rows(pages).select("page", "name", "team", "value", "position")


@query("""SELECT CAST(c_custkey // 50 AS BIGINT) AS page, c_name || ' of ' || n_name AS name, n_name || ' ' || n_regionkey AS team,
       CAST(floor(c_acctbal) AS INTEGER) AS value, CASE WHEN c_custkey % 4 <> 0 THEN 'WR' END AS position
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND c_custkey % 5 <> 0""")
def q_listing_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Listing blocks whose fields hold elements of their own names, parsed back from rendered pages.

    Names have links around a nested span, teams a span in a span, values a ``div`` before the
    paragraph that counts, positions a ``div`` in a ``div`` and a void element. Every fifth block
    closes its name before the link, which makes the row invalid.
    """
    rows = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    broken, plain = F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 4 == 0
    number = F.when(F.col("c_acctbal") >= 0, F.format_number(F.floor("c_acctbal"), 0)).otherwise("")
    block = F.concat(
        F.lit('<div class="onePlayer"><div class="player-name"><div><b>#</b></div><p>'),
        F.when(broken, "</p></div><div><p>").otherwise(""),
        F.lit('<a href="#"><span>'), F.col("c_name"), F.lit("</span> of <!-- <a> --><i>"), F.col("n_name"), F.lit("</i></a></p>"),
        F.lit('<span class="player-team"><span class="x">'), F.col("n_name"), F.lit("</span><br> "), F.col("n_regionkey").cast("string"),
        F.lit('</span></div><div class="value"><div><div>up</div></div><p>'), number, F.lit("<p>9</p></p></div>"),
        F.lit('<div class="position-team"><div><div>'), F.when(plain, "none").otherwise("x"), F.lit("</div><hr>"),
        F.when(plain, "").otherwise(" wr3"), F.lit("</div></div><div>QB1</div></div>"),
    )
    pages = rows.groupBy(F.floor(F.col("c_custkey") / 50).alias("page"))
    pages = pages.agg(F.array_sort(F.collect_list(F.struct("c_custkey", block.alias("html")))).alias("blocks"))
    html = F.array_join(F.transform("blocks", lambda b: b["html"]), " ")
    return listing.listing_rows(pages.select("page", html.alias("html"))).select("page", "name", "team", "value", "position")
