"""Queries over overlay entries."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.operators import overlay as O
from seasonframe.plans.overlay import stored_overlay, upsert_entries
from seasonframe.plans.warehouse import Warehouse, shared_folder, stored_manifest


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_ids(V.coaching(spark, sf), "coaching").drop("ord")


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_ids(V.proposals(spark, sf), "coaching")


@query(f"WITH {V.COACHING} SELECT key, id FROM ex")
def q_entry_id(spark: SparkSession, sf: str) -> DataFrame:
    """Natural key and deterministic id."""
    return _existing(spark, sf).select(O.natural_key("coaching").alias("key"), "id")


@query(f"""WITH {V.COACHING},
p AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
v AS (SELECT ex.key, 'name' AS field, '"' || ex.name || '"' AS old, '"' || p.name || '"' AS new
      FROM ex JOIN p USING (key)
      UNION ALL SELECT ex.key, 'tenureStart', CAST(ex."tenureStart" AS VARCHAR), CAST(p."tenureStart" AS VARCHAR)
      FROM ex JOIN p USING (key)
      UNION ALL SELECT ex.key, 'year', CAST(ex.year AS VARCHAR), CAST(p.year AS VARCHAR) FROM ex JOIN p USING (key))
SELECT key, field, old, new FROM v WHERE old IS DISTINCT FROM new""")
def q_entry_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fields in which the first proposal of a slot differs from the stored entry."""
    key = O.natural_key("coaching").alias("key")
    fields = ["name", "tenureStart", "year"]
    old = _existing(spark, sf).select(key, *fields)
    first = (
        _proposed(spark, sf).groupBy(key).agg(F.min_by(F.struct(*fields), "ord").alias("e")).select("key", "e.*")
    )
    return O.entry_diff(old, first, fields, key="key")


@query(f"""WITH {V.COACHING},
f AS (SELECT key, arg_min(ord, ord) AS first_ord, arg_min(content, ord) AS first_content FROM pr GROUP BY key)
SELECT pr.ord, pr.id, pr.key,
       CASE WHEN ex.key IS NULL AND pr.ord = f.first_ord THEN 'added'
            WHEN pr.content = coalesce(ex.content, f.first_content) THEN 'no-op' ELSE 'conflict' END AS action
FROM pr JOIN f USING (key) LEFT JOIN ex ON ex.key = pr.key""")
def q_upsert_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Action per proposal of a batch, without force."""
    plan = O.upsert_plan(_existing(spark, sf), _proposed(spark, sf), "coaching")
    return plan.select("ord", "id", "key", "action")


@query(f"""WITH {V.COACHING},
s AS (SELECT pr.ord, pr.id, pr.key, pr.content,
             coalesce(lag(pr.content) OVER (PARTITION BY pr.key ORDER BY pr.ord), ex.content) AS before
      FROM pr LEFT JOIN ex ON ex.key = pr.key)
SELECT ord, id, key, CASE WHEN before IS NULL THEN 'added' WHEN before = content THEN 'no-op' ELSE 'updated' END AS action
FROM s""")
def q_upsert_forced(spark: SparkSession, sf: str) -> DataFrame:
    """Action per proposal of a batch, with force."""
    plan = O.upsert_plan(_existing(spark, sf), _proposed(spark, sf), "coaching", force=True)
    return plan.select("ord", "id", "key", "action")


@query(f"""WITH {V.COACHING}
SELECT id, year, team, role, name, "tenureStart" FROM ex
UNION ALL
SELECT id, year, team, role, name, "tenureStart" FROM pr WHERE key NOT IN (SELECT key FROM ex)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1""")
def q_upsert_result(spark: SparkSession, sf: str) -> DataFrame:
    """Entries after the batch, without force."""
    out = O.upsert_result(_existing(spark, sf), _proposed(spark, sf), "coaching")
    return out.select("id", "year", "team", "role", "name", "tenureStart")


@query(f"""WITH {V.COACHING},
l AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1)
SELECT id, year, team, role, name, "tenureStart" FROM l
UNION ALL SELECT id, year, team, role, name, "tenureStart" FROM ex WHERE key NOT IN (SELECT key FROM l)""")
def q_upsert_forced_result(spark: SparkSession, sf: str) -> DataFrame:
    """Entries after the batch, with force."""
    out = O.upsert_result(_existing(spark, sf), _proposed(spark, sf), "coaching", force=True)
    return out.select("id", "year", "team", "role", "name", "tenureStart")


# All four types under plain ids, so that types can share an id. --------------------------------

_ALL = f"""{V.INJURIES}, al AS (
  SELECT 'coaching' AS overlay, 'e' || max(o_orderkey) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, 0 AS place
  FROM orders GROUP BY year(o_orderdate), o_orderpriority, o_orderstatus
  UNION ALL SELECT 'scheme', 'e' || min(o_orderkey), CAST(year(o_orderdate) AS INTEGER), 1
  FROM orders GROUP BY year(o_orderdate), o_orderpriority
  UNION ALL SELECT 'injuries', 'e' || first_event, season, 2 FROM inj
  UNION ALL SELECT 'notes', 'e' || doc_id, NULL, 3 FROM documents)"""


def _stacked(spark: SparkSession, sf: str) -> DataFrame:
    orders = V.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))

    def with_id(df: DataFrame, number: str) -> DataFrame:
        return df.withColumn("id", F.concat(F.lit("e"), F.col(number).cast("string")))

    coaching = V.coaching(spark, sf)
    scheme = orders.groupBy("year", F.col("o_orderpriority").alias("team")).agg(F.min("o_orderkey").alias("first"))
    return O.all_overlays(
        {
            "coaching": O.conform(with_id(coaching, "ord"), "coaching"),
            "scheme": O.conform(with_id(scheme, "first"), "scheme"),
            "injuries": O.conform(with_id(V.injuries(spark, sf), "first_event"), "injuries"),
            "notes": O.conform(with_id(V.table(spark, sf, "documents"), "doc_id"), "notes"),
        }
    )


@query(f"WITH {_ALL} SELECT overlay, id, year FROM al")
def q_overlay_all(spark: SparkSession, sf: str) -> DataFrame:
    """The four types stacked."""
    return _stacked(spark, sf).select("overlay", "id", "year")


@query(f"""WITH {V.COACHING} SELECT id, year, team, role, name FROM ex WHERE year = 1998""")
def q_overlay_list(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one year."""
    return O.list_entries(_existing(spark, sf), 1998).select("id", "year", "team", "role", "name")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"))


@query(f"""WITH {_ALL},
hit AS (SELECT overlay, id FROM al WHERE id IN (SELECT 'e' || p_partkey FROM part)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1)
SELECT overlay, id, year FROM al WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.overlay = al.overlay AND hit.id = al.id)""")
def q_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Entries left after a batch of removals by id."""
    return O.remove_entries(_stacked(spark, sf), _asked(spark, sf)).select("overlay", "id", "year")


@query(f"""WITH {_ALL}
SELECT p.id, arg_min(al.overlay, al.place) AS overlay, count(al.id) > 0 AS found
FROM (SELECT 'e' || p_partkey AS id FROM part) p LEFT JOIN al ON al.id = p.id GROUP BY p.id""")
def q_remove_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The type each asked id is removed from; unknown ids are reported."""
    return O.removal_targets(_stacked(spark, sf), _asked(spark, sf)).select("id", "overlay", "found")


@query(f"""WITH {V.NOTES}, kept AS (
  SELECT * FROM nt WHERE player_id IS NOT NULL AND team IS NULL AND (year IS NULL OR year >= 2012) AND trim(body) <> '')
SELECT player_id, year, sha256(body) AS body, (SELECT count(*) FROM kept) AS record_count, 'no-op' AS again FROM kept""")
def q_overlay_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on players published to a warehouse and once more: what is stored, what the manifest counts, what the second run does."""
    wh = Warehouse(f"{shared_folder(spark)}/overlay-{uuid.uuid4().hex}")
    notes = V.notes(spark, sf).filter("playerId IS NOT NULL AND team IS NULL AND (year IS NULL OR year >= 2012) AND trim(body) <> ''")
    fields = notes.withColumn("ord", F.col("doc_id")).drop("id", "doc_id")
    for hour in (1, 2):
        plan = upsert_entries(spark, "notes", fields, wh, datetime(2028, 1, 1, hour, tzinfo=UTC), current_year=2028)
    again = plan.select("id", F.col("action").alias("again"))
    count = stored_manifest(spark, wh).filter("path = 'overlay/notes'").select("recordCount").scalar()
    stored = stored_overlay(spark, wh, "notes").join(again, "id", "left")
    return stored.select(F.col("playerId").alias("player_id"), "year", F.sha2("body", 256).alias("body"), count.alias("record_count"), "again")
