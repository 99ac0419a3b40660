"""Mutations and record lifecycle (inventory L1-L15, C9, M10, I18, I22-I24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as life
from .registry import query


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 1000000 + n_nationkey, 1.0 FROM nation""")
def dml_upsert(t):
    old = t.customer.select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 10 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return life.upsert(old, new.unionByName(t.nation.select((F.lit(1000000) + F.col("n_nationkey")).cast("long").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"))), ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AS affected FROM orders")
def dml_conditional_update(t):
    return life.update_where(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", o_orderstatus=F.lit("F"))


_OPTIMISTIC = """old AS (SELECT c_custkey, c_acctbal, (c_custkey % 3)::INTEGER AS version FROM customer), ch AS (SELECT c_custkey, c_custkey * 1.0::DOUBLE AS c_acctbal, 1::INTEGER AS version FROM customer WHERE c_custkey % 2 = 0)"""


@query(
    f"""WITH {_OPTIMISTIC} SELECT 'row' AS kind, o.c_custkey, CASE WHEN ch.version = o.version THEN ch.c_acctbal ELSE o.c_acctbal END AS c_acctbal, CASE WHEN ch.version = o.version THEN o.version + 1 ELSE o.version END AS version FROM old o LEFT JOIN ch USING (c_custkey)
    UNION ALL SELECT 'conflict', ch.c_custkey, ch.c_acctbal, ch.version FROM ch JOIN old o USING (c_custkey) WHERE ch.version <> o.version"""
)
def dml_optimistic(t):
    old = t.customer.select("c_custkey", "c_acctbal", (F.col("c_custkey") % 3).cast("int").alias("version"))
    changes = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_custkey").cast("double").alias("c_acctbal"), F.lit(1).alias("version"))
    new, conflicts = life.optimistic(old, changes, "c_custkey", "version", ["c_acctbal"])
    return new.select(F.lit("row").alias("kind"), "*").unionByName(conflicts.select(F.lit("conflict").alias("kind"), "*"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'CANCELLED' WHEN o_orderkey % 5 = 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END ELSE o_orderstatus END AS status FROM orders"""
)
def job_finalize(t):
    state = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).when(F.col("o_orderkey") % 4 == 0, "CANCELLING").otherwise("RUNNING")
    failed = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    return t.orders.select("o_orderkey", life.finalised(state, failed).alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'INTERRUPTED' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_sweep(t):
    return life.update_where(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus").isin("O", "P"), o_orderstatus=F.lit("INTERRUPTED")).drop("affected")


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2000-01-01' WHEN c_nationkey = 7 THEN TIMESTAMP '2001-01-01' END AS deleted_at FROM customer)
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, c.deleted_at) AS deleted_at FROM orders LEFT JOIN c ON o_custkey = c_custkey"""
)
def dml_soft_delete(t):
    """Customers of a nation are deleted, their orders with them; earlier deletions keep their time."""
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    customers = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") < 0, ts("2000-01-01")).alias("deleted_at"))
    customers = life.soft_deleted(customers, F.col("c_nationkey") == 7, ts("2001-01-01"))
    orders = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return life.cascade(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "deleted_at")


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), og AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM og)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM og) UNION ALL SELECT 'detached', count(*) FROM supplier WHERE s_nationkey = 3"""
)
def purge_cascade(t):
    left = life.purged(
        {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, t.customer.where("c_acctbal < 0").select("c_custkey"),
        [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")],
    )
    staff = life.detached(t.supplier, t.nation.where("n_nationkey = 3").select("n_nationkey"), "s_nationkey").where("s_nationkey is null")
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in [*left.items(), ("detached", staff)]]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'deleted-' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def dml_anonymize(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    blank = life.update_where(rows, F.col("c_acctbal") < 0, c_name=F.concat(F.lit("deleted-"), "c_custkey"), c_mktsegment=F.lit(None).cast("string"))
    return blank.select("c_custkey", "c_name", "c_mktsegment")


@query(
    """WITH asked AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0), cited AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
    ok AS (SELECT * FROM asked WHERE o_orderkey NOT IN (SELECT l_orderkey FROM cited)), rest AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ok))
    SELECT 'refused' AS kind, o_orderkey AS id FROM asked WHERE o_orderkey IN (SELECT l_orderkey FROM cited) UNION ALL SELECT 'deleted', o_orderkey FROM ok
    UNION ALL SELECT 'parent', o_custkey FROM (SELECT DISTINCT o_custkey FROM ok) WHERE o_custkey NOT IN (SELECT o_custkey FROM rest)"""
)
def delete_guarded(t):
    """Versions that are cited are refused; a parent goes with its last version."""
    asked = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")
    cited = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    ok = asked.join(cited, "o_orderkey", "left_anti")
    rest = t.orders.join(ok.select("o_orderkey"), "o_orderkey", "left_anti")
    parents = ok.select("o_custkey").distinct().join(rest, "o_custkey", "left_anti").select(F.lit("parent").alias("kind"), F.col("o_custkey").alias("id"))
    refused = asked.join(cited, "o_orderkey", "left_semi").select(F.lit("refused").alias("kind"), F.col("o_orderkey").alias("id"))
    return refused.unionByName(ok.select(F.lit("deleted").alias("kind"), F.col("o_orderkey").alias("id"))).unionByName(parents)


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS n_active, count(*) FILTER (o_orderstatus = 'P') <= 1 AS ok FROM orders")
def assert_singleton(t):
    return life.assert_at_most_one(t.orders, F.col("o_orderstatus") == "P")


@query("SELECT user_id * 1000 + (event_id % 50) AS request, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_request(t):
    """The first event of each client request."""
    rows = t.events.select((F.col("user_id") * 1000 + F.col("event_id") % 50).alias("request"), "event_id")
    return rows.groupBy("request").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, bool_or(n > 1) AS revoked FROM (SELECT user_id, event_id % 500 AS token, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def family_reuse(t):
    return life.reused_families(t.events.withColumn("token", F.col("event_id") % 500), "user_id", "token", "ts")


@query(
    """WITH v AS (SELECT source, lang, n_chars % 7 AS revision, doc_id FROM documents), m AS (SELECT *, max(revision) OVER (PARTITION BY source, lang) AS top FROM v)
    SELECT doc_id, CASE WHEN revision = top THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM m"""
)
def supersede_revisions(t):
    return life.superseded(t.documents.withColumn("revision", F.col("n_chars") % 7), ["source", "lang"], "revision").select("doc_id", "status")


@query(
    """WITH d AS (SELECT source, sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY ALL), known AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE doc_id % 5 = 0),
    fresh AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = d.source AND k.h = d.h))
    SELECT source, (SELECT count(*) FROM known k WHERE k.source = f.source) + 1 AS revision, count(*) AS chunks FROM fresh f GROUP BY source"""
)
def ingest_revision(t):
    """Content that a group does not have yet becomes its next revision; known content is left alone."""
    rows = t.documents.select("source", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    known = rows.where("doc_id % 5 = 0").select("source", "h").distinct()
    fresh = rows.select("source", "h").distinct().join(known, ["source", "h"], "left_anti").groupBy("source").agg(F.count("*").alias("chunks"))
    before = known.groupBy("source").agg(F.count("*").alias("n"))
    return fresh.join(before, "source", "left").select("source", (F.coalesce("n", F.lit(0)) + 1).alias("revision"), "chunks")


@query(
    """WITH denied AS (SELECT user_id, event_id AS d, ts AS since FROM events WHERE event_type = 'error' AND event_id % 5 = 0)
    SELECT e.event_id, EXISTS (SELECT 1 FROM denied WHERE denied.user_id = e.user_id AND e.ts >= since AND e.ts < since + INTERVAL 960 SECOND) AS denied FROM events e"""
)
def ttl_denylist(t):
    """An entry holds for its lifetime: the latest entry not after an event decides."""
    from ..streaming.keyed import live_entry

    entries = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    return live_entry(t.events, "user_id", "ts", entries, 960, "denied").select("event_id", "denied")


@query(
    """WITH a AS (SELECT event_id, user_id * 100 + event_id % 40 AS token, ts, ts >= TIMESTAMP '2024-01-20' AS late, user_id % 50 = 0 AS unknown FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY token, late OR unknown ORDER BY ts, event_id) AS k FROM a)
    SELECT event_id, CASE WHEN unknown THEN 'unknown' WHEN late THEN 'expired' WHEN k = 1 THEN 'accepted' ELSE 'consumed' END AS outcome FROM f"""
)
def token_consume_once(t):
    """Invitations that may be accepted once, and until a day: rival attempts, the first of which is accepted."""
    token = F.when(F.col("user_id") % 50 != 0, F.col("user_id") * 100 + F.col("event_id") % 40)
    rows = t.events.select("event_id", "ts", token.alias("token"), F.lit("2024-01-20").cast("timestamp_ntz").alias("expires"))
    return life.claimed(rows, "token", "ts", ["event_id"], "expires").select("event_id", "outcome")
