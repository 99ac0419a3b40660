"""Aggregation, windows, sorting, pages and set operations (inventory D1-D19, E1-E13, F1-F8, G1-G5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cursor_decode, cursor_encode, micros_iso, sha256_hex
from ..operators import paging
from ..operators.ranking import carry_forward, distinct_on, latest_per_key, runs_of, sample_strata, top_n
from ..operators.statistics import clamped_histogram, cumulative_buckets, floor_percentile, nearest_rank_percentile
from .registry import query


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def agg_count(t):
    return t.lineitem.where("l_quantity > 25").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS o_custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) AS newest FROM customer")
def agg_max_default(t):
    newest = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return t.customer.select(F.col("c_custkey").alias("o_custkey")).join(newest, "o_custkey", "left").select("o_custkey", F.coalesce("m", F.lit(0)).alias("newest"))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def agg_distinct(t):
    return t.documents.select("source").distinct().orderBy("source")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
    count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS skipped, count(*) AS total FROM events GROUP BY user_id"""
)
def agg_conditional_counts(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "error").alias("failed"),
        F.count_if(~kind.isin("purchase", "error")).alias("skipped"), F.count("*").alias("total"),
    )


@query(
    """WITH due AS (SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'
    UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'events', count(*) FROM events WHERE value < 1)
    SELECT kind, n AS total, least(n, 100) AS batch, greatest(n - 100, 0) AS deferred FROM due"""
)
def purge_deferred(t):
    """How much of what is due fits a batch of a hundred, and how much has to wait."""
    due = [
        t.orders.where(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("orders")),
        t.customer.where("c_acctbal < 0").agg(F.count("*").alias("n")).withColumn("kind", F.lit("customers")),
        t.events.where("value < 1").agg(F.count("*").alias("n")).withColumn("kind", F.lit("events")),
    ]
    rows = due[0].unionByName(due[1]).unionByName(due[2])
    return rows.select("kind", F.col("n").alias("total"), F.least("n", F.lit(100)).cast("long").alias("batch"), F.greatest(F.col("n") - 100, F.lit(0)).cast("long").alias("deferred"))


@query(
    """SELECT event_type, coalesce(percentile_disc(0.1) WITHIN GROUP (ORDER BY value), 0) AS p10, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY value), 0) AS p50,
    coalesce(percentile_disc(0.9) WITHIN GROUP (ORDER BY value), 0) AS p90 FROM events GROUP BY event_type"""
)
def pct_nearest_rank(t):
    return t.events.groupBy("event_type").agg(*[nearest_rank_percentile("value", q).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)])


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.9 * n)) THEN value END) AS p90,
    max(value) AS top FROM r GROUP BY event_type"""
)
def pct_floor_index(t):
    return floor_percentile(t.events, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "top": 1.0})


@query(
    """SELECT i::INTEGER AS bin, (SELECT count(*) FROM lineitem WHERE greatest(0, least(10, round(l_quantity / 4))) = i) AS n FROM (SELECT unnest(range(0, 11)) AS i)"""
)
def hist_clamped(t):
    return clamped_histogram(t.lineitem, F.col("l_quantity") / 4, 0, 10)


@query(
    """SELECT d.lang, count(*) AS generated, count(l.doc_id) AS judged, coalesce(round(avg(l.quality) * 10) / 10, 0) AS quality,
    coalesce(round(sum(l.quality) * 1000.0 / nullif(count(l.doc_id), 0)) / 1000, 0) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang"""
)
def agg_dual_denominator(t):
    """Rates over what was judged, beside counts over all that was made."""
    got = t.documents.select("doc_id", "lang").join(t.labels.withColumn("seen", F.lit(1)), "doc_id", "left")
    share = F.round(F.sum("quality") * 1000.0 / F.nullif(F.count("seen"), F.lit(0))) / 1000
    return got.groupBy("lang").agg(
        F.count("*").alias("generated"), F.count("seen").alias("judged"), F.coalesce(F.round(F.avg("quality") * 10) / 10, F.lit(0.0)).alias("quality"),
        F.coalesce(share, F.lit(0.0)).alias("share"),
    )


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_having_dup(t):
    return t.documents.groupBy(sha256_hex(F.col("text")).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    """WITH a AS (SELECT source, list_sort(list_distinct(list(lang))) AS x FROM documents GROUP BY source), b AS (SELECT source, list_sort(list_distinct(list(lang))) AS y
    FROM documents WHERE n_chars > 300 GROUP BY source) SELECT a.source, x = coalesce(y, []) AS same FROM a LEFT JOIN b ON a.source = b.source"""
)
def set_equality(t):
    langs = lambda df, name: df.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias(name))  # noqa: E731  few values by nature
    got = langs(t.documents, "x").join(langs(t.documents.where("n_chars > 300"), "y"), "source", "left")
    return got.select("source", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


@query(
    """SELECT quality, round(count(*) FILTER (toxic = 1 AND doc_id % 7 <> 0) * 1.0 / nullif(count(*) FILTER (doc_id % 7 <> 0), 0), 6) AS rate FROM labels GROUP BY quality"""
)
def rate_excluding_class(t):
    kept = F.col("doc_id") % 7 != 0
    rate = F.count_if((F.col("toxic") == 1) & kept) / F.nullif(F.count_if(kept), F.lit(0))
    return t.labels.groupBy("quality").agg(F.round(rate, 6).alias("rate"))


@query(
    """SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) GROUP BY event_type, le"""
)
def metric_histogram_buckets(t):
    return cumulative_buckets(t.events, ["event_type"], "value", [1.0, 5.0, 10.0, 50.0, 100.0])


# -- windows -------------------------------------------------------------------


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3"""
)
def window_topn_per_group(t):
    best = top_n(t.lineitem, ["l_suppkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"], 3)
    return best.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    """SELECT conv_id, kind, turn FROM (SELECT conv_id, coalesce(nullif(role, 'system'), 'turn-' || turn) AS kind, turn,
    row_number() OVER (PARTITION BY conv_id, coalesce(nullif(role, 'system'), 'turn-' || turn) ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"""
)
def distinct_on_key(t):
    rows = t.conversations.select("conv_id", F.coalesce(F.nullif("role", F.lit("system")), F.concat(F.lit("turn-"), F.col("turn"))).alias("kind"), "turn")
    return distinct_on(rows, ["conv_id", "kind"], [F.desc("turn")])


@query(
    """WITH one AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    two AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars < 500, source, doc_id) AS rn FROM one WHERE r = 1) SELECT doc_id, lang, source FROM two WHERE rn <= 4"""
)
def evalset_sample(t):
    """One document for each stratum and group, then a few groups of each stratum, long ones first."""
    return sample_strata(t.documents, "lang", "source", F.col("n_chars") < 500, [F.desc("n_chars"), "doc_id"], 4).select("doc_id", "lang", "source")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_group(t):
    return latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    """WITH m AS (SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = x.conv_id)) AS until
    FROM conversations x WHERE role = 'user') SELECT conv_id, turn AS starts, until AS ends FROM m"""
)
def marker_spans(t):
    """Spans from each marker row up to the next one, or to the end."""
    last = t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("stop"))
    next_ = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", next_.alias("next"))
    return rows.join(last, "conv_id").select("conv_id", F.col("turn").alias("starts"), F.coalesce("next", "stop").alias("ends"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN event_id END AS chapter, CASE WHEN event_type = 'purchase' THEN event_id END AS section FROM events),
    c AS (SELECT *, last_value(chapter IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ch FROM e)
    SELECT event_id, ch AS chapter, last_value(section IGNORE NULLS) OVER (PARTITION BY user_id, ch ORDER BY ts, event_id) AS section FROM c"""
)
def forward_fill_reset(t):
    """Headers carried forward; a new chapter clears the section."""
    rows = t.events.select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("chapter"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("section")
    )
    return carry_forward(rows, ["user_id"], ["ts", "event_id"], ["chapter", "section"]).select("event_id", "chapter", "section")


@query(
    """WITH a AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS starts, max(ts) AS ends FROM b GROUP BY user_id, run"""
)
def gaps_islands(t):
    rows = runs_of(t.events, ["user_id"], ["ts", "event_id"], "event_type", "run")
    return rows.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"), F.min("ts").alias("starts"), F.max("ts").alias("ends"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_content_hash(t):
    """The first of equal contents within a document group; only digests are shuffled."""
    rows = t.documents.select("source", "doc_id", sha256_hex(F.col("text")).alias("digest"))
    return rows.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


# -- sorting and pages ---------------------------------------------------------


@query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders ORDER BY priority DESC NULLS FIRST, o_orderkey")
def sort_multi(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return rows.orderBy(F.col("priority").desc_nulls_first(), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem ORDER BY net DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def topk_expr(t):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", net).orderBy(F.desc("net"), "l_orderkey", "l_linenumber", "l_partkey").limit(25)


@query(
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey < 9000)
    SELECT o_orderkey, (SELECT count(*) FROM p WHERE rn <= 21) > 20 AS has_next, (SELECT o_orderkey FROM p WHERE rn = 20) AS next_cursor FROM p WHERE rn <= 20"""
)
def page_keyset(t):
    return paging.page(t.orders.select("o_orderkey"), "o_orderkey", size=20, after=9000, descending=True)


@query("SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def cursor_roundtrip(t):
    """Cursors are opaque: base64url of JSON without padding; encoding and reading back is the identity."""
    made = t.orders.select("o_orderkey", cursor_encode(F.struct(F.col("o_orderkey").alias("id"))).alias("cursor"))
    return made.select("o_orderkey", cursor_decode(F.col("cursor"), "id long")["id"].alias("decoded"))


@query(
    """WITH m AS (SELECT conv_id * 1000 + turn AS id FROM conversations)
    SELECT id, 'after' AS side FROM (SELECT id FROM m WHERE id > 20000 ORDER BY id LIMIT 10) UNION ALL SELECT id, 'before' FROM (SELECT id FROM m WHERE id < 20000 ORDER BY id DESC LIMIT 10)"""
)
def page_bidirectional(t):
    ids = t.messages().select(F.col("message_id").alias("id"))
    ahead = paging.page(ids, "id", size=10, after=20000).select("id", F.lit("after").alias("side"))
    return ahead.unionByName(paging.page(ids, "id", size=10, after=20000, descending=True).select("id", F.lit("before").alias("side")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS cursor FROM events")
def cursor_micros(t):
    return t.events.select("event_id", micros_iso(F.col("ts")).alias("cursor"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def purge_batch(t):
    due = t.orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return due.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


# -- sets ----------------------------------------------------------------------

_AB = """a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount = 0.1)"""


def _ab(t):
    return (
        t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("id")).distinct(),
        t.lineitem.where("l_discount = 0.1D").select(F.col("l_partkey").alias("id")).distinct(),
    )


@query(f"WITH {_AB} SELECT id, bool_or(x) AS in_a, bool_or(NOT x) AS in_b FROM (SELECT id, true AS x FROM a UNION ALL SELECT id, false FROM b) GROUP BY id")
def set_union_dedup(t):
    a, b = _ab(t)
    both = a.withColumn("x", F.lit(True)).unionByName(b.withColumn("x", F.lit(False)))
    return both.groupBy("id").agg(F.bool_or("x").alias("in_a"), F.bool_or(~F.col("x")).alias("in_b"))


@query(f"WITH {_AB} SELECT id FROM a EXCEPT SELECT id FROM b")
def set_except(t):
    a, b = _ab(t)
    return a.join(b, "id", "left_anti")


@query(f"WITH {_AB} SELECT id FROM a INTERSECT SELECT id FROM b")
def set_intersect(t):
    a, b = _ab(t)
    return a.join(b, "id", "left_semi")


_DIAG = """d AS (SELECT o_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus)) AS b, list_distinct(list(l_returnflag) FILTER (l_quantity > 40)) AS c
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


def _diagnostics(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"), F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))).alias("c")
    )
    return rows.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")


@query(f"WITH {_DIAG} SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(a, b), coalesce(c, [])))), ',') AS found FROM d")
def set_union_arrays(t):
    return _diagnostics(t).select("o_orderkey", F.array_join(F.array_sort(F.array_union(F.array_union("a", "b"), "c")), ",").alias("found"))


@query(f"WITH {_DIAG} SELECT o_orderkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(c, []), x))), ',') AS remaining FROM d")
def set_waiver(t):
    """What is diagnosed less what is waived."""
    return _diagnostics(t).select("o_orderkey", F.array_join(F.array_sort(F.array_except("a", "c")), ",").alias("remaining"))
