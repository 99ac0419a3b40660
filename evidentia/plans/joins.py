"""Joins (inventory C1-C18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lookup import first_by, latest_before, mismatched_axes, nest
from .registry import query


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_2(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    """SELECT r_name, n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""
)
def join_snowflake_4(t):
    """The order counts are formed per customer before the dimensions are joined."""
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"))


@query(
    """SELECT l_orderkey, l_linenumber, c_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 48"""
)
def join_snowflake_5(t):
    rows = t.lineitem.where("l_quantity > 48")
    rows = rows.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("l_orderkey", "l_linenumber", "c_name", "r_name")


@query("SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left_count(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"))


@query("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_lookup(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


@query(
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 45)"""
)
def join_semi_exists(t):
    inner = t.orders.join(t.lineitem.where("l_returnflag = 'R' and l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"))
    return t.customer.join(inner, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_count_guard(t):
    return t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_linenumber) AS n
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def nest_children(t):
    """Parents with their children as an ordered array, here shown as text."""
    got = nest(t.orders.select("o_orderkey"), t.lineitem, {"l_orderkey": "o_orderkey"}, ["l_linenumber", "l_partkey"], "children")
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"], c["l_partkey"])), ",")
    return got.select("o_orderkey", text.alias("lines"), F.size("children").cast("long").alias("n"))


@query(
    """SELECT c.conv_id, c.turn, coalesce(f.title, c.role) AS title FROM conversations c
    LEFT JOIN (SELECT conv_id, left(text, 40) AS title FROM conversations WHERE turn = 0 AND role = 'user') f ON c.conv_id = f.conv_id"""
)
def update_from_join(t):
    first = t.conversations.where("turn = 0 and role = 'user'").select("conv_id", F.left("text", F.lit(40)).alias("title"))
    return t.conversations.join(first, "conv_id", "left").select("conv_id", "turn", F.coalesce("title", "role").alias("title"))


@query("SELECT c_custkey, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1900-01-01') AS last_order FROM customer")
def scalar_subquery_max(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("d"))
    fallback = F.lit("1900-01-01").cast("timestamp_ntz")
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("d", fallback).alias("last_order"))


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_order FROM customer")
def scalar_subquery_first(t):
    first = first_by(t.orders, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "first_order"})
    return t.customer.select("c_custkey").join(first, "c_custkey", "left")


@query(
    """SELECT 'unlabelled' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT 'unused' AS side, doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"""
)
def join_anti_both(t):
    good = t.labels.where("quality = 1").select("doc_id")
    left = t.documents.select("doc_id").join(good, "doc_id", "left_anti").select(F.lit("unlabelled").alias("side"), "doc_id")
    right = good.join(t.documents.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select(F.lit("unused").alias("side"), "doc_id")
    return left.unionByName(right)


@query(
    """WITH listed AS (SELECT * FROM (VALUES (10, 'Brand#2', 11), (1, 'Brand#17', 28), (2, 'Brand#0', 1), (3, 'none', 5)) v(p_partkey, brand, size))
    SELECT p.p_partkey, l.p_partkey IS NOT NULL AND p_brand = brand AND p_size = size AS listed,
    l.p_partkey IS NOT NULL AND NOT (p_brand = brand AND p_size = size) AS expired,
    concat_ws(',', CASE WHEN p_brand <> brand THEN 'brand' END, CASE WHEN p_size <> size THEN 'size' END) AS axes
    FROM part p LEFT JOIN listed l ON p.p_partkey = l.p_partkey"""
)
def expiry_mismatch(t):
    """A fixed list by identity and state: an entry whose state no longer matches has expired."""
    listed = t.spark.createDataFrame([(10, "Brand#2", 11), (1, "Brand#17", 28), (2, "Brand#0", 1), (3, "none", 5)], "p_partkey long, brand string, size int")
    got = t.part.join(F.broadcast(listed), "p_partkey", "left")  # four rows
    axes = mismatched_axes({"brand": ("p_brand", "brand"), "size": ("p_size", "size")})
    found = F.col("brand").isNotNull()
    return got.select("p_partkey", (found & (F.size(axes) == 0)).alias("listed"), (found & (F.size(axes) > 0)).alias("expired"), F.array_join(axes, ",").alias("axes"))


@query(
    """WITH seen AS (SELECT user_id, arg_max(value, ts) AS baseline FROM events WHERE event_type = 'view' GROUP BY user_id),
    now_ AS (SELECT user_id, nullif(max(event_id) % 5, 0) AS k, arg_max(value, ts) AS current FROM events GROUP BY user_id)
    SELECT n.user_id, s.user_id IS NULL OR n.k IS NULL OR NOT (s.baseline = n.current) AS candidate FROM now_ n LEFT JOIN seen s ON n.user_id = s.user_id"""
)
def revision_candidates(t):
    """Records to look at again: never fetched, of unknown state, or changed since the latest fetch.

    An unknown baseline makes a candidate; null is never taken as equal.
    """
    seen = latest_before(t.events.where("event_type = 'view'"), "user_id", "ts", ["value"]).withColumnRenamed("value", "baseline")
    now = t.events.groupBy("user_id").agg(F.nullif(F.max("event_id") % 5, F.lit(0)).alias("k"), F.max_by("value", "ts").alias("current"))
    got = now.join(seen.withColumn("fetched", F.lit(True)), "user_id", "left")
    same = F.col("fetched").isNotNull() & F.col("k").isNotNull() & (F.col("baseline") == F.col("current"))
    return got.select("user_id", (~F.coalesce(same, F.lit(False))).alias("candidate"))
