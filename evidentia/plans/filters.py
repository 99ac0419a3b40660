"""Scans, projections and predicates (inventory A1-A2, B1-B15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine.views import CHUNKS_SQL
from ..operators.scope import all_of, corpus_predicate, scoped
from .registry import query


@query("SELECT * FROM region")
def scan_region(t):
    return t.region


@query("SELECT o_orderkey FROM orders")
def scan_pruned_orders(t):
    return t.orders.select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def filter_eq_and(t):
    return t.lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in_list(t):
    return in_list(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is listed; an empty list selects nothing."""
    return df.where(F.col(column).isin(values) if values else F.lit(False))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05 AND l_returnflag <> 'R'")
def filter_ranges(t):
    return t.lineitem.where("l_quantity > 30 and l_discount < 0.05D and l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")


@query(
    """SELECT c_custkey, segment IS NULL AS no_segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation FROM customer)
    WHERE nation IS NOT NULL"""
)
def filter_null_checks(t):
    rows = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return rows.where(F.col("nation").isNotNull()).select("c_custkey", F.col("segment").isNull().alias("no_segment"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WID_ET%'")
def filter_ilike(t):
    """The wildcards of the pattern stay wildcards."""
    return t.part.where(F.col("p_name").ilike("%WID_ET%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_optional(t):
    """Filters that are not given are left out of the plan."""
    given = {"o_orderstatus": "F", "o_orderpriority": None, "o_totalprice": 100000}
    made = {
        "o_orderstatus": lambda v: F.col("o_orderstatus") == v,
        "o_orderpriority": lambda v: F.col("o_orderpriority") == v,
        "o_totalprice": lambda v: F.col("o_totalprice") > v,
    }
    return all_of(t.orders, [made[k](v) for k, v in given.items() if v is not None]).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 5000)")
def keyset_rowvalue(t):
    at = F.struct(F.lit("1996-01-01").cast("timestamp_ntz").alias("d"), F.lit(5000).cast("long").alias("k"))
    return t.orders.where(F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")) < at).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey < 5000)")
def keyset_or_form(t):
    at = F.lit("1996-01-01").cast("timestamp_ntz")
    day = F.col("o_orderdate")
    return t.orders.where((day < at) | ((day == at) & (F.col("o_orderkey") < 5000))).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')")
def filter_json_field(t):
    k = F.get_json_object("props", "$.k")
    return t.events.where(k.isin("1", "2", "3")).select("event_id", k.cast("int").alias("k"))


@query("SELECT doc_id FROM documents WHERE [source, lang] = ['src0', 'en']")
def filter_array_eq(t):
    path = F.array("source", "lang")
    return t.documents.where(path == F.array(F.lit("src0"), F.lit("en"))).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND NOT c_acctbal < 0")
def scope_tenant(t):
    """A negative balance stands for a deleted row."""
    rows = t.customer.withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.current_timestamp()))
    return rows.transform(scoped, "c_nationkey", 7).select("c_custkey", "c_name")


@query("SELECT o_custkey AS c_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 7) AS found FROM (SELECT DISTINCT o_custkey FROM orders)")
def exists_in_scope(t):
    """Whether the customer of each order exists in the scope, deleted or not."""
    asked = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    there = t.customer.where("c_nationkey = 7").select("c_custkey").distinct().withColumn("found", F.lit(True))
    return asked.join(there, "c_custkey", "left").select("c_custkey", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_star_plus(t):
    return t.lineitem.select("*", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_name END AS large_name, nullif(p_type, 'PROMO') AS kind FROM part")
def project_conditional(t):
    return t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("large_name"), F.nullif("p_type", F.lit("PROMO")).alias("kind")
    )


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE model = 'm1' AND guideline IN ('src0', 'src1', 'src2')")
def corpus_filtered(t):
    return t.chunks().where(corpus_predicate("m1", guidelines=["src0", "src1", "src2"])).select("chunk_id")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
