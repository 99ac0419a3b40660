"""The document pipeline (inventory I1-I25, C17, A9-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curated, guideline
from ..operators.splitting import split_by_length as split_texts
from ..sources.documents import extracted
from .registry import query


def _pages(t):
    """Conversations as documents: each turn a page with one recommendation, system turns without a grade."""
    n = F.col("turn") + 1
    grade = F.when(F.col("role") == "system", "").otherwise(" B/Moderate")
    text = F.concat(n, F.lit("\nⅣ. 권고사항\n1. "), F.col("role"), F.lit("\n【R"), n, F.lit("】\n권고안 권고등급/근거수준\n"), F.col("text"), grade, F.lit("\n(1) 배경\n"), F.col("text"))
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), text.alias("text"))


@query(
    """SELECT conv_id AS doc_id, 'R' || (turn + 1) AS number, 'Ⅳ. 권고사항 > 1. ' || role AS path, CASE WHEN role <> 'system' THEN 'B' END AS grade, CASE WHEN role <> 'system' THEN 'Moderate' END AS level,
    (turn + 1)::INTEGER AS page, (2 * length(regexp_replace(text, '[\\s-]+', '', 'g')) + 5)::BIGINT AS chars FROM conversations"""
)
def chunks_by_number(t):
    """What the chunks of each recommendation hold together: path, rating, page, and their characters without blanks and hyphens, which line breaks may change."""
    rows = guideline.chunk_documents(_pages(t)).withColumn("chars", F.length(F.regexp_replace("content", r"[\s-]+", "")))
    got = rows.groupBy("doc_id", "number").agg(F.max(F.array_join("path", " > ")).alias("path"), F.max("grade").alias("grade"), F.max("level").alias("level"), F.max("page_end").alias("page"), F.sum("chars").alias("chars"))
    return got.select("doc_id", "number", "path", "grade", "level", "page", "chars")


@query()
def chunk_guidelines(t):
    return guideline.chunk_documents(_pages(t))


@query(
    """SELECT conv_id AS doc_id, count(*)::INTEGER AS numbers, 0::INTEGER AS missing, count(*) FILTER (role = 'system')::INTEGER AS ungraded, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 'ungraded' END AS failure
    FROM conversations GROUP BY conv_id"""
)
def parse_guard(t):
    got = guideline.guarded(guideline.diagnose_documents(_pages(t)))
    return got.select("doc_id", F.size("numbers").alias("numbers"), F.size("missing").alias("missing"), F.size("ungraded").alias("ungraded"), "failure")


@query(
    """SELECT conv_id AS doc_id, count(*) FILTER (role = 'system' AND turn <> 0)::INTEGER AS ungraded, (CASE WHEN count(*) FILTER (role = 'system' AND turn = 0) = 0 THEN 1 ELSE 0 END)::INTEGER AS unused FROM conversations GROUP BY conv_id"""
)
def waiver_applied(t):
    """R1 is waived in every document; where nothing is wrong with it, the waiver has expired."""
    waivers = t.conversations.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("waived", F.array(F.lit("R1")))
    got = guideline.waived(guideline.diagnose_documents(_pages(t)), waivers)
    return got.select("doc_id", F.size("ungraded").alias("ungraded"), F.size("unused").alias("unused"))


@query(
    """WITH f AS (SELECT doc_id, doc_id % 5 <> 0 AS marker, doc_id % 7 <> 0 AS parses, doc_id % 3 = 0 AS listed, doc_id % 2 = 0 AS expired FROM documents)
    SELECT doc_id, CASE WHEN marker AND parses THEN 'INGEST' WHEN listed AND NOT expired THEN 'SKIP' ELSE 'FAIL' END AS decision FROM f"""
)
def pipeline_decision(t):
    d = F.col("doc_id")
    return t.documents.select("doc_id", guideline.decision(d % 5 != 0, d % 7 != 0, d % 3 == 0, d % 2 == 0).alias("decision"))


_LISTED = ", ".join(f"('{i}', '{v}', '{h}')" for i, v, h in curated.NOT_TARGETS)


@query(
    f"""WITH listed AS (SELECT * FROM (VALUES {_LISTED}) v(id, version, hash)),
    d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2013-08' ELSE '2007-10' END AS version, CASE WHEN doc_id % 2 = 0 THEN '{curated.NOT_TARGETS[6][2]}' ELSE '{curated.NOT_TARGETS[0][2]}' END AS hash FROM documents)
    SELECT doc_id, CASE WHEN id IS NOT NULL AND d.version = l.version AND d.hash = l.hash THEN 'SKIP' ELSE 'FAIL' END AS decision,
    CASE WHEN id IS NOT NULL THEN concat_ws(',', CASE WHEN d.version <> l.version THEN 'version' END, CASE WHEN d.hash <> l.hash THEN 'file_hash' END) END AS differs FROM d LEFT JOIN listed l ON id = doc_id::VARCHAR"""
)
def not_target_decision(t):
    """The list of documents that are no targets, on documents that do not parse: listed ones are skipped, expired entries are named."""
    d = F.col("doc_id")
    version = F.when(d % 3 == 0, "2013-08").otherwise("2007-10")
    digest = F.when(d % 2 == 0, curated.NOT_TARGETS[6][2]).otherwise(curated.NOT_TARGETS[0][2])
    docs = t.documents.select("doc_id", F.lit(curated.SOURCE_SYSTEM).alias("source_system"), d.cast("string").alias("external_id"), version.alias("version"), digest.alias("file_hash"))
    got = curated.looked_up(docs, curated.not_targets(t.spark))
    no = F.lit(False)
    return got.select("doc_id", guideline.decision(no, no, F.col("listed") | F.col("expired"), F.col("expired")).alias("decision"), F.array_join("differs", ",").alias("differs"))


@query(
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html WHEN page_id % 4 = 1 THEN '%PDF-1.7 ' || html ELSE html END AS body, CASE WHEN page_id % 4 = 0 THEN 'text/html; charset=utf-8' ELSE 'application/pdf' END AS kind FROM pages)
    SELECT page_id, CASE WHEN kind LIKE 'text/html%' THEN 'SKIPPED' WHEN body NOT LIKE '\\%PDF%' ESCAPE '\\' THEN 'FAILED' WHEN page_id % 8 = 1 THEN 'UNCHANGED' ELSE 'FETCHED' END AS verdict FROM p"""
)
def acquire_verdict(t):
    """Web pages are skipped, other bodies must be PDF; a known digest is only touched."""
    k = F.col("page_id") % 4
    body = F.when(k == 0, F.col("html")).when(k == 1, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).otherwise(F.col("html"))
    kind = F.when(k == 0, "text/html; charset=utf-8").otherwise("application/pdf")
    rows = t.pages.select("page_id", body.alias("body"), kind.alias("kind"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"))
    known = rows.where("page_id % 8 = 1").select("page_id", F.col("digest").alias("known"))
    got = rows.join(known, "page_id", "left")
    verdict = F.when(F.startswith("kind", F.lit("text/html")), "SKIPPED").when(~F.startswith("body", F.lit("%PDF")), "FAILED").when(F.col("digest") == F.col("known"), "UNCHANGED").otherwise("FETCHED")
    return got.select("page_id", verdict.alias("verdict"))


@query("SELECT doc_id, ceil(length(t) / 500.0)::INTEGER AS pieces, length(t)::INTEGER AS chars FROM (SELECT doc_id, regexp_replace(text, '[.!?。\\n]', 'x', 'g') AS t FROM documents)")
def split_by_length(t):
    """Texts without sentence ends are cut at the limit."""
    rows = t.documents.select("doc_id", F.regexp_replace("text", r"[.!?。\n]", "x").alias("text"))
    pieces = split_texts(rows, "doc_id", "text", 500)
    return pieces.groupBy("doc_id").agg(F.count("*").cast("int").alias("pieces"), F.sum(F.length("piece")).cast("int").alias("chars"))


@query(
    """WITH s AS (SELECT source AS doc, arg_max(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, doc_id) AS lang, arg_max(n_chars, doc_id) AS n, max(doc_id) AS latest FROM documents GROUP BY source)
    SELECT source AS doc, coalesce(CASE WHEN max(doc_id) % 2 = 0 THEN 'override' END, CASE WHEN max(doc_id) % 3 = 0 THEN NULL ELSE arg_max(lang, doc_id) END) AS version, CASE WHEN max(doc_id) % 2 = 0 OR max(doc_id) % 3 <> 0 THEN true ELSE false END AS complete FROM documents GROUP BY source"""
)
def metadata_resolved(t):
    """The latest row of a document, overrides first; without a version it is incomplete."""
    latest = t.documents.groupBy(F.col("source").alias("doc")).agg(F.max_by(F.struct("doc_id", "lang"), "doc_id").alias("r"))
    given = F.when(F.col("r.doc_id") % 2 == 0, "override")
    version = F.coalesce(given, F.when(F.col("r.doc_id") % 3 != 0, F.col("r.lang")))
    return latest.select("doc", version.alias("version"), version.isNotNull().alias("complete"))


@query(
    """WITH now_ AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
    s AS (SELECT o_orderkey, CASE WHEN n = 0 THEN 'NOT_TARGET' WHEN bad = 0 THEN 'OK' ELSE 'PARTIAL' END AS status FROM now_), x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'OK' ELSE 'PARTIAL' END AS expected FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(s.o_orderkey, x.o_orderkey) AS o_orderkey, CASE WHEN x.o_orderkey IS NULL THEN 'unexpected' WHEN s.o_orderkey IS NULL THEN 'missing' WHEN status <> expected THEN 'mismatch' ELSE 'same' END AS outcome
    FROM s FULL JOIN x ON s.o_orderkey = x.o_orderkey"""
)
def template_regression(t):
    """Readings against frozen expectations; a better reading is a mismatch too."""
    now = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    now = now.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", guideline.template_status(F.col("n"), F.col("n"), F.col("bad")).alias("status"))
    expected = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "OK").otherwise("PARTIAL").alias("expected"))
    outcome = F.when(F.col("expected").isNull(), "unexpected").when(F.col("status").isNull(), "missing").when(F.col("status") != F.col("expected"), "mismatch").otherwise("same")
    return now.join(expected, "o_orderkey", "full").select("o_orderkey", outcome.alias("outcome"))


_EXPECTED = """g AS (SELECT conv_id AS doc_id, conv_id % 12 AS k, count(*) AS n, count(*) FILTER (role <> 'system') AS graded, list_sort(list('R' || (turn + 1)) FILTER (role = 'system' AND turn > 0)) AS unparsed FROM conversations GROUP BY conv_id),
    e AS (SELECT doc_id, k, n, graded, coalesce(unparsed, []) AS unparsed, CASE WHEN unparsed IS NULL THEN 'OK' ELSE 'PARTIAL' END AS got_status FROM g)"""


@query(
    f"""WITH {_EXPECTED}
    SELECT doc_id, got_status, CASE WHEN k = 0 THEN 'unexpected' WHEN reasons = '' THEN 'same' ELSE 'mismatch' END AS outcome, CASE WHEN k = 0 THEN '' ELSE reasons END AS reasons FROM (
      SELECT doc_id, k, got_status, concat_ws(',', CASE WHEN k = 2 THEN 'numbers' END, CASE WHEN k = 3 THEN 'recommendations' END, CASE WHEN k IN (8, 9, 11) THEN 'read_no_target' END, CASE WHEN k = 4 THEN 'status' END,
      CASE WHEN k = 5 AND len(unparsed) > 0 THEN 'unparsed' END, CASE WHEN k = 7 THEN 'unknown_levels' END, CASE WHEN k IN (6, 11) THEN 'not_derived' END, CASE WHEN k IN (9, 11) THEN 'not_listed' END, CASE WHEN k = 10 THEN 'listed' END) AS reasons
      FROM e)
    UNION ALL SELECT doc_id + 1000000, NULL, 'missing', '' FROM e WHERE k = 0"""
)
def template_verification(t):
    """Parsed pages against expectations that differ in one thing or another, after the waiver of R1."""
    k, pages = F.col("conv_id") % 12, _pages(t)
    system = (F.col("role") == "system") & (F.col("turn") > 0)
    facts = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") != "system").alias("graded"), F.collect_list(F.when(system, F.concat(F.lit("R"), F.col("turn") + 1))).alias("u"))
    none, ok = F.array().cast("array<string>"), F.size("u") == 0
    status = F.when(k.isin(8, 9, 11), "NOT_TARGET").when(ok != (k == 4), "OK").otherwise("PARTIAL")
    expected = facts.select(
        F.when(k == 0, F.col("conv_id") + 1000000).otherwise(F.col("conv_id")).alias("doc_id"), status.alias("status"), (F.col("n") + (k == 2).cast("int")).alias("unique_numbers"),
        (F.col("graded") + (k == 3).cast("int")).alias("recommendations"), F.when(k != 5, F.col("u")).alias("unparsed"), F.when(k.isin(6, 11), F.array(F.lit("R9"))).otherwise(none).alias("not_derived"),
        F.when(k == 7, F.array(F.lit("R1: unheard of"))).alias("unknown_levels"),
    )
    listed = facts.where(k.isin(8, 10)).select(F.col("conv_id").alias("doc_id"))
    waivers = facts.select(F.col("conv_id").alias("doc_id"), F.array(F.lit("R1")).alias("waived"))
    got = guideline.verified_templates(guideline.waived(guideline.read_documents(pages), waivers), expected, listed)
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
    SELECT page_id::VARCHAR AS name, CASE WHEN page_id % 17 <> 0 THEN len(string_split(html, '</p>')) END::BIGINT AS pages, CASE WHEN page_id % 17 <> 0 THEN length(replace(html, '</p>', '')) END::BIGINT AS chars,
    CASE WHEN page_id % 17 = 0 THEN 'ValueError: no text in it' END AS error FROM p"""
)
def pages_extracted(t):
    """Bodies that landed in parts, put together and read into pages by a table function; some cannot be read."""
    size = 4096
    rows = t.pages.select(F.col("page_id").cast("string").alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b"), (F.col("page_id") % 17 == 0).alias("bad"))
    whole = F.when(F.col("bad"), F.lit(b"\xff")).otherwise(F.col("b"))
    starts = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / size).cast("int"))).alias("part")
    parts = rows.select("name", whole.alias("b"), starts).select("name", "part", F.substring("b", F.col("part") * size + 1, F.lit(size)).alias("body"))

    def read(body: bytes) -> list[str]:
        if body.startswith(b"\xff"):
            raise ValueError("no text in it")
        return body.decode().split("</p>")

    got = extracted(parts, read)
    return got.groupBy("name").agg(F.nullif(F.count("page_no"), F.lit(0)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("error").alias("error"))


_DEFECT = curated.SOURCE_DEFECTS[0]


@query(
    f"""WITH d AS (SELECT conv_id AS doc_id, count(*) AS n, CASE WHEN conv_id % 4 < 3 THEN '{_DEFECT[0]}' ELSE '1' END AS id, CASE WHEN conv_id % 4 = 1 THEN '2020-01' ELSE '{_DEFECT[1]}' END AS version, CASE WHEN conv_id % 4 = 2 THEN 'other' ELSE '{_DEFECT[2]}' END AS hash FROM conversations GROUP BY conv_id)
    SELECT doc_id, CASE WHEN n < 2 THEN '' WHEN id = '{_DEFECT[0]}' AND version = '{_DEFECT[1]}' AND hash = '{_DEFECT[2]}' THEN '' ELSE '{_DEFECT[4][0]}' END AS duplicated FROM d"""
)
def source_defect_waived(t):
    """A number that the source itself prints twice, in documents whose second page repeats the first: the shipped list waives it in one version of one file."""
    number, n = _DEFECT[4][0], F.col("conv_id") % 4
    page = F.concat(F.lit("3\nⅣ. 권고사항\n1. 침\n【"), F.lit(number), F.lit("】\n권고안 권고등급/근거수준\n권고한다. B/Moderate\n(1) 배경\n"), F.col("text"))
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), page.alias("text"))
    state = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("doc_id"), F.lit(curated.SOURCE_SYSTEM).alias("source_system"), F.when(n < 3, _DEFECT[0]).otherwise("1").alias("external_id"),
        F.when(n == 1, "2020-01").otherwise(_DEFECT[1]).alias("version"), F.when(n == 2, "other").otherwise(_DEFECT[2]).alias("file_hash"),
    )
    got = guideline.waived(guideline.diagnose_documents(pages), curated.known_defects(state, curated.source_defects(t.spark)))
    return got.select("doc_id", F.array_join("duplicated", ",").alias("duplicated"))
