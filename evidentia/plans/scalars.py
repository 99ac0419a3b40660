"""Scalar functions (inventory H1-H30) and small source helpers (A3, A4, A15, A16, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, lenient, ratings, reporting, text, vectors
from ..sources import catalog, frames
from .registry import query

_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    """SELECT conv_id, turn, CASE WHEN s = '' THEN NULL WHEN length(s) > 40 THEN left(s, 40) || '…' ELSE s END AS title
    FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)"""
)
def scalar_title(t):
    return t.conversations.select("conv_id", "turn", text.title(F.col("text")).alias("title"))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '…' END AS short, left(text, 300) AS cut FROM documents"""
)
def scalar_truncate(t):
    return t.documents.select("doc_id", text.truncated(F.col("text"), 80).alias("short"), text.utf16_left(F.col("text"), 300).alias("cut"))


_INDEX_KEY = b"index key for tests"
_PADDED = [bytes(k ^ x for k in _INDEX_KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]  # the inner and outer key of the public HMAC


@query(
    f"""SELECT c_custkey, rtrim(replace(replace(to_base64(unhex(sha256(unhex('{_PADDED[1]}') || unhex(sha256(unhex('{_PADDED[0]}') || encode(lower(trim(nfc_normalize(c_name))))))))), '+', '-'), '/', '_'), '=') AS name_index FROM customer"""
)
def blind_index(t):
    return t.customer.select("c_custkey", crypto.blind_index(_INDEX_KEY)(F.col("c_name")).alias("name_index"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def scalar_sha256(t):
    return t.documents.select("doc_id", text.sha256_hex(F.col("text")).alias("digest"))


@query("SELECT c_custkey, c_name AS opened, 4::INTEGER AS parts FROM customer")
def crypto_roundtrip(t):
    """Encrypted with the newer of two keys and opened again."""
    keys = {1: b"0123456789abcdef0123456789abcdef", 2: b"fedcba9876543210fedcba9876543210"}
    made = t.customer.select("c_custkey", crypto.encrypt(F.col("c_name"), keys, 2).alias("box"))
    return made.select("c_custkey", crypto.decrypt(F.col("box"), keys).alias("opened"), F.size(F.split("box", r"\.")).alias("parts"))


@query("SELECT conv_id, turn, ceil(length(text) / 3)::BIGINT AS tokens FROM conversations")
def scalar_token_estimate(t):
    return t.conversations.select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


_MARKED = "concat('see [', doc_id % 5, '] and [', doc_id % 3, '], [', doc_id % 5, '] ', text)"


def _marked(t, *others):
    d = F.col("doc_id")
    said = F.concat(F.lit("see ["), d % 5, F.lit("] and ["), d % 3, F.lit("], ["), d % 5, F.lit("] "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", *others, said.alias("answer"))


@query(
    f"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all({_MARKED}, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INTEGER) AS all_ FROM documents)
    SELECT doc_id, array_to_string(list_filter(all_, lambda x, i: list_position(all_, x) = i), ',') AS markers FROM m"""
)
def scalar_markers(t):
    return _marked(t).select("doc_id", F.array_join(text.markers(F.col("answer")), ",").alias("markers"))


@query(f"""SELECT doc_id, regexp_matches(text, '(^|\\n)(#|[-*] |```)') OR contains(text, '**') AS markdown, regexp_matches({_MARKED}, '\\[\\d\\]') AS cited FROM documents""")
def mechanical_checks(t):
    said = _marked(t, "text")
    markdown = F.col("text").rlike(r"(?m)^(#|[-*] |```)") | F.contains("text", F.lit("**"))
    return said.select("doc_id", markdown.alias("markdown"), F.col("answer").rlike(r"\[\d\]").alias("cited"))


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, 'the', '[1]'), '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, len(parts)::INTEGER AS sentences, len(list_filter(parts, lambda x: regexp_matches(x, '\\[\\d\\]')))::INTEGER AS supported FROM s"""
)
def judge_sentences(t):
    """Sentences, and those that carry a marker."""
    said = t.documents.select("doc_id", F.replace("text", F.lit("the"), F.lit("[1]")).alias("a"))
    parts = F.filter(F.transform(F.split("a", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    got = said.select("doc_id", parts.alias("parts"))
    return got.select("doc_id", F.size("parts").alias("sentences"), F.size(F.filter("parts", lambda x: x.rlike(r"\[\d\]"))).alias("supported"))


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS released FROM orders)
    SELECT o_orderkey, CASE WHEN released IS NULL THEN '' WHEN length(released) = 7 THEN released || '-01' ELSE released END AS day FROM d"""
)
def scalar_release_date(t):
    k = F.col("o_orderkey") % 3
    released = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = F.when(F.col("r").rlike(r"^\d{4}-\d{2}$"), F.concat("r", F.lit("-01"))).otherwise(F.coalesce("r", F.lit("")))
    return t.orders.select("o_orderkey", released.alias("r")).select("o_orderkey", day.alias("day"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 30 DAY AS cutoff, o_orderdate + INTERVAL 7 DAY AS expires FROM orders")
def scalar_cutoff(t):
    day = F.col("o_orderdate")
    return t.orders.select("o_orderkey", (day - F.expr("interval 30 days")).alias("cutoff"), (day + F.expr("interval 7 days")).alias("expires"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ACCEPTED' WHEN o_orderpriority = '5-LOW' THEN 'REVOKED' WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 'EXPIRED'
    ELSE 'PENDING' END AS status FROM orders"""
)
def scalar_status_case(t):
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderpriority") == "5-LOW", "REVOKED").when(F.col("o_orderdate") <= now, "EXPIRED").otherwise("PENDING")
    return t.orders.select("o_orderkey", status.alias("status"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id,
    abs(round(1 - list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9)) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id - a.vec_id % 20"""
)
def vector_distance(t):
    """The distance of each vector to the question that leads its twenty ids."""
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    asked = v.select(F.col("vec_id").alias("lead"), F.col("e").alias("q"))
    got = v.withColumn("lead", F.col("vec_id") - F.col("vec_id") % 20).join(asked, "lead")
    return got.select("vec_id", F.abs(F.round(vectors.cosine_distance(F.col("e"), F.col("q")), 9)).alias("distance"))


_CUT = "& 4294967295::UBIGINT"


@query(
    f"""WITH s AS (SELECT item_id, list_transform(range(1, 17), lambda i: (('0x' || left(sha256(text), 8))::UBIGINT + i::UBIGINT * 1831565813::UBIGINT) {_CUT}) AS s FROM benchmark),
    z AS (SELECT item_id, list_transform(list_transform(s, lambda s: (xor(s, s >> 15) * (s | 1::UBIGINT)) {_CUT}), lambda z: xor(z, (z + ((xor(z, z >> 7) * (z | 61::UBIGINT)) {_CUT})) {_CUT})) AS z FROM s)
    SELECT item_id, unnest(range(16))::INTEGER AS place, unnest(list_transform(z, lambda z: round(xor(z, z >> 14)::DOUBLE / 4294967296 * 2 - 1, 6))) AS value FROM z"""
)
def embed_deterministic(t):
    return t.benchmark.select("item_id", F.posexplode(vectors.deterministic_embedding(16)(F.col("text"))).alias("place", "value"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE array_to_string(list_filter([(event_id % 3)::INTEGER, CASE WHEN event_id % 3 <> 2 THEN 2 END], lambda x: x IS NOT NULL), ',') END AS picked FROM events"""
)
def normalize_ranking(t):
    raw = F.array((F.col("event_id") % 3).cast("string"), F.lit("2"), F.lit("2.5"), F.lit("x"), F.lit("99"), F.lit("-1"), F.lit("2.0"))
    given = F.when(F.col("event_id") % 4 != 0, raw)
    return t.events.select("event_id", F.array_join(lenient.ranking(given, F.lit(5)), ",").alias("picked"))


@query(
    """SELECT event_id, CASE WHEN value > 0 THEN floor(value + 0.5)::INTEGER ELSE 0 END AS n, event_type AS verdict, 'a,b' AS examples FROM events"""
)
def normalize_judgement(t):
    said = F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("c"))
    kinds = ("view", "click", "error", "purchase", "signup")
    return t.events.select(
        "event_id", lenient.count_of(F.col("value").cast("string")).alias("n"), lenient.verdict(F.col("event_type"), kinds).alias("verdict"), F.array_join(lenient.examples(said), ",").alias("examples")
    )


@query(
    """SELECT l_returnflag, printf('%.3f', avg(l_discount)) AS discount, CASE WHEN count(*) FILTER (l_quantity > 100) = 0 THEN '—' END AS nothing,
    printf('%.1f%%', count(*) FILTER (l_linestatus = 'F') * 100.0 / count(*)) AS finished FROM lineitem GROUP BY l_returnflag"""
)
def report_ratio(t):
    none = F.count_if(F.col("l_quantity") > 100)
    return t.lineitem.groupBy("l_returnflag").agg(
        reporting.ratio(F.avg("l_discount")).alias("discount"), reporting.percent(none, none).alias("nothing"),
        reporting.percent(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("finished"),
    )


@query(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Very Low' WHEN 'PROMO' THEN 'High' ELSE lower(p_type) END AS level, CASE p_size % 3 WHEN 0 THEN 'Ⅳ' WHEN 1 THEN 'Ⅸ' ELSE 'XI' END AS numeral FROM part"""
)
def canonical_map(t):
    raw = F.when(F.col("p_type") == "ECONOMY", "VERY   low").when(F.col("p_type") == "PROMO", "HIGH").otherwise(F.lower("p_type"))
    numeral = F.when(F.col("p_size") % 3 == 0, "IV").when(F.col("p_size") % 3 == 1, "IX").otherwise("XI")
    return t.part.select("p_partkey", ratings.canonical(raw, ratings.LEVELS).alias("level"), ratings.looked_up(numeral, ratings.ROMAN).alias("numeral"))


@query("SELECT doc_id, source || ' > ' || lang AS path FROM documents")
def array_path_join(t):
    return t.documents.select("doc_id", F.array_join(F.array("source", "lang"), " > ").alias("path"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS stage, event_type AS kind FROM events"""
)
def json_merge(t):
    """A shallow merge of two objects in which the right one wins."""
    left = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("stage"), F.lit("a")))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("stage"), F.lit("b"), F.lit("kind"), F.col("event_type"))).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    rows = t.events.select("event_id", left.alias("l"), right.alias("r"))
    merged = F.map_concat(F.map_filter("l", lambda k, _: ~F.map_contains_key(F.col("r"), k)), F.col("r"))
    return rows.select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["stage"].alias("stage"), F.col("m")["kind"].alias("kind"))


@query("SELECT * FROM (VALUES ('m1/vector-k5'), ('m1/vector-k5-cut0.48'), ('m1/hybrid-k30-rrf60'), ('m1/hybrid-k30-rrf60-cut0.48')) v(policy)")
def policy_version(t):
    made = [reporting.policy_version("m1", 5, hybrid, cutoff=cut) for hybrid in (False, True) for cut in (None, 0.48)]
    return t.spark.createDataFrame([(x,) for x in made], "policy string")


@query(
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey <> 3 THEN 'nation' END, CASE WHEN c_acctbal >= 0 THEN 'balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment' END) AS present,
    concat_ws(',', CASE WHEN c_nationkey = 3 THEN 'nation' END, CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS missing FROM customer"""
)
def present_missing_fields(t):
    """Which fields of a profile are there: not null, not empty; the others are missing."""
    fields = {
        "nation": F.nullif("c_nationkey", F.lit(3)).isNotNull(),
        "balance": F.size(F.when(F.col("c_acctbal") < 0, F.array().cast("array<double>")).otherwise(F.array("c_acctbal"))) > 0,
        "segment": F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")) != "",
    }
    there = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fields.items()]))
    gone = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in fields.items()]))
    return t.customer.select("c_custkey", F.array_join(there, ",").alias("present"), F.array_join(gone, ",").alias("missing"))


@query("SELECT doc_id, 'allergy:' || source || ';allergy:' || lang AS alerts FROM documents")
def array_to_structs(t):
    alerts = F.transform(F.array("source", "lang"), lambda x: F.struct(F.lit("allergy").alias("kind"), x.alias("what")))
    rows = t.documents.select("doc_id", alerts.alias("alerts"))
    return rows.select("doc_id", F.array_join(F.transform("alerts", lambda a: F.concat_ws(":", a["kind"], a["what"])), ";").alias("alerts"))


@query("SELECT conv_id, turn::INTEGER AS seq, role AS event, length(text)::INTEGER AS n FROM conversations")
def sse_parse(t):
    """Frames with comments, carriage returns and data over several lines, parsed back."""
    body = F.concat(F.lit(": ping\r\n\r\nevent: "), F.col("role"), F.lit("\r\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\r\n\r\n"))
    rows = t.conversations.select("conv_id", "turn", F.explode(frames.parse(body)).alias("f"))
    return rows.select("conv_id", F.col("turn").cast("int").alias("seq"), F.col("f.event").alias("event"), F.length("f.data").alias("n"))


@query("""SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS seq, 'data: {"seq":' || (turn - min(turn) OVER (PARTITION BY conv_id)) || ',"eventType":"' || role || '"}' || chr(10) || chr(10) AS frame FROM conversations""")
def stream_frames(t):
    return frames.numbered(t.conversations.withColumnRenamed("role", "eventType"), "conv_id", ["turn"], ["eventType"])


# -- sources ---------------------------------------------------------------------


@query(
    """SELECT 'p' || page_id AS external_id, url AS source_url, CASE page_id % 3 WHEN 0 THEN '2024-0' || (page_id % 9 + 1) WHEN 1 THEN '2023-11' END AS released FROM pages"""
)
def source_catalog_items(t):
    """Catalogue rows as items: blank dates fold to null, a later date stands in for an earlier one."""
    modified = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" 2024-0"), F.col("page_id") % 9 + 1, F.lit(" "))).otherwise("  ")
    added = F.when(F.col("page_id") % 3 != 2, "2023-11").otherwise("")
    raw = t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("link"), modified.alias("modified"), added.alias("added"))
    return catalog.items(raw)


@query("SELECT 'p' || page_id AS external_id FROM pages WHERE page_id IN (3, 5, 8, 13) ORDER BY page_id LIMIT 3")
def source_catalog_filter_limit(t):
    rows = t.pages.select("page_id", F.concat(F.lit("p"), "page_id").alias("external_id"))
    return catalog.filtered(rows, [f"p{i}" for i in (3, 5, 8, 13)], 3, "page_id").select("external_id")


_HOSTS = "CASE page_id % 5 WHEN 0 THEN 'hooks.slack.com' WHEN 1 THEN 'discord.com' WHEN 2 THEN 'DISCORDAPP.com' ELSE regexp_extract(url, '^https?://([^/]+)', 1) END"


@query(
    f"""WITH p AS (SELECT page_id, lower({_HOSTS}) AS host FROM pages) SELECT page_id, CASE WHEN host = 'hooks.slack.com' THEN '{{"text":"page ' || page_id || '"}}' WHEN host IN ('discord.com', 'discordapp.com') THEN '{{"content":"page ' || page_id || '"}}'
    ELSE '{{"title":"page","detail":"' || page_id || '","traceId":"t' || page_id || '","text":"page ' || page_id || '"}}' END AS payload FROM p"""
)
def alert_payload_by_host(t):
    """Three hosts that take a shape of their own, and the hosts of the pages, which take all fields."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    host = F.when(k == 0, "hooks.slack.com").when(k == 1, "discord.com").when(k == 2, "DISCORDAPP.com").otherwise(F.parse_url("url", F.lit("HOST")))
    return t.pages.select("page_id", frames.alert_payload(host, F.lit("page"), n, F.concat(F.lit("t"), n)).alias("payload"))


@query("SELECT doc_id, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '|', '\\|') AS cell FROM documents")
def report_cell_escape(t):
    return t.documents.select("doc_id", text.report_cell(F.col("text")).alias("cell"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS no, 'turn' AS event, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS data FROM conversations")
def frames_across_reads(t):
    """Frames, with a data line for each line of the turn, cut into reads of 700 characters, wherever that falls, and read back."""
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?|\n", "\r\ndata: ")
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("event: turn\r\ndata: "), lines, F.lit("\r\n\r\n")).alias("frame"))
    body = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), "").alias("body"))
    starts = F.sequence(F.lit(0), F.floor(F.length("body") / 700).cast("int"))
    reads = body.select("conv_id", "body", F.explode(starts).alias("n")).select("conv_id", "n", F.substr("body", F.col("n") * 700 + 1, F.lit(700)).alias("read"))
    return frames.reassembled(reads, "conv_id", "n", "read")


@query(
    """SELECT page_id, 'web' AS job, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^(www|m)\\.', '') AS instance FROM pages
    WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, '#top$')"""
)
def relabel_keep_drop(t):
    """Keep, drop and replace rules for labels of a log source."""
    rows = t.pages.where(F.col("url").rlike("^https://")).where(~F.col("url").rlike("#top$"))
    return rows.select("page_id", F.lit("web").alias("job"), F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^(www|m)\.", "").alias("instance"))
