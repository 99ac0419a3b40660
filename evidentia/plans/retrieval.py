"""Retrieval, gates, answers and their evaluation (inventory J1-J13, K1-K6, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import standins
from ..engine.kept import kept
from ..engine.views import CHUNKS_SQL, EVERY, QUESTIONS_SQL
from ..functions import text
from ..operators import evaluation, reports, search
from ..operators.lookup import all_references_known
from ..operators.scope import corpus_predicate
from .registry import query

#: A test parameter near the median of the tables' smallest distances, so that both outcomes occur.
CUTOFF = 0.63
K = 10

_VECTOR = f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL},
dist AS (SELECT question_id, question_label, chunk_id, label, round(1 - list_inner_product(question_vector, vector) / (sqrt(list_inner_product(question_vector, question_vector)) * sqrt(list_inner_product(vector, vector))), 9) AS distance
  FROM questions, chunks WHERE chunk_id <> question_id),
varm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS vector_rank FROM dist) WHERE vector_rank <= {K})"""
_GRAMS = """list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')), lambda w: list_transform(range(1, (length(w) + 2)::BIGINT), lambda i: substring('  ' || w || ' ', i, 3)))))"""
_SETS = f"""qs AS (SELECT question_id, {_GRAMS.format("question")} AS qg FROM questions), cs AS (SELECT chunk_id, {_GRAMS.format("content")} AS cg FROM chunks)"""
_KEYWORD = f"""{_VECTOR}, {_SETS},
sims AS (SELECT question_id, chunk_id, round(coalesce(len(list_intersect(qg, cg)) / nullif(len(qg) + len(cg) - len(list_intersect(qg, cg)), 0)::DOUBLE, 0), 9) AS similarity FROM qs, cs WHERE question_id <> chunk_id),
karm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS keyword_rank FROM sims) WHERE keyword_rank <= {K})"""
_FUSED = f"""{_KEYWORD}, merged AS (SELECT coalesce(v.question_id, k.question_id) AS question_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, vector_rank, keyword_rank,
  coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM varm v FULL JOIN karm k ON v.question_id = k.question_id AND v.chunk_id = k.chunk_id),
fused AS (SELECT m.*, d.distance, row_number() OVER (PARTITION BY m.question_id ORDER BY score DESC, vector_rank NULLS LAST, m.chunk_id) AS rank FROM merged m JOIN dist d ON d.question_id = m.question_id AND d.chunk_id = m.chunk_id)"""
_GATE = f"""{_VECTOR}, gate AS (SELECT question_id, min(distance) AS top_distance, CASE WHEN min(distance) > {CUTOFF} THEN 'beyond_cutoff' END AS reason FROM varm GROUP BY question_id)"""


def _arms(t, k: int = K):
    q, c = t.questions(), t.chunks()
    return q, search.vector_arm(q, c, k), search.keyword_arm(q, c, k)


@query(f"{_VECTOR} SELECT question_id, chunk_id, distance, vector_rank::INTEGER AS vector_rank FROM varm WHERE vector_rank <= 5")
def vector_topk(t):
    return search.vector_arm(t.questions(), t.chunks(), 5).select("question_id", "chunk_id", "distance", "vector_rank")


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_SETS} SELECT question_id, chunk_id, round(coalesce(len(list_intersect(qg, cg)) / nullif(len(qg) + len(cg) - len(list_intersect(qg, cg)), 0)::DOUBLE, 0), 9) AS similarity FROM qs, cs WHERE question_id <> chunk_id")
def trigram_jaccard(t):
    """The measure itself, of every question and every chunk but its own, scored in blocks."""
    return search.keyword_pairs(t.questions(), t.chunks(), None).select("question_id", "chunk_id", (F.lit(0.0) - F.col("value")).alias("similarity"))  # no negative zeros


@query()
def word_similarity_arm(t):
    """The asymmetric measure: every benchmark passage whose id is divisible by 20, whole, asked of all chunks."""
    asked = t.benchmark.where(F.col("item_id") % EVERY == 0).select((-1 - F.col("item_id")).alias("question_id"), F.lit(0).alias("question_label"), F.col("text").alias("question"))
    best = search.ranked(search.keyword_pairs(asked, t.chunks(), K, "word"), K, "keyword_rank")
    return best.select((-1 - F.col("question_id")).alias("item_id"), "chunk_id", (F.lit(0.0) - F.col("value")).alias("similarity"), "keyword_rank")


@query(f"{_FUSED} SELECT question_id, chunk_id, distance, vector_rank::INTEGER AS vector_rank, keyword_rank::INTEGER AS keyword_rank, round(score, 9) AS score, rank::INTEGER AS rank FROM fused")
def hybrid_rrf(t):
    _, v, k = _arms(t)
    return search.fused(v, k).withColumn("score", F.round("score", 9))


@query()
def hybrid_word_rrf(t):
    """Both arms as the reference system has them, the keyword arm by word similarity of the whole question."""
    q, c = t.questions(), t.chunks()
    return search.fused(search.vector_arm(q, c, K), search.keyword_arm(q, c, K, "word")).withColumn("score", F.round("score", 9))


@query(f"WITH {CHUNKS_SQL} SELECT model, count(*) AS n FROM chunks GROUP BY model")
def corpus_count(t):
    c = t.chunks()
    return c.where(corpus_predicate("m0") | corpus_predicate("m1")).groupBy("model").agg(F.count("*").alias("n"))


@query(f"{_GATE} SELECT * FROM gate")
def gate_distance(t):
    q = t.questions()
    return search.distance_gate(q, search.vector_arm(q, t.chunks(), K), CUTOFF)


@query(f"{_GATE} SELECT question_id, top_distance, coalesce(reason, CASE WHEN question_id % 12 < 9 THEN 'low_relevance' END) AS reason FROM gate")
def gate_score(t):
    q = t.questions()
    relevance = q.select("question_id", (F.col("question_id") % 12).cast("double").alias("top_relevance"))
    return search.score_gate(search.distance_gate(q, search.vector_arm(q, t.chunks(), K), CUTOFF), relevance, 9.0)


@query(
    f"""{_FUSED}, o AS (SELECT question_id, unnest([3, 1, 99, 7, 2, 5, 4]) AS rank, generate_subscripts([3, 1, 99, 7, 2, 5, 4], 1) AS place FROM questions WHERE question_id % 2 = 0),
    p AS (SELECT f.question_id, f.chunk_id, o.place FROM o JOIN fused f ON f.question_id = o.question_id AND f.rank = o.rank UNION ALL SELECT question_id, chunk_id, rank FROM fused WHERE question_id % 2 = 1)
    SELECT * FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY place)::INTEGER AS position FROM p) WHERE position <= 5"""
)
def rerank_apply(t):
    """Even questions get an order with an unknown position, odd ones none."""
    q, v, k = _arms(t)
    order = F.when(F.col("question_id") % 2 == 0, F.array(*map(F.lit, (3, 1, 99, 7, 2, 5, 4)))).otherwise(F.array().cast("array<int>"))
    return search.reordered(search.fused(v, k), q.select("question_id", order.alias("order")))


@query(
    f"""{_VECTOR}, o AS (SELECT question_id, chunk_id, vector_rank, row_number() OVER (PARTITION BY question_id ORDER BY label = question_label DESC, vector_rank) AS place FROM varm)
    SELECT question_id, chunk_id, place::INTEGER AS position FROM o WHERE place <= 5"""
)
def real_path(t):
    """The path that evaluations share with answers: vector search alone, the re-ranker's order, the first five.

    The re-ranker here prefers chunks that carry the question's label.
    """
    found = search.vector_arm(t.questions(), t.chunks(), K).withColumn("rank", F.col("vector_rank"))
    place = F.struct((F.col("label") != F.col("question_label")).cast("int"), "rank")
    orders = found.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["rank"]).alias("order"))  # K places a question
    return search.reordered(found, orders)


@query(
    """WITH a AS (SELECT doc_id, 'see [' || (doc_id % 9) || '] and [2] and [' || (doc_id % 4 + 1) || ']' AS answer FROM documents),
    m AS (SELECT DISTINCT doc_id, unnest([doc_id % 9, 2, doc_id % 4 + 1])::INTEGER AS marker FROM a) SELECT doc_id, marker, 'quote ' || marker AS quote FROM m WHERE marker BETWEEN 1 AND 5"""
)
def citations_extract(t):
    """Markers in an answer that point to one of the five offered pieces."""
    d = F.col("doc_id")
    said = F.concat(F.lit("see ["), d % 9, F.lit("] and [2] and ["), d % 4 + 1, F.lit("]"))
    used = F.array_intersect(text.markers(said), F.sequence(F.lit(1), F.lit(5)))
    return t.documents.select("doc_id", F.explode(used).alias("marker")).withColumn("quote", F.concat(F.lit("quote "), F.col("marker")))


@query(
    f"""{_VECTOR} SELECT question_id, sha256(string_agg('[' || vector_rank || '] ' || guideline || chr(10) || content, chr(10) || chr(10) ORDER BY vector_rank)) AS prompt FROM varm v JOIN chunks c ON c.chunk_id = v.chunk_id WHERE vector_rank <= 5 GROUP BY question_id"""
)
def prompt_concat(t):
    """Numbered evidence; at most five pieces a question are gathered."""
    best = search.vector_arm(t.questions(), t.chunks(), 5).select("question_id", "chunk_id", "vector_rank")
    rows = best.join(t.chunks().select("chunk_id", "guideline", "content"), "chunk_id")
    piece = F.concat(F.lit("["), F.col("vector_rank"), F.lit("] "), F.col("guideline"), F.lit("\n"), F.col("content"))
    parts = F.sort_array(F.collect_list(F.struct("vector_rank", piece.alias("p"))))
    return rows.groupBy("question_id").agg(text.sha256_hex(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n")).alias("prompt"))


@query("SELECT c_custkey, c_custkey % 7 <> 0 AND c_nationkey % 30 < 20 AND c_custkey % 40 < 25 AS valid FROM customer")
def validate_all_refs(t):
    """Valid if there are references and each is known: one miss rejects the item."""
    refs = F.when(F.col("c_custkey") % 7 != 0, F.array((F.col("c_nationkey") % 30).cast("long"), F.col("c_custkey") % 40)).otherwise(F.array().cast("array<long>"))
    known = t.spark.range(40).where("id < 25").select(F.col("id").alias("k"))
    both = all_references_known(t.customer.select("c_custkey", refs.alias("refs")), "c_custkey", "refs", known, "k")
    narrow = t.customer.select("c_custkey", (F.col("c_nationkey") % 30 < 20).alias("inside"))
    return both.join(narrow, "c_custkey").select("c_custkey", (F.col("valid") & F.col("inside")).alias("valid"))


@query(
    """SELECT conv_id, CASE WHEN accepted > 0 THEN 'structured' WHEN cited > 0 THEN 'citations' ELSE 'summary' END AS source, CASE WHEN accepted > 0 THEN accepted WHEN cited > 0 THEN cited ELSE 1 END AS items
    FROM (SELECT conv_id, count(*) FILTER (role = 'system') AS accepted, count(*) FILTER (role = 'assistant' AND length(text) > 900) AS cited FROM conversations GROUP BY conv_id)"""
)
def compose_fallback(t):
    """Structured items if any were accepted, else citations, else one summary."""
    role = F.col("role")
    n = t.conversations.groupBy("conv_id").agg(F.count_if(role == "system").alias("accepted"), F.count_if((role == "assistant") & (F.length("text") > 900)).alias("cited"))
    pick = lambda a, b, c: F.when(F.col("accepted") > 0, a).when(F.col("cited") > 0, b).otherwise(c)
    return n.select("conv_id", pick("structured", "citations", "summary").alias("source"), pick(F.col("accepted"), F.col("cited"), F.lit(1)).cast("long").alias("items"))


_REAL = f"""{_VECTOR}, o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY label = question_label DESC, vector_rank) AS place FROM varm),
ev AS (SELECT o.question_id, o.place, c.guideline, c.version, c.content FROM o JOIN chunks c USING (chunk_id) WHERE place <= CASE WHEN o.question_id % 40 = 0 THEN 2 ELSE 5 END)"""


def _evidence(t):
    """The evidence of each question on the path that evaluations share; every other question has two pieces only."""
    found = real_path(t).where((F.col("question_id") % 40 != 0) | (F.col("position") <= 2))
    return t.questions().select("question_id", "question").join(standins.evidence_of(found, t.chunks()), "question_id")


@query(
    f"""{_REAL}, f AS (SELECT question_id, list_filter(['age', 'history'], lambda x: CASE x WHEN 'age' THEN question_id % 3 > 0 ELSE question_id % 60 = 20 END) AS factors FROM questions)
    SELECT question_id, CASE WHEN len(any_value(factors)) > 0 THEN 'structured' ELSE 'citations' END AS source, count(*) AS items,
    sha256(string_agg(CASE WHEN len(factors) > 0 THEN guideline || ' > ' || version ELSE guideline END, chr(10) ORDER BY place)) AS titles FROM ev JOIN f USING (question_id) GROUP BY question_id"""
)
def guidance_path(t):
    """Search, re-rank, structure, validate, compose: items need a fact on record, without one the evidence is cited as it stands."""
    factors = F.array_compact(F.array(F.when(F.col("question_id") % 3 > 0, "age"), F.when(F.col("question_id") % 60 == 20, "history")))
    rows = standins.structured(_evidence(t).withColumn("factors", factors), standins.EvidenceStructurer())
    got = standins.composed(standins.accepted(rows))
    return got.select("question_id", "source", F.size("titles").cast("long").alias("items"), text.sha256_hex(F.array_join("titles", "\n")).alias("titles"))


@query(
    f"""{_REAL}, n AS (SELECT question_id, count(*) AS n FROM ev GROUP BY question_id)
    SELECT question_id, (n + CASE WHEN n < 3 THEN 1 ELSE 0 END)::INTEGER AS claims, n::INTEGER AS supported, CASE WHEN n < 3 THEN 'partial' ELSE 'grounded' END AS verdict FROM n"""
)
def answers_judged(t):
    """Answers that quote their evidence, judged by their markers; those that add a sentence of their own are partial."""
    rows = standins.judged(standins.answered(_evidence(t), standins.QuotingAnswerer()), standins.MarkerJudge())
    return rows.select("question_id", "judgement.claims", "judgement.supported", "judgement.verdict")


# -- evaluation ------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'answerable' ELSE 'abstain' END AS kind FROM labels WHERE doc_id % 3 <> 0")
def evalset_approved(t):
    status = F.when(F.col("doc_id") % 3 != 0, "approved").otherwise("candidate")
    kind = F.when(F.col("quality") == 1, "answerable").otherwise("abstain")
    items = t.labels.select(F.col("doc_id").cast("string").alias("id"), kind.alias("kind"), F.lit("a question").alias("question"), status.alias("status"), F.lit("manual").alias("origin"), "doc_id")
    return evaluation.approved(items).select("doc_id", "kind")


_HITS = f"""{_VECTOR}, hits AS (SELECT question_id, min(CASE WHEN label = question_label THEN vector_rank END) AS first_hit FROM varm GROUP BY question_id)"""


@query(f"{_HITS} SELECT round(avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first_hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN first_hit <= 5 THEN 1.0 / first_hit ELSE 0.0 END), 6) AS mrr_5 FROM hits")
def eval_recall_mrr(t):
    """Hit rate and reciprocal rank; the label stands in for relevance, so the value says nothing of quality."""
    found = search.vector_arm(t.questions(), t.chunks(), K)
    return evaluation.recall_mrr(found.withColumn("hit", F.col("label") == F.col("question_label")), t.questions(), (5, 10), 5)


@query(
    f"""{_GATE}, e AS (SELECT question_id, question_id % 3 = 0 AS should_abstain, reason IS NOT NULL AS by_distance, question_id % 12 < 9 AS by_score FROM gate)
    SELECT round(count(*) FILTER (should_abstain AND by_distance) * 1.0 / count(*) FILTER (should_abstain), 6) AS distance_recall, round(count(*) FILTER (NOT should_abstain AND by_distance) * 1.0 / count(*) FILTER (NOT should_abstain), 6) AS distance_over,
    round(count(*) FILTER (should_abstain AND (by_distance OR by_score)) * 1.0 / count(*) FILTER (should_abstain), 6) AS combined_recall, round(count(*) FILTER (NOT should_abstain AND (by_distance OR by_score)) * 1.0 / count(*) FILTER (NOT should_abstain), 6) AS combined_over,
    count(*) FILTER (by_distance AND NOT by_score) AS cause_distance, count(*) FILTER (by_score AND NOT by_distance) AS cause_score, count(*) FILTER (by_distance AND by_score) AS cause_both FROM e"""
)
def eval_gates(t):
    q = t.questions()
    gate = search.distance_gate(q, search.vector_arm(q, t.chunks(), K), CUTOFF)
    rows = gate.select((F.col("question_id") % 3 == 0).alias("should_abstain"), F.col("reason").isNotNull().alias("by_distance"), (F.col("question_id") % 12 < 9).alias("by_score"))
    return evaluation.gate_confusion(rows)


_KEYS = """k AS (SELECT doc_id AS item, CASE WHEN doc_id % 10 = 0 THEN 'nowhere' ELSE source END AS guideline, lang AS version, doc_id // 8 AS number FROM documents),
c AS (SELECT doc_id AS chunk_id, source AS guideline, lang AS version, doc_id // 8 AS number FROM documents)"""


@query(f"WITH {_KEYS} SELECT item, chunk_id FROM k JOIN c USING (guideline, version, number)")
def labels_resolve(t):
    return evaluation.resolve(*_labels(t))[0]


@query(f"WITH {_KEYS} SELECT item, guideline, version, number FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.guideline = k.guideline AND c.version = k.version AND c.number = k.number)")
def labels_unresolved(t):
    return evaluation.resolve(*_labels(t))[1]


def _labels(t):
    """Labels and chunks by guideline, version and recommendation number; up to eight documents play the chunks of one recommendation."""
    number = F.floor(F.col("doc_id") / 8).alias("number")
    named = F.when(F.col("doc_id") % 10 == 0, "nowhere").otherwise(F.col("source"))
    keys = t.documents.select(F.col("doc_id").alias("item"), named.alias("guideline"), F.col("lang").alias("version"), number)
    return keys, t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("guideline"), F.col("lang").alias("version"), number), ["guideline", "version", "number"]


# -- reports ---------------------------------------------------------------------

_SAID = "format('{{:.3f}}', round(coalesce(count(*) FILTER ({0} AND {1}) / nullif(count(*) FILTER ({1}), 0)::DOUBLE, 0), 3))"
_MRR = "format('{{:.3f}}', round(coalesce(sum(CASE WHEN {1} AND {0} <= 5 THEN 1.0::DOUBLE / {0} ELSE 0 END) / nullif(count(*) FILTER ({1}), 0), 0), 3))"
_KEY = "format('{:020d}', item_id)"
_A, _B = "kind = 'answerable'", "kind = 'abstain'"


def _totals(section: str, lines: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {i}::BIGINT AS line, '' AS key, {label!r} || ' | ' || {value} AS cells FROM items" for i, (label, value) in enumerate(lines, 1))


@query(
    f"""{_FUSED}, v AS (SELECT question_id, min(CASE WHEN label = question_label THEN vector_rank END) AS vector_rank, min(distance) AS top_distance FROM varm GROUP BY 1),
    kk AS (SELECT k.question_id, min(CASE WHEN c.label = q.question_label THEN keyword_rank END) AS keyword_rank FROM karm k JOIN chunks c USING (chunk_id) JOIN questions q USING (question_id) GROUP BY 1),
    rr AS (SELECT f.question_id, min(CASE WHEN c.label = q.question_label THEN rank END) AS reranked_rank, arg_min(c.guideline, rank) AS top_guideline FROM fused f JOIN chunks c ON c.chunk_id = f.chunk_id JOIN questions q ON q.question_id = f.question_id GROUP BY 1),
    items AS (SELECT question_id AS item_id, CASE WHEN question_id % 60 = 0 THEN 'abstain' ELSE 'answerable' END AS kind, vector_rank, keyword_rank, reranked_rank, top_distance, question_id % 12 AS top_relevance, top_guideline,
      CASE WHEN top_distance > {CUTOFF} THEN 'distance' WHEN question_id % 12 < 4 THEN 'score' END AS gate FROM v JOIN kk USING (question_id) JOIN rr USING (question_id)),
    qs_ AS (SELECT kind, list(top_distance ORDER BY top_distance) AS d FROM items GROUP BY kind),
    at_ AS (SELECT kind, len(d) AS n, d, [least(len(d) - 1, floor(q * len(d))::INT) + 1 for q in [0.1, 0.5, 0.9]] AS i FROM qs_)
    {_totals("items", [("answerable", f"count(*) FILTER ({_A})"), ("abstain", f"count(*) FILTER ({_B})")])}
    UNION ALL {_totals("ranks", [("recall@5", _SAID.format("vector_rank <= 5", _A)), ("mrr@5", _MRR.format("vector_rank", _A)), ("recall@10", _SAID.format("vector_rank <= 10", _A))])}
    UNION ALL {_totals("candidates", [("keyword recall", _SAID.format("keyword_rank <= 10", _A)), ("union coverage", _SAID.format("(coalesce(vector_rank <= 10, false) OR coalesce(keyword_rank <= 10, false))", _A))])}
    UNION ALL {_totals("reranked", [("recall@5", _SAID.format("reranked_rank <= 5", _A)), ("mrr@5", _MRR.format("reranked_rank", _A)), ("abstain recall", _SAID.format("gate IS NOT NULL", _B)), ("over-abstain", _SAID.format("gate IS NOT NULL", _A))])}
    UNION ALL {_totals("distance gate", [("abstain recall", _SAID.format("coalesce(gate = 'distance', false)", _B)), ("over-abstain", _SAID.format("coalesce(gate = 'distance', false)", _A))])}
    UNION ALL SELECT 'top distances', 1, kind, kind || ' | ' || n || ' | ' || format('{{:.4f}}', round(d[i[1]], 4)) || ' | ' || format('{{:.4f}}', round(d[i[2]], 4)) || ' | ' || format('{{:.4f}}', round(d[i[3]], 4)) FROM at_
    UNION ALL SELECT 'relevance', 1, kind, kind || ' | ' || array_to_string([len(list_filter(r, lambda x: least(x, 10) = b)) for b in range(11)], ' | ') FROM (SELECT kind, list(top_relevance) AS r FROM items GROUP BY kind)
    UNION ALL SELECT 'not found', 1, {_KEY}, concat_ws(' | ', item_id, 'q' || item_id, coalesce(vector_rank::VARCHAR, '—'), coalesce(keyword_rank::VARCHAR, '—')) FROM items WHERE {_A} AND coalesce(vector_rank > 5, true)
    UNION ALL SELECT 'answered wrongly', 1, {_KEY}, concat_ws(' | ', item_id, 'q' || item_id, format('{{:.4f}}', round(top_distance, 4)), top_relevance, top_guideline) FROM items WHERE {_B} AND gate IS NULL
    UNION ALL SELECT 'abstained wrongly', 1, {_KEY}, concat_ws(' | ', item_id, 'q' || item_id, gate, format('{{:.4f}}', round(top_distance, 4)), top_relevance, coalesce(vector_rank::VARCHAR, '—')) FROM items WHERE {_A} AND gate IS NOT NULL"""
)
def report_retrieval(t):
    """The report of a retrieval evaluation, every line of it; labels stand in for relevance."""
    q, v, k = _arms(t)
    v, k = kept(v, "vector-arm"), kept(k, "keyword-arm")
    asked, held = q.select("question_id", "question_label"), t.chunks().select("chunk_id", "label", "guideline")
    hit = F.col("label") == F.col("question_label")
    first = lambda df, rank, *more: df.join(held, "chunk_id").join(asked, "question_id").groupBy("question_id").agg(F.min(F.when(hit, F.col(rank))).alias(rank), *more)
    vector = v.groupBy("question_id").agg(F.min(F.when(hit, F.col("vector_rank"))).alias("vector_rank"), F.min("distance").alias("top_distance"))
    merged = first(search.fused(v, k), "rank", F.min_by("guideline", "rank").alias("top_guideline")).withColumnRenamed("rank", "reranked_rank")
    rows = vector.join(first(k, "keyword_rank"), "question_id").join(merged, "question_id")
    n = F.col("question_id")
    gate = F.when(F.col("top_distance") > CUTOFF, "distance").when(n % 12 < 4, "score")
    items = rows.select(n.alias("item_id"), F.concat(F.lit("q"), n).alias("question"), F.when(n % 60 == 0, "abstain").otherwise("answerable").alias("kind"), "vector_rank", "keyword_rank", "reranked_rank", "top_distance", (n % 12).alias("top_relevance"), "top_guideline", gate.alias("gate"))
    return reports.retrieval_report(items, 5, K).where("line > 0").select("section", "line", "key", F.array_join("cells", " | ").alias("cells"))


@query(
    """WITH s AS (SELECT doc_id AS item_id, len(parts) AS claims, len(list_filter(parts, lambda x: contains(x, 'the'))) AS supported, length(text) AS chars, parts FROM (
      SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)),
    items AS (SELECT *, claims - supported AS unsupported, CASE WHEN item_id % 13 <> 0 THEN CASE WHEN claims = supported THEN 'grounded' WHEN supported > 0 THEN 'partial' ELSE 'ungrounded' END END AS verdict FROM s),
    j AS (SELECT count(*) AS n, sum(claims) AS c, sum(supported) AS s, sum(unsupported) AS u FROM items WHERE verdict IS NOT NULL)
    SELECT 'verdicts' AS section, i AS line, '' AS key, concat_ws(' | ', v, count(*) FILTER (verdict = v), format('{:.1f}%', round(count(*) FILTER (verdict = v) * 100.0::DOUBLE / count(verdict), 1))) AS cells FROM items, (VALUES (1::BIGINT, 'grounded'), (2, 'partial'), (3, 'ungrounded')) x(i, v) GROUP BY i, v
    UNION ALL SELECT 'claims', 1, '', 'all | ' || c || ' | —' FROM j UNION ALL SELECT 'claims', 2, '', concat_ws(' | ', 'supported', s, format('{:.1f}%', round(s * 100.0::DOUBLE / c, 1))) FROM j UNION ALL SELECT 'claims', 3, '', 'miscited | 0 | 0.0%' FROM j UNION ALL SELECT 'claims', 4, '', concat_ws(' | ', 'unsupported', u, format('{:.1f}%', round(u * 100.0::DOUBLE / c, 1))) FROM j
    UNION ALL SELECT 'mechanical', 1, '', 'markdown | ' || count(*) FILTER (item_id % 7 = 0) FROM items UNION ALL SELECT 'mechanical', 2, '', 'no marker | ' || count(*) FILTER (supported = 0) FROM items
    UNION ALL SELECT 'suppression', 3, '', 'insufficiency disclosed | ' || count(*) FILTER (item_id % 5 = 0 AND verdict IS NOT NULL) FROM items
    UNION ALL SELECT 'flagged', 1, format('{:020d}', item_id), concat_ws(' | ', item_id, verdict, 0, unsupported, sha256(array_to_string(list_filter(parts, lambda x: NOT contains(x, 'the'))[:2], ' / ')), '—') FROM items WHERE verdict <> 'grounded'
    UNION ALL SELECT 'failures', 1, format('{:020d}', item_id), item_id || ' | judge | late' FROM items WHERE verdict IS NULL"""
)
def report_groundedness(t):
    """The report of a groundedness evaluation: sentences as claims, supported where they hold an article; some items were not judged."""
    parts = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = t.documents.select(F.col("doc_id").alias("item_id"), "text", parts.alias("parts"))
    held, n = F.size(F.filter("parts", lambda x: F.contains(x, F.lit("the")))), F.col("item_id")
    judged = n % 13 != 0
    rows = rows.withColumns({"claims": F.size("parts"), "supported": held, "miscited": F.lit(0), "unsupported": F.size("parts") - held})
    verdict = F.when(judged, F.when(F.col("unsupported") == 0, "grounded").when(F.col("supported") > 0, "partial").otherwise("ungrounded"))
    digest = F.sha2(F.encode(F.array_join(F.slice(F.filter("parts", lambda x: ~F.contains(x, F.lit("the"))), 1, 2), " / "), "UTF-8"), 256)
    items = rows.select(
        "item_id", verdict.alias("verdict"), "claims", "supported", "miscited", "unsupported", F.array(digest).alias("examples"), F.array().cast("array<string>").alias("miscited_examples"), F.length("text").alias("answer_chars"),
        (n % 7 == 0).alias("markdown"), (F.col("supported") == 0).alias("no_marker"), (n % 5 == 0).alias("disclosed"), F.when(~judged, "judge").alias("stage"), F.when(~judged, "late").alias("reason"),
    )
    got = reports.groundedness_report(items).where("line > 0 AND NOT (section = 'suppression' AND line < 3)")
    return got.select("section", "line", "key", F.array_join("cells", " | ").alias("cells"))


@query(
    """WITH c AS (SELECT conv_id AS item_id, conv_id % 4 AS g, count(*) AS produced, count(*) FILTER (role = 'user') AS accepted, (count(*) * 7 % 20)::DOUBLE AS seconds FROM conversations GROUP BY conv_id),
    cases AS (SELECT *, g = 3 AS bare, CASE WHEN item_id % 9 = 0 THEN 'skipped' WHEN accepted > 3 OR g = 3 AND item_id % 10 > 0 THEN 'fallback' ELSE 'structured' END AS outcome, CASE WHEN item_id % 11 = 5 THEN 'no answer' END AS reason FROM c),
    e AS (SELECT * FROM cases WHERE reason IS NULL), f AS (SELECT count(*) FILTER (outcome = 'fallback' AND NOT bare) AS fell, count(*) FILTER (outcome <> 'skipped' AND NOT bare) AS rated, count(*) FILTER (outcome = 'structured' AND bare) AS bad FROM e),
    s AS (SELECT list(seconds ORDER BY seconds) AS d FROM cases WHERE outcome <> 'skipped')
    SELECT 'outcomes' AS section, i AS line, '' AS key, concat_ws(' | ', o, count(*) FILTER (outcome = o), format('{:.1f}%', round(count(*) FILTER (outcome = o) * 100.0::DOUBLE / count(*), 1))) AS cells FROM e, (VALUES (1::BIGINT, 'structured'), (2, 'fallback'), (3, 'skipped')) x(i, o) GROUP BY i, o
    UNION ALL SELECT 'fallback rate', 1, '', concat_ws(' | ', 'rate', fell, rated, format('{:.1f}%', round(fell * 100.0::DOUBLE / rated, 1)), bad) FROM f
    UNION ALL SELECT 'two legs', 1, '', 'produced | ' || sum(produced) FROM cases UNION ALL SELECT 'two legs', 2, '', 'accepted | ' || sum(accepted) FROM cases UNION ALL SELECT 'two legs', 3, '', 'share | ' || format('{:.1f}%', round(sum(accepted) * 100.0::DOUBLE / sum(produced), 1)) FROM cases
    UNION ALL SELECT 'seconds', 1, '', concat_ws(' | ', format('{:.2f}', d[floor(0.5 * len(d))::INT + 1]), format('{:.2f}', d[floor(0.9 * len(d))::INT + 1]), format('{:.2f}', d[len(d)]), '20.00') FROM s
    UNION ALL SELECT 'cases', 1, concat_ws(' ', format('{:020d}', g), format('{:020d}', item_id), 'c' || item_id), concat_ws(' | ', g, item_id, 'c' || item_id, outcome, CASE WHEN bare THEN '' ELSE 'age' END, produced, accepted, 'guided') FROM e
    UNION ALL SELECT 'failures', 1, format('{:020d}', item_id), concat_ws(' | ', item_id, 'c' || item_id, reason) FROM cases WHERE reason IS NOT NULL"""
)
def report_guidance(t):
    """The report of a guidance evaluation over conversations as cases."""
    n = F.col("item_id")
    rows = t.conversations.groupBy(F.col("conv_id").alias("item_id")).agg(F.count("*").alias("produced"), F.count_if(F.col("role") == "user").alias("accepted"))
    bare = n % 4 == 3
    outcome = F.when(n % 9 == 0, "skipped").when((F.col("accepted") > 3) | bare & (n % 10 > 0), "fallback").otherwise("structured")
    cases = rows.select(
        "item_id", F.concat(F.lit("c"), n).alias("label"), (n % 4).alias("expectation"), outcome.alias("outcome"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("age"))).alias("fields"), "produced", "accepted",
        F.when(outcome != "skipped", (F.col("produced") * 7 % 20).cast("double")).alias("seconds"), F.array(F.lit("guided")).alias("titles"), F.when(n % 11 == 5, "no answer").alias("reason"),
    )
    return reports.guidance_report(cases).where("line > 0").select("section", "line", "key", F.array_join("cells", " | ").alias("cells"))
