"""Files in and out, migrations, ports."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from evidentia.engine import ports, standins
from evidentia.engine.metrics import Metrics, StreamMetrics
from evidentia.engine.migrations import Migrations
from evidentia.functions import crypto
from evidentia.operators.profiles import prefixed_question, snapshot
from evidentia.sources import documents, downloads, sinks

DOC = {
    "title": "T", "publisher": "P", "version": "1", "publishedAt": "2024-05-01", "sourceUrl": "u",
    "sections": [{"path": ["a", "b"], "title": "b", "order": 0, "chunks": [{"content": "x", "recommendationNumber": "R1"}, {"content": "y"}]}, {"path": ["c"], "title": "c", "order": 1, "chunks": [{"content": "x"}]}],
}


def put(folder, name, value):
    (folder / name).write_text(json.dumps(value))


def test_documents_to_distinct_chunks(spark, tmp_path):
    put(tmp_path, "a.json", DOC)
    rows = documents.first_of_each_content(documents.chunk_rows(documents.ingest_documents(spark, str(tmp_path)))).orderBy("section_no", "chunk_no").collect()
    assert [(r.content, r.section_no, r.chunk_no, r.recommendationNumber) for r in rows] == [("x", 0, 0, "R1"), ("y", 0, 1, None)]


@pytest.mark.parametrize("change, said", [({"title": " "}, "title"), ({"publishedAt": "soon"}, "publishedAt"), ({"sections": []}, "sections")])
def test_broken_documents_are_named(spark, tmp_path, change, said):
    put(tmp_path, "a.json", DOC | change)
    with pytest.raises(Exception, match=said):
        documents.ingest_documents(spark, str(tmp_path)).collect()


def test_evaluation_set(spark, tmp_path):
    item = {"id": "a", "kind": "abstain", "question": "q", "status": "approved", "origin": "manual"}
    put(tmp_path, "a.json", [item, item | {"id": "b", "status": "candidate"}])
    assert [r.id for r in documents.evaluation_set(spark, str(tmp_path)).collect()] == ["a"]
    put(tmp_path, "a.json", [item | {"kind": "answerable", "expectedEvidence": []}])
    with pytest.raises(Exception, match="no expected evidence"):
        documents.evaluation_set(spark, str(tmp_path)).collect()


def test_files_and_pages(spark, tmp_path):
    path = sinks.write_file(str(tmp_path), "../../x/a:b.pdf", b"%PDF one\ftwo")
    assert path == str(tmp_path / "a_b.pdf") and sinks.safe_name("..") == sinks.safe_name("") == "unnamed"
    files = documents.landed_files(spark, str(tmp_path))
    got = documents.pages_of(files, lambda b: b.decode().split("\f")).orderBy("page_no").collect()
    assert [tuple(r) for r in got] == [("a_b.pdf", 0, "%PDF one"), ("a_b.pdf", 1, "two")]


def test_sinks(spark, tmp_path):
    sinks.append(spark.range(2), f"{tmp_path}/t")
    sinks.append(spark.range(0), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    samples = spark.createDataFrame([("up", {}, 1.0), ("h", {"le": "0.5", "a": 'x"\n'}, float("inf"))], "name string, labels map<string,string>, value double")
    assert [r.line for r in sinks.metric_lines(samples).collect()] == ['h{a="x\\"\\n",le="0.5"} +Inf', "up 1.0"]
    table = sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"))
    assert table == "| x | y |\n| --- | --- |\n| a\\|b | — |"
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5), 4)


def test_migrations_run_once_in_order(spark):
    m = Migrations()
    m.add("t", "2")(lambda df: df.withColumn("b", F.col("a") * 2))
    m.add("t", "1")(lambda df: df.withColumnRenamed("id", "a"))
    df, done = m.apply("t", spark.range(2), set())
    assert df.columns == ["a", "b"] and done == ["1", "2"] and m.apply("t", df, {"1", "2"})[1] == []
    with pytest.raises(ValueError):
        m.add("t", "1")(lambda df: df)


def test_retries_fallback_and_guards(tmp_path):
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise ports.Transient
        return "ok"

    assert ports.retried(flaky, sleep=pauses.append) == "ok" and pauses == [0.3]

    def fails(after):
        yield from "ab"[:after]
        raise OSError

    assert list(ports.first_stream([lambda: fails(0), lambda: iter("xy")])) == ["x", "y"]
    with pytest.raises(OSError):
        list(ports.first_stream([lambda: fails(1), lambda: iter("xy")]))
    guard = str(tmp_path / "guard")
    with ports.run_guard(guard), pytest.raises(FileExistsError), ports.run_guard(guard):
        pass
    stop, seen = iter([False, False, True, True]), []
    assert ports.until_cancelled("abc", seen.append, lambda: next(stop)) == "CANCELLED" and seen == ["a", "b"]
    assert ports.OverlapReranker().rerank("knee pain", ["hip", "knee pain"]) == ([1, 0], 10.0)


def test_embedding_in_batches(spark):
    class Shuffled(ports.SeededEmbedder):
        def embed(self, texts):
            assert len(texts) <= ports.EMBED_BATCH
            return super().embed(texts)[::-1]

    rows = ports.embed_column(spark.createDataFrame([(str(i),) for i in range(200)], "t string").coalesce(1), "t", "v", Shuffled(4)).collect()
    assert len(rows) == 200 and all(r.v == ports.seeded_vector(r.t, 4).tolist() for r in rows)


def test_profiles(spark):
    df = spark.createDataFrame([("q", 61, None), ("q", None, "")], "question string, age int, sex string")
    asked = df.select(prefixed_question(F.col("question"), {"age": F.col("age"), "sex": F.col("sex")})).collect()
    assert [r[0] for r in asked] == ["[age: 61] q", "q"]
    keys = {1: b"k" * 32}
    opened = df.select(crypto.decrypt(snapshot({"age": F.col("age"), "sex": F.col("sex")}, keys, 1), keys)).collect()
    assert [json.loads(r[0]) for r in opened] == [{"age": 61}, {"sex": ""}]


# -- downloads, table functions, metrics, providers --------------------------------


def test_a_lane_keeps_its_pace():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    pace, asked = downloads.Pace(2, 4, 2.0, lambda: now[0], sleep), []
    for took in (0.1, 3.0, 0.0, 0.0):
        pace.wait()
        asked.append(round(now[0] - 100.0, 6))
        now[0] += took
    assert asked == [1.0, 3.0, 6.0, 8.0] and slept == [1.0, 1.9, 2.0]  # a slow answer is not made up for
    lanes, times = [downloads.Pace(i, 3, 5.0, lambda: 0.0, lambda s: None) for i in range(3)], []
    for _ in range(4):
        for p in lanes:
            times.append(p.next)
            p.wait()
    assert all(abs(b - a - 0.2) < 1e-9 for a, b in zip(times, times[1:]))


def test_downloads_in_order_below_the_rate_with_failures_as_rows(spark):
    def fetch(external_id, url):
        if external_id == "e3":
            raise TimeoutError("no answer")
        return (b"%PDF-" + external_id.encode() if external_id != "e5" else b"<html>"), ("application/pdf" if external_id != "e5" else "text/html; charset=utf-8")

    items = spark.createDataFrame([(f"e{i}", f"https://x/{i}", "more") for i in range(12)], "external_id string, url string, title string")
    rows = sources_written(spark, downloads.downloaded(items, fetch, per_second=20.0, lanes=2)).collect()
    assert len(rows) == 12 and {r.external_id: r.error for r in rows if r.error} == {"e3": "e3: TimeoutError: no answer"}
    for lane in {r.lane for r in rows}:
        own = sorted((r for r in rows if r.lane == lane), key=lambda r: r.nth)
        assert [r.external_id for r in own] == sorted(r.external_id for r in own)
        assert all(b.asked_at - a.asked_at > 0.095 for a, b in zip(own, own[1:]))  # two lanes of ten a second
    fetched = spark.createDataFrame(rows, downloads.FETCHED)
    same = fetched.where("external_id = 'e7'").select("external_id", F.sha2("body", 256).alias("digest"))
    got = {r.external_id: (r.verdict, r.reason) for r in downloads.acquired(fetched, same).collect()}
    assert got["e3"][0] == "FAILED" and got["e5"] == ("SKIPPED", None) and got["e7"] == ("UNCHANGED", None) and got["e1"] == ("FETCHED", None)
    bare = fetched.where("external_id = 'e1'").withColumn("body", F.lit(b"no"))
    assert downloads.acquired(bare, same).first().reason == "no PDF"
    assert downloads.downloaded(items.limit(0), fetch).count() == 0


def sources_written(spark, df):
    """The rows of one evaluation."""
    return spark.createDataFrame(df.collect(), df.schema)


def test_bodies_in_parts_and_extractors_that_fail(spark):
    text = "".join(f"line {i}\f" for i in range(3000))
    body = text.encode()
    parts = [("whole", 0, body), *[("cut", i, body[i * 1000 : (i + 1) * 1000]) for i in range(len(body) // 1000 + 1)], ("bad", 0, b"\xff"), ("none", 0, None), ("zero", 0, b"")]
    df = spark.createDataFrame(parts, "name string, part int, body binary").repartition(3)
    got = documents.extracted(df, lambda b: b.decode().split("\f")).orderBy("name", "page_no").collect()
    pages = {n: [r.text for r in got if r.name == n] for n in ("whole", "cut")}
    assert pages["whole"] == pages["cut"] == text.split("\f")
    bad = [r for r in got if r.name == "bad"]
    assert len(bad) == 1 and bad[0].page_no is None and bad[0].error.startswith("UnicodeDecodeError")
    assert [(r.name, r.text, r.error) for r in got if r.name in ("none", "zero")] == [("none", "", None), ("zero", "", None)]
    assert documents.extracted(df.limit(0), lambda b: []).count() == 0


def test_numbers_told_by_jobs_equal_an_aggregation(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("v"))
    told, parts = Metrics(), {"histograms": {"v": (F.col("v"), [10.0, 500.0])}, "counters": {"rows": F.count("*")}, "gauges": {"last": F.max("id")}}
    for half in (df.where("id < 300"), df.where("id >= 300")):
        told.watch(half, {"job": "a"}, **parts).groupBy((F.col("id") % 3).alias("k")).count().collect()
    told.watch(df.where("id < 0"), {"job": "b"}, **parts).collect()
    got = {(r.name, *sorted(r.labels.items())): r.value for r in told.samples(spark).collect()}
    n, total, low, mid = df.agg(F.count("v"), F.sum("v"), F.count_if(F.col("v") <= 10), F.count_if(F.col("v") <= 500)).first()
    a = ("job", "a")
    assert got[("rows", a)] == 1000 and got[("last", a)] == 999 and got[("v_count", a)] == got[("v_bucket", a, ("le", "+Inf"))] == n and got[("v_sum", a)] == total
    assert (got[("v_bucket", a, ("le", "10"))], got[("v_bucket", a, ("le", "500"))]) == (low, mid) and got[("rows", ("job", "b"))] == 0 and ("last", ("job", "b")) not in got
    lines = [r.line for r in sinks.metric_lines(told.samples(spark)).collect()]
    assert 'rows{job="a"} 1000.0' in lines and 'v_bucket{job="a",le="+Inf"} 857.0' in lines

    df.write.parquet(f"{tmp_path}/in")
    streamed, listener = Metrics(), None
    listener = StreamMetrics(streamed, "told", {"job": "s"})
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("told", *Metrics.columns(**parts))
        q = rows.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            got = {(r.name, *sorted(r.labels.items())): r.value for r in streamed.samples(spark).collect()}
            if got.get(("rows", ("job", "s"))) == 1000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert got[("rows", ("job", "s"))] == 1000 and got[("v_sum", ("job", "s"))] == total


def test_what_providers_say_is_checked(spark):
    piece = lambda n: {"marker": n, "title": f"t{n}", "path": ["p"], "content": f"c{n}. More of it! " * n}

    class Odd:
        def structure(self, question, evidence, factors):
            if question == "fails":
                raise ValueError(question)
            item = lambda markers, own: {"title": f"{markers}{own}", "rationale": "r", "applicability": "CAUTION", "markers": markers, "factors": own}
            return [item([1], ["age"]), item([1, 9], ["age"]), item([1], ["age", "other"]), item([], ["age"]), item([1], []), item(None, None)]

    rows = [(i, q, [piece(n) for n in range(1, n + 1)], f) for i, (q, n, f) in enumerate([("a", 2, ["age"]), ("fails", 2, ["age"]), ("b", 2, []), ("c", 0, []), (None, 1, None)])]
    df = spark.createDataFrame(rows, f"id int, question string, evidence array<{standins.PIECE}>, factors array<string>")
    got = {r.id: r for r in standins.composed(standins.accepted(standins.structured(df, Odd()))).collect()}
    assert [(got[i].source, got[i].titles) for i in range(5)] == [("structured", ["[1]['age']"]), ("citations", ["t1", "t2"]), ("citations", ["t1", "t2"]), ("summary", ["summary"]), ("citations", ["t1"])]
    assert got[1]["items"] is None
    said = {r.id: r for r in standins.judged(standins.answered(df, standins.QuotingAnswerer()), standins.MarkerJudge()).collect()}
    assert said[0].answer == "c1  More of it [1]. c2  More of it  c2  More of it [2]. Little else is known." and said[0].judgement.asDict() == {"claims": 3, "supported": 2, "unsupported": 1, "verdict": "partial"}
    items = standins.structured(df, standins.EvidenceStructurer()).where("id = 0").first()["items"]
    assert [(x.title, x.markers, x.factors) for x in items] == [("t1 > p", [1], ["age"]), ("t2 > p", [2], ["age"])]

    class Slow:
        def judge(self, question, answer, evidence):
            time.sleep(2)

    assert standins.judged(standins.answered(df.limit(1), standins.QuotingAnswerer()), Slow(), seconds=0.1).first().judgement is None
