"""Operators where the driver's tables have no hard cases: documents, state, encryption, search, sources, streams."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from evidentia.engine import ports
from evidentia.engine.config import RetrievalConfig, positive
from evidentia.functions import crypto, lenient, reporting, text, trigram
from evidentia.operators import curated, evaluation, guideline, lifecycle, paging, reports, search, series, statistics
from evidentia.sources import catalog, frames, sinks
from evidentia.streaming import keyed, streams, timed

# -- documents -------------------------------------------------------------------

MAIN = [
    "1\n차례\n【R1】 ..... 12",
    "12\nⅣ. 권고사항\n1. 한약\n【R1】 제목\n권고안 권고등급/근거수준\n환자에게 한약을 투여하는 것을 권\n고한다. A/Moderate 1,2)\n[임상적 고려사항]\n주의가 필요하다.\n(1) 배경\n설명이 이어진다.",
    "13\n2) 침\n(2) 근거\n【R2】 는 따로 다룬다.\n(3) 참고문헌\n[참고문헌]\n1. Kim.\n【R2】\n권고안 권고등급/근거수준\n침을 고려한다. Insufficient / GPP",
    "14\n【R3】 전문가그룹의 공식적 합\n의를 통해 권고한다.\n(1) 배경\n이유.",
    "15\n【R4】\n통계적 유의성이 없어서 권고안 도\n출에 반영하지 않았다.\n【R5】\n권고안 권고등급/근거수준\n투여한다. C/Vey Low",
]


def test_blocks_grades_and_paths():
    r = guideline.read_document(MAIN)
    assert r.numbers == ["R1", "R2", "R3", "R5"] and r.not_derived == ["R4"]
    assert r.missing == r.duplicated == r.ungraded == [] and r.unknown_levels == [("R5", "Vey Low")]
    got = [(c.number, c.grade, c.level, c.page_start, c.page_end) for c in r.chunks]
    assert got == [
        ("R1", "A", "Moderate", 12, 12), ("R1", None, None, 12, 13), ("R2", "GPP", "Insufficient", 13, 13),
        ("R3", "GPP", None, 14, 14), ("R3", None, None, 14, 15), ("R5", "C", None, 15, 15),
    ]
    assert r.chunks[0].content == "환자에게 한약을 투여하는 것을 권고한다.\n[임상적 고려사항]\n주의가 필요하다."
    assert r.chunks[0].path == ("Ⅳ. 권고사항", "1. 한약") and r.chunks[2].path == ("Ⅳ. 권고사항", "1. 한약", "2) 침")
    assert [len(own) for _, own in r.sections] == [2, 4]


def test_a_marker_without_grade_is_diagnosed():
    r = guideline.read_document(["3\n【R1】\n권고안 권고등급/근거수준\n등급이 없다.", "4\n【R2】\n인용이다.\n【R1】\n권고안 권고등급/근거수준\n다시. B/Low"])
    assert r.missing == ["R2"] and r.ungraded == [] and [c.number for c in r.chunks] == ["R1", "R1"]
    assert guideline.read_document(["본문만 있다."]).numbers == [] and guideline.read_document([]).chunks == []


def test_bare_markers_count_only_without_brackets():
    bare = ["3\n권고안 번호 권고내용 권고등급/근거수준\nR1 약을 권한다. B / Very low\nR2. 침을 권한다. GPP"]
    r = guideline.read_document(bare)
    assert [(c.number, c.grade, c.level, c.content) for c in r.chunks] == [("R1", "B", "Very Low", "약을 권한다."), ("R2", "GPP", None, "침을 권한다.")]
    assert guideline.has_marker(bare) and not guideline.has_marker(["3\nR1 = 2"])
    assert guideline.read_document([bare[0] + "\n【R9】"]).numbers == ["R9"]


def test_line_breaks_are_undone():
    join = guideline.unwrapped
    assert join("inter-\nvention") == "intervention" and join("low\ndose") == "low dose" and join("권\n고한다") == "권고한다"
    assert join("환자를\n위해") == "환자를 위해" and join("를\n위해") == "를위해" and join("3\ndays") == "3 days"
    assert join("3-\n4") == "3-4" and join("약\n은\n좋다") == "약은 좋다" and join("a\nb-\nc\n약") == "a bc약"


def test_ratings():
    rating = guideline.rating_of
    assert rating("투여한다. A / High 1,2)") == guideline.Rating("A", "High") and rating("GPP") == guideline.Rating("GPP")
    assert rating("한다. B./very  low").level == "Very Low" and rating("한다. C/Vey Low") == guideline.Rating("C", None, "Vey Low")
    assert rating("등급이 없다.") is None and rating("Insufficient / GPP") == guideline.Rating("GPP", "Insufficient")


BLOCK = "【{0}】\n권고안 권고등급/근거수준\n{1}"


@pytest.mark.parametrize(
    "blocks, duplicated, ungraded",
    [
        ([("R1", "한다. A/High"), ("R2", "한다. B/Low")], [], []),
        ([("R1", "한다. A/High"), ("R1", "한다. B/Low")], ["R1"], []),  # graded twice
        ([("R1", "등급이 없다."), ("R1", "한다. B/Low")], ["R1"], []),  # an unread grade first: a statement all the same
        ([("R1", "한다. B/Low"), ("R1", "등급이 없다.")], [], []),  # what follows a graded one without a grade is taken for its explanation
        ([("R1", "등급이 없다."), ("R1", "등급이 없다.")], [], ["R1"]),
        ([("R1", "등급이 없다."), ("R2", "한다. B/Low"), ("R1", "한다. A/Low"), ("R2", "한다. A/Low")], ["R1", "R2"], []),
    ],
)
def test_numbers_that_stand_twice(blocks, duplicated, ungraded):
    r = guideline.read_document(["3\n" + "\n".join(BLOCK.format(*b) for b in blocks)])
    assert (r.duplicated, r.ungraded, r.missing) == (duplicated, ungraded, [])


LAYOUTS = {
    "trailing consideration": ("7\n" + BLOCK.format("R1", "침을 권한다. A/High\n임상적 고려사항\n출혈을 살핀다."), [("R1", "A", "High", "침을 권한다.\n임상적 고려사항\n출혈을 살핀다.")]),
    "no consideration": ("7\n" + BLOCK.format("R1", "침을 권한다. B/Low\n(1) 배경\n이유이다."), [("R1", "B", "Low", "침을 권한다."), ("R1", None, None, "(1) 배경\n이유이다.")]),
    "dotted grade": ("7\n" + BLOCK.format("R1-1", "뜸을 권한다. C./Moderate"), [("R1-1", "C", "Moderate", "뜸을 권한다.")]),
    "parenthesised number": ("7\n" + BLOCK.format("R(가1)", "약을 권한다. D/Very Low"), [("R(가1)", "D", "Very Low", "약을 권한다.")]),
    "inconclusive": ("7\n" + BLOCK.format("R2", "판단을 미룬다. Inconclusive"), [("R2", "Inconclusive", None, "판단을 미룬다.")]),
    "references end a block": ("7\n" + BLOCK.format("R3", "약을 권한다. GPP\n[참고문헌]\n1. Kim A."), [("R3", "GPP", None, "약을 권한다.")]),
    "consensus": ("7\n【R4】 전문가 합의를\n통해 권고한다.\n① 배경\n이유이다.", [("R4", "GPP", None, "전문가 합의를 통해 권고한다."), ("R4", None, None, "① 배경\n이유이다.")]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    r = guideline.read_document([page])
    assert [(c.number, c.grade, c.level, c.content) for c in r.chunks] == want and r.missing == r.duplicated == []


DOCUMENTS = {
    # a contents page and a summary name the numbers before the chapter that has the blocks
    "decoys": (["1\n차례\n【R1】 침 ..... 30", "5\nⅡ. 요약\n【R1】\n요약이다. A/High", "30\nⅣ. 권고사항\n" + BLOCK.format("R1", "침을 권한다. B/Low"), "40\nⅤ. 부록\n" + BLOCK.format("R9", "부록이다. A/High")],
               dict(numbers=["R1"], graded=[("R1", "B", "Low")], paths={("Ⅳ. 권고사항",)})),
    "roman and symbol heads": (["30\nIV 권고 및 해설\n● 한약\n■ 탕약\n" + BLOCK.format("R1", "한다. A/Low"), "31\n■ 환약\n" + BLOCK.format("R2", "한다. A/Low"), "32\n● 침\n" + BLOCK.format("R3", "한다. A/Low")],
                               dict(numbers=["R1", "R2", "R3"], paths={("Ⅳ. 권고 및 해설", "● 한약", "■ 탕약"), ("Ⅳ. 권고 및 해설", "■ 환약"), ("Ⅳ. 권고 및 해설", "● 침")})),
    "no chapter for recommendations": (["2\n1. 침\n" + BLOCK.format("R1", "한다. A/Low"), "3\n2. 뜸\n" + BLOCK.format("R2", "한다. A/Low")], dict(numbers=["R1", "R2"], paths={("1. 침",), ("2. 뜸",)})),
    "a mention in an explanation is no number of its own": (["7\n" + BLOCK.format("R1", "한다. A/High\n(1) 배경\n【R7】 참조."), "8\n이어진다."], dict(numbers=["R1"])),
    "references end an explanation": (["7\n" + BLOCK.format("R1", "한다. A/High\n(1) 배경\n이유.\n[참고문헌]\n【R7】 인용."), "8\n이어진다."], dict(numbers=["R1", "R7"], missing=["R7"])),
    "not derived": (["7\n" + BLOCK.format("R1", "한다. A/High"), "8\n【R2】 근거가 모자라\n권고안 도출에 반영하지\n않았다.", "9\n" + BLOCK.format("R3", "한다. A/High")], dict(numbers=["R1", "R3"], not_derived=["R2"])),
    "unknown levels": (["7\n" + BLOCK.format("R1", "한다. A/Verry Low 3)") + "\n" + BLOCK.format("R2", "한다. B/Fair")], dict(numbers=["R1", "R2"], unknown_levels=[("R1", "Verry Low"), ("R2", "Fair")], graded=[("R1", "A", None), ("R2", "B", None)])),
    "words over lines": (["7\n" + BLOCK.format("R1", "inter-\nvention을 권\n한다. low\ndose 환자를\n살핀다. A/High")], dict(contents=["intervention을 권한다. low dose 환자를 살핀다."])),
    "blocks over pages": (["7\n" + BLOCK.format("R1", "첫 쪽의"), "8\n글이다. A/High\n(1) 배경\n이유", "9\n이다."], dict(pages=[(7, 8), (8, 9)], contents=["첫 쪽의 글이다.", "(1) 배경\n이유이다."])),
    "a page without a printed number is left out": (["7\n" + BLOCK.format("R1", "한다. A/High"), "그림\n" + BLOCK.format("R2", "한다. A/High")], dict(numbers=["R1"])),
    "interleaved considerations": (["7\n" + BLOCK.format("R1", "권한다. A/High\n[임상적 고려사항]\n살핀다.\n① 배경\n이유.\n[임상적 고려사항]\n또 살핀다.")], dict(contents=["권한다.\n[임상적 고려사항]\n살핀다.\n[임상적 고려사항]\n또 살핀다.", "① 배경\n이유."])),
    "a marker without a block": (["7\n" + BLOCK.format("R1", "한다. A/High") + "\n【R2】\n글만 있다."], dict(numbers=["R1", "R2"], missing=["R2"])),
    "a grade of both orders": (["7\n" + BLOCK.format("R1", "한다. GPP/Low") + "\n" + BLOCK.format("R2", "한다. Moderate / GPP") + "\n" + BLOCK.format("R3", "한다. A/CTB")], dict(graded=[("R1", "GPP", "Low"), ("R2", "GPP", "Moderate"), ("R3", "A", "CTB")])),
}


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents_of_several_pages(name):
    pages, want = DOCUMENTS[name]
    r = guideline.read_document(pages)
    got = dict(
        numbers=r.numbers, missing=r.missing, not_derived=r.not_derived, unknown_levels=r.unknown_levels, graded=[(c.number, c.grade, c.level) for c in r.chunks if c.grade],
        paths={c.path for c in r.chunks}, contents=[c.content for c in r.chunks], pages=[(c.page_start, c.page_end) for c in r.chunks],
    )
    assert {k: got[k] for k in want} == want
    assert r.duplicated == [] and ("missing" in want or r.missing == [])


def test_documents_over_many_batches(spark):
    pages = [(d, p, f"{p + 1}\n" + BLOCK.format(f"R{p}", f"글 {d}. A/High")) for d in range(90) for p in range(7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = guideline.read_documents(spark.createDataFrame(pages, "doc_id long, page_no int, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.doc_id for r in rows) == [*range(90)] and all(r.numbers == [f"R{p}" for p in range(7)] and r.n_chunks == 7 for r in rows)
    assert all([c.content for c in r.chunks] == [f"글 {r.doc_id}."] * 7 for r in rows)


def test_templates_against_expectations(spark):
    graded, ungraded, odd = BLOCK.format("R1", "한다. A/High"), BLOCK.format("R1", "없다."), BLOCK.format("R1", "한다. A/Unheard")
    pages = [(i, 0, "3\n" + text) for i, text in enumerate([graded, "본문", ungraded, graded, "본문", "본문", graded, graded, odd, graded, ungraded, graded, graded])]
    pages = spark.createDataFrame(pages, "doc_id long, page_no int, text string")
    readings = guideline.read_documents(pages)
    level = readings.where("doc_id = 8").first().unknown_levels
    expected = [
        (0, "OK", 1, 1, None, None, None), (1, "NOT_TARGET", 0, 0, None, None, None), (2, "OK", 1, 1, ["R1"], None, None), (4, "NOT_TARGET", 0, 0, None, None, None),
        (5, "OK", 0, 0, None, None, None), (6, "NOT_TARGET", 0, 0, None, None, None), (7, "OK", 2, 1, None, ["R4"], None), (8, "OK", 1, 1, None, None, level), (9, "OK", 1, 1, None, None, ["R1: x"]),
        (10, "PARTIAL", 1, 0, ["R1", "R1"], None, None), (11, "PARTIAL", 1, 1, None, None, None), (12, "OK", 1, 1, None, None, None), (99, "OK", 1, 1, None, None, None),
    ]
    schema = "doc_id long, status string, unique_numbers int, recommendations int, unparsed array<string>, not_derived array<string>, unknown_levels array<string>"
    listed = spark.createDataFrame([(1,), (6,), (12,), (12,)], "doc_id long")
    got = {r.doc_id: (r.outcome, r.reasons) for r in guideline.verified_templates(readings, spark.createDataFrame(expected, schema), listed).collect()}
    same = ("same", [])
    assert level and got == {
        0: same, 1: same, 2: ("mismatch", ["recommendations", "status"]), 3: ("unexpected", []), 4: ("mismatch", ["not_listed"]), 5: same, 6: ("mismatch", ["numbers", "recommendations", "read_no_target"]),
        7: ("mismatch", ["numbers", "not_derived"]), 8: same, 9: ("mismatch", ["unknown_levels"]), 10: same, 11: ("mismatch", ["status"]), 12: ("mismatch", ["listed"]), 99: ("missing", []),
    }
    waivers = spark.createDataFrame([(2, ["R1"])], "doc_id long, waived array<string>")
    after = guideline.verified_templates(guideline.waived(readings, waivers), spark.createDataFrame([(2, "OK", 1, 0, None, None, None)], schema), listed.limit(0))
    assert after.where("doc_id = 2").first().outcome == "same"


def test_series_in_cells_against_whole_series(spark):
    import random

    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), start + dt.timedelta(seconds=rng.choice([0, 10, 40, 400, 4000]) + rng.randrange(200)), i, rng.choice([None, *range(9)])) for i in range(400)]
    rows += [("hot", None, 900, 4), ("lone", start, 901, 3)]
    df = spark.createDataFrame([(k, at, i, None if v is None else float(v)) for k, at, i, v in rows], "k string, at timestamp, i int, v double")
    up, turned = {}, {}
    for series_ in {r[0] for r in rows}:
        line, before = sorted((r for r in rows if r[0] == series_ and r[1]), key=lambda r: (r[1], r[2])), None
        deltas = []
        for n, (_, at, i, v) in enumerate(line):
            before = line[n - 1][3] if n else None
            deltas.append((at, v if before is not None and (v is None or v < before) else 0.0 if before is None else v - before, before is not None and v is not None and v != before))
            deltas[-1] = (at, deltas[-1][1] if v is not None or before is None else None, deltas[-1][2])
        for (_, at, i, _) in line:
            near = [d for d in deltas if 0 <= (at - d[0]).total_seconds() <= 30]
            sums = [d[1] for d in near if d[1] is not None]
            up[i], turned[i] = sum(sums) if sums else None, sum(d[2] for d in near)
    got = {r.i: r.increase for r in series.increase(df, ["k"], "at", "i", "v", 30).collect()}
    assert got == up | {900: None}
    got = {r.i: r.changes for r in series.changes(df, ["k"], "at", "i", "v", 30).collect()}
    assert got == turned | {900: 0}
    celled = series._celled(df, "at", 30)
    assert celled.where("k = 'hot'").select("__cell").distinct().count() > 5


def test_sums_of_windows_are_running_sums(spark):
    """A sliding frame adds up a whole window for each row, which is quadratic where rows are dense in time."""
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=i // 40 * 3 + (30 if i > 900 else 0)), i, float("inf") if i == 500 else float(i * 7 % 13)) for i in range(1200)]
    df = spark.createDataFrame(rows, "at timestamp, i int, v double").withColumn("k", F.lit("one"))
    up = series.increase(df, ["k"], "at", "i", "v", 30)
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([\w-]+)", up._jdf.queryExecution().optimizedPlan().toString())
    assert {*frames} == {"unboundedpreceding"}
    deltas = [0.0, *(b[2] - a[2] if b[2] >= a[2] else b[2] for a, b in zip(rows, rows[1:]))]
    want = {i: sum(d for (at, _, _), d in zip(rows, deltas) if 0 <= (now - at).total_seconds() <= 30) for now, i, _ in rows}
    assert {r.i: r.increase for r in up.collect()} == want


def test_reports_of_the_three_evaluations(spark, tmp_path):
    schema = "item_id string, question string, kind string, vector_rank int, keyword_rank int, reranked_rank int, top_distance double, top_relevance double, top_guideline string, gate string"
    items = [
        ("a1", "q|1", "answerable", 1, None, 1, 0.1, 9.6, "g", None), ("a2", "q2", "answerable", 7, 2, 4, 0.2, 12.0, "g", None), ("a3", "q3", "answerable", None, None, None, float("inf"), None, None, "distance"),
        ("n1", "q4", "abstain", None, None, None, 0.9, 3.0, "h", "score"), ("n2", "q5", "abstain", None, None, None, 0.4, 8.0, "h", None),
    ]
    of = lambda report: {(r.section, r.line, r.key): r.cells for r in report.collect()}
    report = reports.retrieval_report(spark.createDataFrame(items, schema))
    got = of(report)
    value = lambda section, line: got[section, line, ""][1:]
    assert value("items", 1) == ["3"] and value("ranks", 1) == ["0.333"] and value("ranks", 2) == ["0.333"] and value("ranks", 3) == ["0.667"]
    assert value("candidates", 1) == ["0.333"] and value("candidates", 2) == ["0.667"] and value("reranked", 1) == ["0.667"] and value("reranked", 2) == ["0.417"]
    assert value("reranked", 3) == ["0.500"] and value("reranked", 4) == ["0.333"] and value("distance gate", 1) == ["0.000"] and value("distance gate", 2) == ["0.333"]
    assert got["top distances", 1, "abstain"] == ["abstain", "2", "0.4000", "0.9000", "0.9000"] and got["top distances", 1, "answerable"] == ["answerable", "2", "0.1000", "0.2000", "0.2000"]
    assert got["relevance", 1, "answerable"] == ["answerable", *["0"] * 10, "2"] and {k[2] for k in got if k[:2] == ("not found", 1)} == {"a2", "a3"}
    assert got["answered wrongly", 1, "n2"] == ["n2", "q5", "0.4000", "8.0", "h"] and got["abstained wrongly", 1, "a3"] == ["a3", "q3", "distance", "—", "—", "—"]
    sinks.write_report(report, "Search", ["not found", "items"], f"{tmp_path}/report")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report", wholetext=False).collect()]
    assert lines[:7] == ["# Search", "", "## not found", "", "| item | question | vector rank | keyword rank |", "| --- | --- | --- | --- |", "| a2 | q2 | 7 | 2 |"] and lines[-2:] == ["| answerable | 3 |", "| abstain | 2 |"]

    schema = "item_id long, verdict string, claims int, supported int, miscited int, unsupported int, examples array<string>, miscited_examples array<string>, answer_chars int, markdown boolean, no_marker boolean, disclosed boolean, stage string, reason string"
    items = [
        (2, "grounded", 4, 4, 0, 0, [], [], 100, False, False, True, None, None), (10, "partial", 4, 2, 1, 1, ["x|y"], ["z"], 50, True, False, False, None, None),
        (3, None, None, None, None, None, None, None, 30, False, True, None, "judge", "late"), (4, None, None, None, None, None, None, None, None, None, None, None, "answer", "down"),
    ]
    got = of(reports.groundedness_report(spark.createDataFrame(items, schema)))
    assert value("verdicts", 1) == ["1", "50.0%"] and value("verdicts", 3) == ["0", "0.0%"] and value("claims", 1) == ["8", "—"] and value("claims", 3) == ["1", "12.5%"]
    assert value("mechanical", 1) == ["1"] and value("mechanical", 2) == ["1"] and value("suppression", 1) == ["4.0"] and value("suppression", 2) == ["60.0"] and value("suppression", 3) == ["1"]
    assert [c for k, c in sorted(got.items()) if k[0] == "flagged"][1] == ["10", "partial", "1", "1", "x|y", "z"] and sum(k[0] == "failures" for k in got) == 3
    got = of(reports.groundedness_report(spark.createDataFrame([], schema)))
    assert value("verdicts", 1) == ["0", "—"] and value("suppression", 1) == ["0.0"]

    schema = "item_id string, label string, expectation string, outcome string, fields array<string>, produced int, accepted int, seconds double, titles array<string>, reason string"
    cases = [("b", "x", "full", "structured", ["age"], 3, 2, 1.0, ["t1", "t2"], None), ("a", "y", "full", "fallback", ["age"], 2, 0, 4.0, [], None), ("a", "x", "none", "structured", [], 1, 1, 2.0, ["t"], None), ("c", "x", "none", "skipped", ["age"], 0, 0, None, [], None), ("d", "x", "none", None, ["age"], None, None, None, None, "down")]
    got = of(reports.guidance_report(spark.createDataFrame(cases, schema)))
    assert value("outcomes", 1) == ["2", "50.0%"] and got["fallback rate", 1, ""] == ["rate", "1", "2", "50.0%", "1"] and value("two legs", 3) == ["50.0%"]
    assert got["seconds", 1, ""] == ["2.00", "4.00", "4.00", "20.00"] and [k[2] for k in sorted(got) if k[:2] == ("cases", 1)] == ["full a y", "full b x", "none a x", "none c x"]
    assert got["failures", 1, "d"] == ["d", "x", "down"]


def test_the_shipped_list_of_defects_waives_one_state(spark):
    (i, v, h, _, numbers) = curated.SOURCE_DEFECTS[0]
    docs = spark.createDataFrame([(1, "NCKM", i, v, h), (2, "NCKM", i, "2020-01", h), (3, "NCKM", i, v, "0"), (4, "other", i, v, h)], "doc_id long, source_system string, external_id string, version string, file_hash string")
    assert [(r.doc_id, r.waived) for r in curated.known_defects(docs, curated.source_defects(spark)).collect()] == [(1, list(numbers))]


def test_tokens_are_consumed_once(spark):
    rows = [("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("a", 9, 4), ("b", 9, 5), ("b", 8, 6), (None, 1, 7), ("c", None, 8), ("a", 1, 2)]
    df = spark.createDataFrame([(*r, 8) for r in rows], "token string, at int, n int, until int")
    got = {(r.token, r.n): r.outcome for r in lifecycle.claimed(df, "token", "at", ["n"], "until").collect()}
    want = {("a", 1): "consumed", ("a", 2): "accepted", ("a", 3): "consumed", ("a", 4): "expired", ("b", 5): "expired", ("b", 6): "expired", (None, 7): "unknown", ("c", 8): "expired"}
    assert got == want
    assert lifecycle.claimed(df, "token", "at", ["n"]).where("outcome = 'accepted'").count() == 3


def test_revisions_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 2), ("a", 2), ("a", 1)], "k string, r int")
    assert sorted((r.k or "", r.r, r.status) for r in lifecycle.superseded(df, ["k"], "r").collect()) == [("", 1, "SUPERSEDED"), ("", 2, "ACTIVE"), ("a", 1, "SUPERSEDED"), ("a", 2, "ACTIVE"), ("a", 2, "ACTIVE")]


def test_a_null_key_has_one_machine(spark):
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, i), True) for k in (None, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, at timestamp, failed boolean")
    got = keyed.fold(df, ["k"], "at", ["at"], keyed.Breaker, ["failed"], "state", "string").orderBy("k", "at").collect()
    assert [r.state for r in got] == (["closed"] * 4 + ["open", "rejected", "rejected"]) * 2


def test_calls_that_hang_are_bounded():
    import threading

    stop, n = threading.Event(), threading.active_count()
    assert [ports.within(stop.wait, 0.02, lambda: "late") for _ in range(ports.HANGING + 5)] == ["late"] * (ports.HANGING + 5)
    assert threading.active_count() <= n + ports.HANGING
    stop.set()
    assert ports.within(lambda: 1, 5.0, lambda: 0) == 1
    with pytest.raises(ZeroDivisionError):
        ports.within(lambda: 1 / 0, 5.0, lambda: 0)


def test_curated_lists(spark):
    (i, v, h), (j, w, _) = curated.NOT_TARGETS[0], curated.NOT_TARGETS[1]
    docs = spark.createDataFrame([("NCKM", i, v, h), ("NCKM", j, w, "0"), ("NCKM", "1", v, h), ("other", i, v, h), ("NCKM", i, "2014-01", "0")], "source_system string, external_id string, version string, file_hash string")
    got = [(r.listed, r.expired, r.differs) for r in curated.looked_up(docs, curated.not_targets(spark)).orderBy("source_system", "external_id", "version").collect()]
    assert got == [(False, False, None), (True, False, []), (False, True, ["version", "file_hash"]), (False, True, ["file_hash"]), (False, False, None)]
    assert len(curated.NOT_TARGETS) == 15 and curated.source_defects(spark).first().waived == ["R20"]


def test_long_texts_are_cut_after_sentences():
    assert guideline.cut_points("a. b. cccc", 5) == [5] and guideline.cut_points("x" * 11, 5) == [5, 10] and guideline.cut_points("abc", 5) == []
    parts = [guideline.Chunk((), "", "x" * 9, None, None, 1, 2), guideline.Chunk((), "", "y" * 3, None, None, 3, 3)]
    assert [(c.content, c.page_start, c.page_end) for c in guideline.bounded(parts, 8)] == [("x" * 8, 1, 2), ("x\nyyy", 1, 3)]


def test_only_the_first_part_of_a_long_statement_is_graded(spark):
    page = "3\n【R1】\n권고안 권고등급/근거수준\n" + "\n".join(f"문장 {i} 이다." for i in range(900)) + " A/High"
    rows = guideline.chunk_documents(spark.createDataFrame([(1, 0, page), (2, 0, None)], "doc_id long, page_no int, text string")).orderBy("chunk_no").collect()
    assert len(rows) > 1 and [r.grade for r in rows] == ["A"] + [None] * (len(rows) - 1) and all(len(r.content) <= 6000 for r in rows)


# -- functions -------------------------------------------------------------------


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__")).select(column).first()[0]


def test_titles_and_truncation_count_as_stated(spark):
    assert one(spark, text.title(F.col("x")), x=" a\t　b\n") == "a b" and one(spark, text.title(F.col("x")), x=" \n") is None
    assert one(spark, text.title(F.col("x")), x="😀" * 41) == "😀" * 40 + "…" and one(spark, text.title(F.col("x")), x="😀" * 40) == "😀" * 40
    assert one(spark, text.truncated(F.col("x"), 4), x="😀😀") == "😀😀" and one(spark, text.truncated(F.col("x"), 3), x="😀😀") == "😀…"
    assert one(spark, text.token_estimate(F.col("x")), x="abcd") == 2 and one(spark, F.array_join(text.markers(F.col("x")), ","), x="[2] [10] [2] [x]") == "2,10"


def test_cursors(spark):
    made = text.cursor_encode(F.struct(F.col("x").alias("id")))
    coded = one(spark, made, x="a?>ü")
    assert "=" not in coded and "+" not in coded and "/" not in coded
    assert one(spark, text.cursor_decode(F.col("x"), "id string")["id"], x=coded) == "a?>ü"
    assert one(spark, text.cursor_decode(F.col("x"), "id string"), x="WzFd") is None  # a JSON array


def test_encryption_opens_with_its_own_key_version(spark):
    keys = {1: b"1" * 32, 2: b"2" * 32}
    df = spark.createDataFrame([("a",), ("",), (None,)], "x string")
    boxes = df.select(crypto.encrypt(F.col("x"), keys, 1).alias("old"), crypto.encrypt(F.col("x"), keys, 2).alias("new"))
    got = boxes.select(crypto.decrypt(F.col("old"), keys), crypto.decrypt(F.col("new"), keys)).collect()
    assert [tuple(r) for r in got] == [("a", "a"), ("", ""), (None, None)]
    with pytest.raises(Exception, match="malformed or unknown"):
        spark.createDataFrame([("3.a.b.c",)], "x string").select(crypto.decrypt(F.col("x"), keys)).collect()
    assert crypto.same_digest("ab", "ab") and not crypto.same_digest("ab", "ac")


def test_blind_index_sees_through_form(spark):
    df = spark.createDataFrame([(" Ézra ",), ("ézra",), (None,)], "x string")
    a, b, c = [r[0] for r in df.select(crypto.blind_index(b"k")("x")).collect()]
    assert a == b and len(a) == 43 and c is None


def test_answers_that_break_their_format(spark):
    ranks = lambda v: spark.createDataFrame([(v,)], "v array<string>").select(lenient.ranking(F.col("v"), F.lit(3))).first()[0]
    assert ranks(["2", "0.0", "2", "1.5", "3", "-1", "x", None]) == [2, 0] and ranks(None) == []
    assert [one(spark, lenient.count_of(F.col("x")), x=v) for v in ("2.5", "-1", "x", "nan")] == [3, 0, 0, 0]
    with pytest.raises(Exception, match="outside the contract"):
        one(spark, lenient.verdict(F.col("x"), ("yes", "no")), x="maybe")
    assert one(spark, reporting.percent(F.col("a"), F.col("b")), a=0, b=0) == "—"


def brute_word_similarity(q, c):
    w, line = set(trigram.ordered_trigrams(q)), trigram.ordered_trigrams(c)
    best = 0.0
    for i in range(len(line)):
        for j in range(i, len(line)):
            s = set(line[i : j + 1])
            best = max(best, len(s & w) / len(s | w))
    return best


def test_bounds_and_floors_of_word_similarity_lose_no_chunk(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    texts = ["", "?", "abc", *(say(rng.choice([3, 20, 90, 300])) for _ in range(60))]
    texts += [texts[-1], say(30) + " " + texts[9] + " " + say(30)]
    entries = [(line, trigram.previous(line)) for line in map(trigram.codes, texts)]
    lines, every = trigram.Lines(entries), np.ones(len(texts), bool)
    for q in ["", "abc", texts[9], texts[12], say(12), say(40)]:
        wanted = np.unique(trigram.codes(q))
        whole = lines.best(wanted, None, every, 9)
        hit = np.isin(lines.dictionary, wanted)[lines.gram]
        for j, (line, _) in enumerate(entries):
            for size, reach in ((1, 4), (3, 8), (16, 32), (5, 64)):
                assert lines._bound(j, hit, len(np.intersect1d(line, wanted)), max(1, len(wanted)), size, reach) >= whole[j] - 0.6e-9
        for k in (1, 3, 10):
            least = np.sort(whole)[-k]
            for floor in (-1.0, least):
                got = lines.best(wanted, k, every, 9, floor)
                assert (got[whole >= least] == whole[whole >= least]).all()
        measured = []
        with monkeypatch.context() as m:
            share = trigram.Lines._share
            m.setattr(trigram.Lines, "_share", lambda self, j, *a: measured.append(j) or share(self, j, *a))
            lines.best(wanted, 3, every, 9, max(0.01, np.sort(whole)[-3]))
        if len(q) > 30:
            assert len(measured) < len(texts) // 2
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    c = spark.createDataFrame([*rows, (None, 0, "abc"), (90, 0, None)], "chunk_id long, label int, c string").withColumn("weight", F.lit(1))
    q = spark.createDataFrame([*rows[::7], (90, 0, None), (91, 0, texts[9])], "question_id long, question_label int, q string").withColumn("weight", F.lit(1))
    best = lambda df, k: {tuple(r) for r in search.ranked(df, k, "place").select("question_id", "chunk_id", "value", "place").collect()}
    for k in (1, 4):
        assert best(search.word_pairs(q, c, k, pilot=12), k) == best(search.word_pairs(q, c, k), k)
    assert search.word_pairs(q, c, 4, pilot=12).count() <= search.word_pairs(q, c, 4).count()


def test_many_questions_bound_a_line_at_once_and_lose_no_chunk(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    texts = [None, "?", "abc", *(say(rng.choice([3, 20, 90, 300])) for _ in range(60))]
    texts += [texts[-1], say(30) + " " + texts[9] + " " + say(30)]
    ids, alone = np.arange(len(texts)), []
    lines = trigram.Lines([(line, trigram.previous(line)) for line in (trigram.codes(x or "") for x in texts)])
    whole = np.array([lines.best(np.unique(trigram.codes(x or "")), None, np.ones(len(texts), bool), 9) for x in texts])
    for name in ("_bound", "_share"):
        monkeypatch.setattr(trigram.Lines, name, lambda self, *a, of=getattr(trigram.Lines, name): alone.append(a[0]) or of(self, *a))
    np.fill_diagonal(whole, -1)
    for k in (1, 4):
        least = np.sort(whole, 1)[:, -k]
        for floors in (None, least):
            asked = pa.array(texts) if floors is None else pa.StructArray.from_arrays([pa.array(texts), pa.array(floors)], ["text", "floor"])
            alone.clear()
            value, worth = search.word_similarities({"ids": ids, "side": asked}, {"ids": ids, "side": pa.array(texts)}, k)
            must = (whole >= least[:, None]) & (whole >= 0)
            assert worth[must].all() and (-value[must] == whole[must]).all() and (-value[worth] == whole[worth]).all()
            assert floors is None or len(alone) < whole.size // 4
        reached, _ = search.word_floors({"ids": ids, "side": pa.array(texts)}, {"ids": ids, "side": pa.array(texts)}, k)
        assert (-reached <= np.maximum(whole, 0)).all()


def test_stretches_are_sought_only_where_they_may_begin(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    say = lambda few, n: " ".join(rng.choices(few, k=n))
    asked, text = say(words[:40], 60), " ".join([say(words, 900), say(words[:40], 60), say(words, 900)])
    wanted, line = np.unique(trigram.codes(asked)), trigram.codes(text)
    lines = trigram.Lines([(line, trigram.previous(line))])
    hit = np.isin(lines.dictionary, wanted)[lines.gram]
    common, n = len(np.intersect1d(line, wanted)), len(wanted)
    best = lines._share(0, hit, common, n, -1.0)
    tables, diagonal = [], np.diagonal
    monkeypatch.setattr(np, "diagonal", lambda x: tables.append(x.shape) or diagonal(x))
    assert lines._share(0, hit, common, n, -1.0) == best > 0.5
    whole = len(tables)
    tables.clear()
    assert lines._share(0, hit, common, n, best - 1e-9) == best and lines._share(0, hit, common, n, best + 0.01) <= best + 0.01
    assert len(tables) < whole // 2
    short = line[:150]
    lines, hit = trigram.Lines([(short, trigram.previous(short))]), np.isin(short, wanted)
    common = len(np.intersect1d(short, wanted))
    reached = [max((len(x & {*wanted}) / len(x | {*wanted}) for j in range(i, 150) for x in [{*short[i : j + 1]}]), default=0) for i in range(150)]
    for size, reach, floor in ((1, 4, -1.0), (4, 8, -1.0), (7, 32, -1.0), (2, 4, max(reached) / 2)):
        bounds = lines._bounds(0, hit, common, n, size, reach, floor)
        assert all(b <= bounds[i // size] + 1e-12 or bounds[i // size] < floor and b < floor for i, b in enumerate(reached))


def test_word_similarity_against_brute_force():
    pairs = [("knee pain", "pain of the knee and knee pain"), ("abc", "xyz"), ("", "x"), ("x", ""), ("word", "two words here"), ("aa ab ac", "zz aa qq ab ww ac aa ab"), ("the cat", "the the the dog cat")]
    for q, c in pairs:
        assert abs(trigram.word_similarity(q, c) - brute_word_similarity(q, c)) < 1e-12
    assert trigram.word_similarity("word", "two words here") > trigram.word_similarity("two words here", "word")


def test_configuration_numbers():
    assert [positive({"a": v}, "a", 7) for v in ("", " ", "x", "0", "-1", "nan", "inf", "2.5")] == [7, 7, 7, 7, 7, 7, 7, 2.5] and positive({}, "a", 7) == 7
    assert RetrievalConfig.of({"TOP_K": "8"}).top_k == 8 and RetrievalConfig.of({}).distance_cutoff == 0.48


# -- statistics, pages, gates ----------------------------------------------------


def test_two_percentiles_differ(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("h", None)], "g string, x double")
    near = {r.g: r.p for r in df.groupBy("g").agg(statistics.nearest_rank_percentile("x", 0.5).alias("p")).collect()}
    floor = {r.g: r.p for r in statistics.floor_percentile(df, ["g"], "x", {"p": 0.5}).collect()}
    assert near == {"g": 5.0, "h": 0.0} and floor == {"g": 6.0}


def test_page_sizes_and_last_page(spark):
    df = spark.range(5)
    last = paging.page(df, "id", size=3, after=1).collect()
    assert [r.id for r in last] == [2, 3, 4] and not last[0].has_next and last[0].next_cursor is None
    first = paging.page(df, "id", size=3).collect()
    assert first[0].has_next and first[0].next_cursor == 2
    with pytest.raises(ValueError):
        paging.page_size(51)


def test_gates(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "question_id int")
    found = spark.createDataFrame([(1, 0.48), (2, 0.49), (4, 0.1)], "question_id int, distance double")
    gate = search.distance_gate(q, found, 0.48)
    scored = search.score_gate(gate, spark.createDataFrame([(1, 9.0), (4, 8.9), (2, 1.0)], "question_id int, top_relevance double"), 9.0)
    assert {r.question_id: r.reason for r in scored.collect()} == {1: None, 2: "beyond_cutoff", 3: "no_candidates", 4: "low_relevance"}


def test_fusion_keeps_all_and_orders_ties(spark):
    v = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.2, 2)], "question_id int, chunk_id int, distance double, vector_rank int")
    k = spark.createDataFrame([(1, 12, 0.3, 1), (1, 13, 0.4, 2), (1, 11, 0.2, 3)], "question_id int, chunk_id int, distance double, keyword_rank int")
    rows = search.fused(v, k).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [11, 10, 12, 13] and rows[1].score == rows[2].score == 1 / 61


def test_bad_evaluation_items_fail_the_job(spark):
    schema = "id string, kind string, question string, status string, origin string"
    good = ("a", "answerable", "q", "approved", "manual")
    assert evaluation.approved(spark.createDataFrame([good, ("b", "abstain", "q", "rejected", "manual")], schema)).count() == 1
    with pytest.raises(Exception, match="item c: kind, question"):
        evaluation.approved(spark.createDataFrame([good, ("c", "other", " ", "approved", "manual")], schema)).collect()


# -- lifecycle and state ---------------------------------------------------------


def test_soft_deletion_keeps_the_first_time(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, deleted_at int")
    assert [r.deleted_at for r in lifecycle.soft_deleted(df, F.lit(True), F.lit(9)).orderBy("id").collect()] == [5, 9]


def test_optimistic_conflicts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, version int")
    new, conflicts = lifecycle.optimistic(old, spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 1)], "id int, v string, version int"), "id", "version", ["v"])
    assert sorted(map(tuple, new.collect())) == [(1, "x", 2), (2, "b", 2)] and sorted(r.id for r in conflicts.collect()) == [2, 3]


def test_state_machines():
    s = keyed.Suppressor()
    assert [s.step(t) for t in (0, 299, 300, 400, 601)] == [True, False, True, False, True]
    b = keyed.Breaker()
    assert [b.step(t, True) for t in range(5)][-1] == "open" and b.step(10, False) == "rejected"
    assert b.step(35, True) == "open" and b.step(66, False) == "closed" and b.step(67, True) == "closed"
    r = keyed.RateBlock()
    r.block(0)
    assert r.blocked(59) and not r.blocked(60)


def test_fold_orders_events_of_a_key(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(k, i, at(s)) for k in "ab" for i, s in [(3, 301), (1, 0), (2, 200)]], "k string, i int, ts timestamp_ntz")
    got = keyed.fold(df, ["k"], "ts", ["ts"], keyed.Suppressor, [], "shown", "boolean").collect()
    assert {(r.k, r.i): r.shown for r in got} == {(k, i): i != 2 for k in "ab" for i in (1, 2, 3)}


# -- sources and streams -----------------------------------------------------------


def test_catalogue_source(spark):
    class Fake(catalog.CatalogSource):
        fetch = staticmethod(lambda url, page: [{"id": f"{page}-1", "link": url, "modified": " ", "added": "2024-01"}, {"id": f"{page}-2", "modified": "2024-02", "added": "2023-01"}])

    spark.dataSource.register(Fake)
    rows = catalog.items(spark.read.format("catalog").option("url", "u").option("pages", "2").load())
    assert sorted((r.external_id, r.released) for r in rows.collect()) == [("0-1", "2024-01"), ("0-2", "2024-02"), ("1-1", "2024-01"), ("1-2", "2024-02")]
    assert catalog.filtered(rows, [], 5, "external_id").count() == 0 and catalog.filtered(rows, ["1-2", "0-2"], 1, "external_id").first().external_id == "0-2"


def test_frames_are_parsed(spark):
    body = ": hi\r\nevent: a\r\ndata: {\r\ndata:  1}\r\n\r\n:only a comment\n\nevent: b\ndata:x\n\n"
    got = spark.createDataFrame([(body,)], "b string").select(frames.parse(F.col("b"))).first()[0]
    assert [(f.event, f.data) for f in got] == [("a", "{\n 1}"), ("b", "x")]


def test_streamed_windows_and_guarded_sinks(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.windowed_counts(streams.file_stream(spark, f"{tmp_path}/in", events.schema), "ts", "event_type", "1 day", "1 hour")
    seen = []

    def broken(batch, number):
        raise OSError("sink is gone")

    writer = streams.fan_out({"bad": broken, "good": lambda batch, number: seen.extend(batch.collect())})
    streams.run_available(stream, writer, f"{tmp_path}/state", "update")
    last = {(r.start, r.event_type): r.n for r in seen}
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()
    assert sum(last.values()) <= events.count() and set(last) <= {(r.w.start, r.event_type) for r in want}


def test_progress_snapshot(spark):
    df = spark.createDataFrame([(1, 1, "run"), (1, 2, "done"), (2, 1, "run")], "job int, seq int, state string")
    got = {r.job: r.frames for r in streams.progress(df, "job", ["seq"], "state", "done").collect()}
    assert got == {1: ["snapshot", "job.completed"], 2: ["snapshot"]} and json.dumps(got)


def test_arms_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    texts = ["the knee hurts", "knee pain and more knee pain", "", None, *["".join(rng.choice(list("abcd  "), 30)) for _ in range(56)]]
    rows = [(i, [0.0] * 4 if i == 7 else [*map(float, rng.normal(size=4))], i % 3, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label int, content string").repartition(3)
    questions = chunks.selectExpr("chunk_id AS question_id", "vector AS question_vector", "label AS question_label", "content AS question")
    vec, grams = {r[0]: np.array(r[1]) for r in rows}, {r[0]: {*trigram.ordered_trigrams(r[3] or "")} for r in rows}

    def distance(a, b):
        n = np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])
        return round(1 - vec[a] @ vec[b] / n, 9) if n else None

    near = {a: sorted((b for b in vec if b != a), key=lambda b: (distance(a, b) is None, distance(a, b) or 0, b))[:4] for a in vec}
    over = lambda a, b: round(len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b])), 9)
    alike = {a: sorted((b for b in vec if b != a), key=lambda b: (-over(a, b), b))[:4] for a in vec}
    word = lambda a, b: round(brute_word_similarity(texts[a] or "", texts[b] or ""), 9)
    worded = {a: sorted((b for b in vec if b != a), key=lambda b: (-word(a, b), b))[:4] for a in range(0, 60, 20)}
    few = questions.where("question_id % 20 = 0")
    for n in (256, 7):  # one row of questions, which is sent, and a grid of several
        q, c = questions.selectExpr("question_id", "question_label", "question_vector AS q", "32 AS weight"), chunks.selectExpr("chunk_id", "label", "vector AS c", "32 AS weight")
        best = search.best_in_cells(q, c, search.distances(4), 4, n, 16).collect()
        assert {a: {b for b in near[a]} <= {r.chunk_id for r in best if r.question_id == a} for a in vec} == dict.fromkeys(vec, True)
    got = search.vector_arm(questions, chunks, 4).orderBy("question_id", "vector_rank").collect()
    assert [(r.question_id, r.chunk_id, r.distance, r.label, r.question_label) for r in got] == [(a, b, distance(a, b), b % 3, a % 3) for a in vec for b in near[a]]
    for asked, measure, of, want in ((questions, "jaccard", over, alike), (few, "word", word, worded)):
        got = search.keyword_arm(asked, chunks, 4, measure).orderBy("question_id", "keyword_rank").collect()
        assert [(r.question_id, r.chunk_id, r.similarity, r.distance) for r in got] == [(a, b, of(a, b), distance(a, b)) for a in want for b in want[a]]
    kept = search.trigram_index(chunks.select("chunk_id", "label", "vector", "content"), "content")
    got = search.keyword_arm(few, kept, 4, "word").orderBy("question_id", "keyword_rank").collect()
    assert [(r.question_id, r.chunk_id, r.similarity) for r in got] == [(a, b, word(a, b)) for a in worded for b in worded[a]]
    assert search.keyword_pairs(few, chunks, None).count() == 3 * 59 and search.vector_arm(questions.limit(0), chunks, 4).count() == 0


def test_rows_without_ids_and_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [1.0, None]), (6, []), (None, [1.0, 1.0]), (7, [3.0, 0.0])]
    chunks = spark.createDataFrame([(i, v, 0, f"t {i}") for i, v in odd], "chunk_id long, vector array<double>, label int, content string")
    questions = chunks.selectExpr("chunk_id AS question_id", "vector AS question_vector", "label AS question_label", "content AS question")
    got = {(r.question_id, r.chunk_id): r.distance for r in search.vector_arm(questions, chunks, 9).collect()}
    ids = [i for i, _ in odd if i is not None]
    assert got.keys() == {(a, b) for a in ids for b in ids if a != b}
    assert {p: d for p, d in got.items() if d is not None} == {p: d for a, b, d in ((1, 2, 1.0), (1, 7, 0.0), (2, 7, 1.0)) for p in ((a, b), (b, a))}
    nothing = chunks.withColumn("vector", F.lit(None).cast("array<double>"))
    assert search.vector_arm(questions, nothing, 2).where("distance IS NOT NULL").count() == 0
    assert {r.question_id for r in search.keyword_arm(questions, chunks, 9, "word").collect()} == {*ids}
    assert search.vector_arm(questions, chunks.limit(0), 2).count() == 0


def test_no_crossing_of_the_grid_holds_more_than_its_share(spark):
    questions, chunks = spark.range(300).withColumnRenamed("id", "question_id"), spark.range(5000).withColumnRenamed("id", "chunk_id")
    q, c = search.grid(questions, chunks, rows=3, cells=10)
    for side, copies, share in ((q, 10, 100), (c, 3, 500)):
        n = [r["count"] for r in side.groupBy("row", "cell").count().collect()]
        assert len(n) == 30 and sum(n) == copies * share * 30 // copies and max(n) < 1.5 * share
    numbered = lambda df, name: df.select(name, F.lit(0).alias(f"{name[:-2]}label"), F.array(F.lit(1.0)).alias("q" if name[0] == "q" else "c"), F.lit(8).alias("weight"))
    asked = numbered(questions, "question_id").withColumnRenamed("question_label", "question_label")
    held = numbered(chunks, "chunk_id").withColumnRenamed("chunk_label", "label")
    plan = lambda df: df._jdf.queryExecution().toString()
    grid = plan(search.best_in_cells(asked, held, search.distances(1), 5, 100, 500))
    assert "FlatMapCoGroupsInArrow" in grid and "BroadcastExchange" not in grid
    sent = plan(search.best_in_cells(asked, held, search.distances(1), 5, 1000, 500))
    assert "FlatMapCoGroupsInArrow" not in sent and "Join" in sent


def test_many_copies_are_read_rather_than_shuffled(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(i, i % 3, [*map(float, rng.integers(-3, 4, 3))]) for i in range(700)]
    held = spark.createDataFrame(rows, "chunk_id long, label int, c array<double>").withColumn("weight", F.lit(24))
    asked = held.where("chunk_id % 7 = 0").selectExpr("chunk_id AS question_id", "label AS question_label", "c AS q", "weight")
    monkeypatch.setattr(search, "PAIRS", 300)  # less than a row of a crossing
    of = lambda copied: search.best_in_cells(asked, held, search.distances(3), 5, 30, 100, copied=copied)
    crossed, grid = of(1000), of(None)
    plan = crossed._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "CoGroups" in grid._jdf.queryExecution().toString()
    best = lambda df: {(r.question_id, r.rank): (r.chunk_id, r.value) for r in search.ranked(df, 5, "rank").collect()}
    assert best(crossed) == best(grid) and len(best(grid)) == 500
    every = lambda copied: search.best_in_cells(asked, held, search.distances(3), None, 30, 100, copied=copied)
    assert every(1000).count() == every(None).count() == 100 * 699


def test_pairs_are_counted_by_products_and_only_the_best_are_valued(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [rng.choice(90, rng.integers(0, 60), False, np.arange(90, 0, -1) / 4095) for _ in range(120)]
    sets[5], sets[7] = sets[6], sets[6][:0]
    ids, side = np.arange(120), pa.array([[*map(int, x)] for x in sets], pa.list_(pa.int64()))
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([*map(len, sets)])
    want = -search._rounded(common / np.maximum(size[:, None] + size - common, 1)) + 0.0
    other = ids[:, None] != ids
    for dense in (0, 0.05, 1):  # all by products, some, none
        monkeypatch.setattr(search, "DENSE", dense)
        monkeypatch.setattr(search, "SLAB", 7)
        monkeypatch.setattr(search, "LISTED", 50)
        held = {"ids": ids, "side": side}
        for k in (None, 3):
            value, worth = search.overlaps({"ids": ids[::2], "side": side.take(pa.array(ids[::2]))}, held, k)
            assert (value[worth] == want[::2][worth]).all()
            for i in range(60):
                best = sorted(np.flatnonzero(other[2 * i]), key=lambda j: (want[2 * i, j], j))[: k or 119]
                assert worth[i, best].all()
            assert worth.all() if k is None else worth.sum() < 60 * 60
    vectors = [None, [0.0, 0.0], [1.0], *([*map(float, rng.integers(-9, 9, 2))] for _ in range(117))]
    value, worth = search.distances(2)({"ids": ids, "side": pa.array(vectors)}, {"ids": ids, "side": pa.array(vectors)}, 4)
    full, _ = search.distances(2)({"ids": ids, "side": pa.array(vectors)}, {"ids": ids, "side": pa.array(vectors)}, None)
    assert worth[:3].all() and np.isnan(value[:3]).all() and (value[3:][worth[3:]] == full[3:][worth[3:]]).all()
    for i in range(3, 120):
        assert worth[i, sorted(np.flatnonzero(other[i] & ~np.isnan(full[i])), key=lambda j: (full[i, j], j))[:4]].all()


def test_all_pairs_come_in_one_order_of_chunks(spark):
    held = spark.createDataFrame([(i, 0, [float(i * 7 % 11), 1.0]) for i in range(40)], "chunk_id long, label int, c array<double>").withColumn("weight", F.lit(16)).coalesce(1)
    asked = held.where("chunk_id < 3").selectExpr("chunk_id AS question_id", "label AS question_label", "c AS q", "weight")
    got = search.best_in_cells(asked, held, search.distances(2), None).collect()
    of = lambda q: [r.chunk_id for r in got if r.question_id == q and r.chunk_id > 2]
    assert len(got) == 3 * 39 and of(0) == of(1) == of(2) and len(of(0)) == 37


def test_chunks_are_counted_without_their_texts(spark, data, monkeypatch):
    from evidentia.engine.views import Tables

    chunks, seen = Tables(spark, data).chunks(), []
    assert chunks.where("chars IS DISTINCT FROM length(content)").count() == 0
    monkeypatch.setattr(search, "best_in_cells", lambda q, c, *a, **k: seen.append(c.agg(F.sum("weight"))))
    search.keyword_pairs(Tables(spark, data).questions(), chunks, 3)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "length(text" in below and "text" not in plan[: plan.index("Join")]


def test_blocks_are_bounded_by_their_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search, "CELL_BYTES", 80)
    lists = pa.array([[1] * n for n in (4, 4, 4, 30, 0, 0, 0, 0, 10, 1)] + [None])
    assert search._cuts(lists, 3) == [0, 2, 3, 4, 7, 9, 11] and search._cuts(lists[:0], 3) == [0]


def test_reads_and_blocks_and_breakers_as_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # or batches without data go on, to end idle keys
    body = "event: a\ndata: one\n\n: note\r\n\r\ndata: two\ndata: lines\r\n\r\ndata: half"
    machine = keyed.Reads()
    for n in (1, 3, 1000):
        machine = keyed.Reads()
        out = [f for i in range(0, len(body), n) for f in machine.step(0.0, body[i : i + n])]
        assert out == ["event: a\ndata: one", ": note", "data: two\ndata: lines"] and machine.held == "data: half"
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(seconds=10 * i), i < 6 or i == 9, None if i % 2 else 5.0) for i in range(14)]
    schema = "key string, at timestamp, failed boolean, retry double"
    for half in (rows[:5], rows[5:]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, make, inputs, kind in (("breaker", keyed.Breaker, ["failed"], "string"), ("block", keyed.RateBlock, ["failed", "retry"], "boolean"), ("number", keyed.Numbering, [], "long")):
        q = keyed.fold_stream(events, ["key"], "at", make, inputs, "out", kind, 3600).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()
        whole = keyed.fold(spark.createDataFrame(rows, schema), ["key"], "at", ["at"], make, inputs, "out", kind)
        assert sorted((r.at, r.out) for r in spark.table(name).collect()) == sorted((r.at, r.out) for r in whole.collect()), name


def streamed(spark, tmp_path, name, batches, schema, make):
    """Runs a stream over files, a micro-batch each, and starts it anew after each from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    rows = []
    try:
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            events = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/in")
            q = make(events).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
            try:
                assert q.awaitTermination(120)
            finally:
                q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return rows


def test_events_in_order_of_their_time_however_they_come(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("k", at(10 * i), i, i < 6 or i == 9) for i in range(14)] + [("j", at(7 * i), i, i % 3 > 0) for i in range(20)]
    schema = "key string, at timestamp, i int, failed boolean"
    mixed = [rows[k::3][::-1] for k in range(3)]  # each file holds events of all times, in reverse
    done = [("z", at(100_000), 0, False)]
    got = streamed(spark, tmp_path, "order", [mixed[0], mixed[1] + mixed[2], done, [("z", at(300_000), 1, False)]], schema,
                   lambda e: timed.fold_in_order(e, ["key"], "at", "i", keyed.Breaker, ["failed"], "state", "string", "1 hour", 7200))
    want = keyed.fold(spark.createDataFrame(rows + done, schema), ["key"], "at", ["at", "i"], keyed.Breaker, ["failed"], "state", "string").collect()
    assert sorted((r.key, r.i, r.state) for r in got) == sorted((r.key, r.i, r.state) for r in want)


def test_state_ends_by_event_time(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [[("k", t0 + dt.timedelta(seconds=s), i)] for i, s in enumerate((0, 60, 4000, 4100, 90_000))]
    got = streamed(spark, tmp_path, "ttl", rows, "key string, at timestamp, i int",
                   lambda e: timed.fold_in_order(e, ["key"], "at", "i", keyed.Numbering, [], "n", "long", "1 second", 600))
    assert sorted((r.i, r.n) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 1)]  # 4000 s is more than 600 after 60 s; the last event still waits


def test_beats_of_silent_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda k, s, e: (k, t0 + dt.timedelta(seconds=s), e)
    batches = [[row("a", 0, "x"), row("b", 1, "x"), row("b", 2, "done")], [row("c", 31, "x")], [row("a", 36, "y"), row("b", 37, "late")], [row("c", 60, "x")]]
    got = streamed(spark, tmp_path, "beats", batches, "key string, at timestamp, kind string", lambda e: timed.beating(e, "key", "at", "kind", ("done",), "0 seconds"))
    start = t0.replace(tzinfo=dt.UTC).timestamp()
    of = lambda k: sorted((round(r.at - start), json.loads(r.frame[6:])["seq"] if r.frame.startswith("data: ") else "beat") for r in got if r.key == k)
    assert of("a") == [(0, 0), (15, "beat"), (30, "beat"), (36, 1), (51, "beat")]
    assert of("b") == [(1, 0), (2, 1)] and of("c") == [(31, 0), (46, "beat"), (60, 1)]


def test_the_order_of_an_answers_events(spark, tmp_path):
    def wrong(*kinds):
        machine, n = keyed.Grammar(), 0
        out = []
        for k in kinds:
            kind, seq = (k, None) if isinstance(k, str) or k is None else k
            out.append(machine.step(0.0, kind, seq))
            n += 1
        return out

    begin = ["message.accepted", "retrieval.started", "retrieval.completed"]
    delta = lambda n: ("answer.delta", n)
    assert wrong(*begin, delta(0), delta(1), "answer.completed") == [None] * 6
    assert wrong(*begin, "answer.abstained") == [None] * 4 and wrong("message.accepted", "error", "error") == [None, None, "after_end"]
    assert wrong(*begin, delta(0), delta(2), delta(1), "answer.completed", "answer.completed") == [None] * 4 + ["seq_gap", None, None, "after_end"]
    assert wrong("retrieval.started", "message.accepted", delta(0)) == ["retrieval.started_after_start", None, "answer.delta_after_message.accepted"]
    assert wrong("ping", None, "message.accepted") == ["unknown_kind", "unknown_kind", None]
    assert wrong(*begin, delta(0), "answer.abstained")[-1] == "answer.abstained_after_answer.delta"
    t0 = dt.datetime(2024, 1, 1)
    kinds = [*begin, "answer.delta", "answer.delta", "answer.completed", "answer.delta"]
    rows = [(c, t0 + dt.timedelta(seconds=i), i, k if c or i != 1 else "answer.delta", i - 3 if i in (3, 4) else None) for c in (0, 1) for i, k in enumerate(kinds)]
    schema = "conv int, at timestamp, i int, kind string, seq int"
    batch = keyed.fold(spark.createDataFrame(rows, schema), ["conv"], "at", ["at", "i"], keyed.Grammar, ["kind", "seq"], "wrong", "string").collect()
    got = streamed(spark, tmp_path, "grammar", [rows[::2], rows[1::2], [(9, t0 + dt.timedelta(days=1), 0, "x", None)]], schema,
                   lambda e: timed.fold_in_order(e, ["conv"], "at", "i", keyed.Grammar, ["kind", "seq"], "wrong", "string", "1 hour", 7200))
    assert sorted(((r.conv, r.i, r.wrong) for r in got), key=repr) == sorted(((r.conv, r.i, r.wrong) for r in batch), key=repr)


def test_whole_numbers_beside_nulls_stay_whole_in_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    big = (1 << 53) + 1  # no float
    rows = [(1, t0 + dt.timedelta(seconds=i), i, "answer.delta", seq) for i, seq in enumerate([big, None, -big])]
    got = streamed(spark, tmp_path, "whole", [rows, [(9, t0 + dt.timedelta(days=1), 0, "x", None)]], "conv int, at timestamp, i int, kind string, seq long",
                   lambda e: timed.fold_in_order(e, ["conv"], "at", "i", keyed.Grammar, ["kind", "seq"], "wrong", "string", "1 hour", 7200))
    assert sorted((r.i, r.seq) for r in got if r.conv == 1) == [(0, big), (1, None), (2, -big)]


def test_timeouts_fall_back_and_sinks_end_once(spark):
    import time

    assert ports.within(lambda: 1, 5, lambda: 2) == 1
    assert ports.within(lambda: time.sleep(3) or 1, 0.05, lambda: 2) == 2
    sample = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "chunk_id long, content string")

    def ask(t):
        if t == "bad":
            raise ValueError(t)
        return f"what is {t}?"

    assert [(r.question, r.status) for r in ports.asked(sample, "content", ask).orderBy("chunk_id").collect()] == [("what is a?", "candidate"), (None, "candidate"), ("what is ?", "candidate")]
    out, now, closed = [], [0.0], []
    sink = sinks.FrameSink(out.append, clock=lambda: now[0])
    sink.send({"n": 1})
    for at in (10.0, 15.0, 29.0, 30.0):
        now[0] = at
        sink.tick()
    for _ in range(2):
        sink.end(lambda: closed.append(1))
    sink.send({"n": 2})
    assert out == ['data: {"n": 1}\n\n', ": heartbeat\n\n", ": heartbeat\n\n"] and closed == [1]
