"""Guideline documents to graded chunks, with a diagnosis of what could not be read.

A document is small and its grammar is stateful, so each is read whole by one
call; Spark deals the documents out.  Reading goes in passes over the lines:

1. pages to lines, with the section path in force at each;
2. markers, and which of them open a block;
3. blocks to labelled stretches (statement, consideration, explanation);
4. stretches to paragraphs, and paragraphs to chunks of bounded length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, groupby, islice, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from ..functions.ratings import GRADES, LEVELS, ROMAN
from . import grammar as G


@dataclass(frozen=True)
class Line:
    text: str
    page: int
    path: tuple[str, ...] = ()


@dataclass
class Chunk:
    path: tuple[str, ...]
    number: str
    content: str
    grade: str | None
    level: str | None
    page_start: int
    page_end: int


@dataclass
class Reading:
    chunks: list[Chunk] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    duplicated: list[str] = field(default_factory=list)
    ungraded: list[str] = field(default_factory=list)
    unknown_levels: list[tuple[str, str]] = field(default_factory=list)
    not_derived: list[str] = field(default_factory=list)

    @property
    def sections(self) -> list[tuple[tuple[str, ...], list[Chunk]]]:
        """Neighbouring chunks of one path together."""
        return [(path, list(own)) for path, own in groupby(self.chunks, key=lambda c: c.path)]


# -- pass 1: lines ---------------------------------------------------------------


@dataclass
class Head:
    page: int
    chapter: tuple[str, str] | None = None
    first: str | None = None
    second: str | None = None
    length: int = 1


def read_head(lines: list[str]) -> Head | None:
    """The running head of a page; None for a page without a printed number."""
    printed = G.PRINTED_PAGE.match(lines[0]) if lines else None
    if printed is None:
        return None
    head, symbols = Head(int(printed[1])), ["first", "second"]
    for line in lines[1 : 1 + G.HEADER_LINES]:
        if len(line) > G.HEADER_CHARS:
            break
        if m := G.CHAPTER.match(line):
            head.chapter = (ROMAN.get(m[1], m[1]), m[2])
        elif m := G.SECOND_LEVEL.match(line):
            head.second, symbols = f"{m[1]} {m[2]}", []
        elif m := G.FIRST_LEVEL.match(line):
            head.first, symbols = f"{m[1]}. {m[2]}", ["second"]
        elif symbols and (m := G.SYMBOL_LEVEL.match(line)):
            setattr(head, symbols.pop(0), f"{m[1]} {m[2]}")
        else:
            break
        head.length += 1
    return head


def read_lines(pages: Iterable[str]) -> list[Line]:
    """Lines of the recommendation chapter; of all chapters where no head names one."""
    split = [[x.strip() for x in p.split("\n")] for p in pages]
    read = [(read_head(ls), ls) for ls in split]
    wanted = next((h.chapter[0] for h, _ in read if h and h.chapter and G.CHAPTER_WORD in h.chapter[1]), None)
    out: list[Line] = []
    chapter: tuple[str, str] | None = None
    first = second = None
    for head, lines in read:
        if head is None:
            continue
        if head.chapter:
            if chapter is None or chapter[0] != head.chapter[0]:
                first = second = None
            chapter = head.chapter
        if head.first is not None and head.first != first:
            first, second = head.first, None
        second = head.second if head.second is not None else second
        if wanted is None:
            path = (first, second)
        elif chapter and chapter[0] == wanted:
            path = (f"{chapter[0]}. {chapter[1]}", first, second)
        else:
            continue
        kept = tuple(p for p in path if p)
        out += [Line(x, head.page, kept) for x in lines[head.length :] if x]
    return out


# -- pass 2: markers -------------------------------------------------------------


def marker_of(pages: Iterable[str]) -> re.Pattern:
    """Bracketed markers if the document has any, bare ones otherwise."""
    return G.BRACKETED if any(G.MENTIONED.search(p) for p in pages) else G.BARE


def has_marker(pages: list[str]) -> bool:
    """Whether the document uses recommendation markers at all, anywhere on its pages."""
    if any(G.MENTIONED.search(p) for p in pages):
        return True
    for page in pages:
        lines = [x.strip() for x in page.split("\n")]
        for i, line in enumerate(lines):
            if G.BARE.match(line) and any(_is_evidence(x) for x in lines[max(0, i - 1) : i + 1 + G.EVIDENCE_LINES]):
                return True
    return False


def _is_evidence(text: str) -> bool:
    return bool(G.TABLE_HEAD.match(text) or G.GRADE_TOKEN.search(text))


def _solid(text: str) -> str:
    return "".join(text.split())


def by_consensus(block: list[Line], marker: re.Pattern) -> bool:
    """Whether the first sentence after the marker says that experts agreed."""
    said = ""
    for i, line in enumerate(block):
        m = marker.match(line.text)
        if i and m:
            return False
        said += (m[2] or "") if not i and m else line.text
        if G.CONSENSUS in _solid(said):
            return True
        if i and G.SENTENCE_END.search(line.text):
            return False
    return False


def opens_block(lines: list[Line], at: int, marker: re.Pattern) -> bool:
    """A table head or a grade soon after the marker, and before the next one, makes it a block."""
    near = lines[at : at + 1 + G.EVIDENCE_LINES]
    stop = next((i for i, x in enumerate(near) if i and marker.match(x.text)), len(near))
    own = near[0 if marker is G.BARE else 1 : stop]
    return any(_is_evidence(x.text) for x in own) or by_consensus(near, marker)


# -- pass 3: stretches -----------------------------------------------------------


def _kind(text: str) -> str | None:
    if G.CONSIDERATION.match(text):
        return "consideration"
    if G.REFERENCES.match(text):
        return "references"
    return "explanation" if G.SUBSECTION.match(text) else None


def stretches(body: list[Line]) -> dict[str, list[Line]]:
    """Lines by kind, in order, up to the references; what comes before any heading is the statement."""
    out: dict[str, list[Line]] = {"statement": [], "consideration": [], "explanation": []}
    now = "statement"
    for line in body:
        now = _kind(line.text) or now
        if now == "references":
            break
        out[now].append(line)
    return out


# -- pass 4: paragraphs and chunks -----------------------------------------------


#: What becomes of a line break, by its surroundings; the first rule that fits decides.
BREAKS = (
    (re.compile(r"-\n(?=[A-Za-z])"), ""),  # a hyphenated word
    (re.compile(r"(?<=[A-Za-z0-9])\n(?=[A-Za-z0-9])"), " "),  # two Latin words
    (re.compile(rf"(?<=(?s:.)[{''.join(sorted(G.PARTICLES))}])\n(?=[가-힣])"), " "),  # a Korean word that has ended
    (re.compile(r"\n"), ""),
)


def unwrapped(text: str) -> str:
    """Text without the line breaks that its layout made."""
    for pattern, put in BREAKS:
        text = pattern.sub(put, text)
    return text


def paragraphs(lines: list[Line], marker: re.Pattern) -> Iterator[Chunk]:
    """Text with its pages; headings stand alone, other lines run on to the end of a sentence.

    Lines get numbers that rise wherever a paragraph begins, and those of one number
    are put together.
    """
    full = [x for x in lines if x.text]
    alone = [bool(_kind(x.text) or marker.match(x.text) or G.TABLE_HEAD.match(x.text)) for x in full]
    ends = [a or bool(G.SENTENCE_END.search(x.text)) for a, x in zip(alone, full)]
    numbers = accumulate((a or e for a, e in zip(alone, [False, *ends])), int.__add__)
    for _, own in groupby(zip(numbers, full), key=itemgetter(0)):
        part = [x for _, x in own]
        yield Chunk((), "", unwrapped("\n".join(x.text for x in part)), None, None, part[0].page, part[-1].page)


def cut_points(text: str, limit: int) -> list[int]:
    """Where to cut a text into parts of at most ``limit``: after the last sentence that fits, else at the limit."""
    cuts, at = [], 0
    while len(text) - at > limit:
        stop = max(text.rfind(s, at + 1, at + limit) for s in G.STOPS)
        at = stop + 1 if stop > at else at + limit
        cuts.append(at)
    return cuts


def bounded(parts: Iterable[Chunk], limit: int) -> Iterator[Chunk]:
    """Paragraphs put together, a line feed between them, up to the limit; longer ones are cut first."""
    pieces = []
    for p in parts:
        cuts = [0, *cut_points(p.content, limit), len(p.content)]
        pieces += [replace(p, content=p.content[a:b]) for a, b in pairwise(cuts)]

    def place(last: tuple[int, int], piece: Chunk) -> tuple[int, int]:
        """Number of the chunk that takes the piece, and the chunk's length with it and a line feed."""
        number, size = last
        length = len(piece.content)
        return (number, size + length + 1) if size + length <= limit or not size else (number + 1, length + 1)

    places = islice(accumulate(pieces, place, initial=(0, 0)), 1, None)
    for _, own in groupby(zip(places, pieces), key=lambda x: x[0][0]):
        held = [piece for _, piece in own]
        yield Chunk((), "", "\n".join(x.content for x in held), None, None, held[0].page_start, held[-1].page_end)


@dataclass(frozen=True)
class Rating:
    """What a line says of grade and evidence level; ``unknown`` is a level as written whose word is none of the known."""

    grade: str | None = None
    level: str | None = None
    unknown: str | None = None


def rating_of(text: str) -> Rating | None:
    """The rating at the end of a line, if it has one; the parts of a pair say themselves which they are."""
    if tail := G.GRADE_TAIL.search(text):
        parts = [" ".join(x.split()).removesuffix(".") for x in tail[1].split("/")]
        grades = [GRADES[x.lower()] for x in parts if x.lower() in GRADES]
        levels = [LEVELS.get(x.lower(), x) for x in parts if x.lower() not in GRADES]
        return Rating(grades[-1] if grades else None, levels[-1] if levels else None)
    if odd := G.UNKNOWN_LEVEL.search(text):
        return Rating(GRADES.get(odd[1].lower(), odd[1].upper()), None, " ".join(odd[2].split()))
    return None


def _ungraded(line: Line) -> Line:
    return Line(G.UNKNOWN_LEVEL.sub("", G.GRADE_TAIL.sub("", line.text)), line.page, line.path)


def block_chunks(block: list[Line], marker: re.Pattern) -> tuple[list[Chunk], str | None]:
    """The chunks of a block; only the first carries the grade, which is the statement's."""
    m = marker.match(block[0].text)
    number, rest = m[1], (m[2] or "").strip()
    body = stretches(block[2 if len(block) > 1 and G.TABLE_HEAD.match(block[1].text) else 1 :])
    agreed = by_consensus(block, marker)
    lead = [Line(rest, block[0].page)] if rest and (agreed or marker is G.BARE) else []
    statement = lead + body["statement"]
    rating = next(filter(None, (rating_of(x.text) for x in statement)), Rating())
    if rating.grade is None and agreed:
        rating = replace(rating, grade="GPP")
    said = [*paragraphs([_ungraded(x) for x in statement], marker), *paragraphs(body["consideration"], marker)]
    chunks = [*bounded(said, G.BLOCK_LIMIT)]
    if chunks:
        chunks[0].grade, chunks[0].level = rating.grade, rating.level
    chunks += bounded(paragraphs(body["explanation"], marker), G.EXPLANATION_LIMIT)
    for c in chunks:
        c.number, c.path = number, block[0].path
    return chunks, rating.unknown


def read_document(pages: list[str]) -> Reading:
    """All passes; what can't be read is diagnosed, never raised."""
    marker = marker_of(pages)
    lines = read_lines(pages)
    at = {i: m[1] for i, x in enumerate(lines) if (m := marker.match(x.text))}
    starts = [i for i in at if opens_block(lines, i, marker)]
    out = Reading()
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        chunks, unknown = block_chunks(lines[a:b], marker)
        out.chunks += chunks
        if unknown is not None:
            out.unknown_levels.append((at[a], unknown))
    order, opened = [*at], set(starts)
    spans = zip(order, [*order[1:], len(lines)])
    dropped = {at[a]: None for a, b in spans if a not in opened and G.NOT_DERIVED in _solid("".join(x.text for x in lines[a:b]))}
    out.not_derived = [*dropped]
    counted: dict[str, None] = {}
    explaining = False
    for i, line in enumerate(lines):
        if i in opened or G.REFERENCES_PART.match(line.text):
            explaining = False
        elif G.EXPLANATION_PART.match(line.text):
            explaining = True
        if i in at and at[i] not in dropped and (i in opened or not explaining):
            counted[at[i]] = None
    out.numbers = [*counted]
    produced = {at[i]: None for i in starts}
    said: dict[str, list[bool]] = {}  # of each number, which of its chunks carry a grade
    for c in out.chunks:
        said.setdefault(c.number, []).append(bool(c.grade))
    out.missing = [n for n in out.numbers if n not in produced]
    # a number's first chunk is a statement even where no grade could be read; later ones are statements if graded
    out.duplicated = [n for n, graded in said.items() if (not graded[0]) + sum(graded) > 1]
    out.ungraded = [n for n in produced if not any(said.get(n, ()))]
    return out


_CHUNK = "section_no: int, path: array<string>, number: string, grade: string, level: string, content: string, page_start: int, page_end: int"
READINGS = (
    "doc_id long, has_marker boolean, n_chunks int, numbers array<string>, missing array<string>, duplicated array<string>, ungraded array<string>, "
    f"unknown_levels array<string>, not_derived array<string>, chunks array<struct<{_CHUNK}>>"
)


def read_documents(pages: DataFrame) -> DataFrame:
    """One row a document, given as rows (doc_id, page_no, text): its chunks, its numbers, and what is wrong with them.

    Spark brings the pages of a document together and in order; each is read once,
    however many fit in a batch.
    """

    def read(doc: int, texts: list[str]) -> dict:
        r = read_document(texts)
        chunks = [
            {"section_no": i, "path": list(c.path), "number": c.number, "grade": c.grade, "level": c.level, "content": c.content, "page_start": c.page_start, "page_end": c.page_end}
            for i, (_, own) in enumerate(r.sections) for c in own
        ]
        levels = [f"{n}: {raw}" for n, raw in r.unknown_levels]
        return {
            "doc_id": doc, "has_marker": has_marker(texts), "n_chunks": len(chunks), "numbers": r.numbers, "missing": r.missing, "duplicated": r.duplicated,
            "ungraded": r.ungraded, "unknown_levels": levels, "not_derived": r.not_derived, "chunks": chunks,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        done = (read(doc, [t or "" for _, t in own]) for doc, own in groupby(rows, key=itemgetter(0)))
        while some := list(islice(done, 64)):
            yield pa.RecordBatch.from_pylist(some, schema)

    numbered = pages.repartition("doc_id").sortWithinPartitions("doc_id", "page_no").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = to_arrow_schema(DataType.fromDDL(READINGS))
    return numbered.mapInArrow(run, READINGS)


def chunk_documents(pages: DataFrame) -> DataFrame:
    """Chunks of documents given as rows (doc_id, page_no, text)."""
    return read_documents(pages).select("doc_id", F.posexplode("chunks").alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.*")


def diagnose_documents(pages: DataFrame) -> DataFrame:
    """One row a document: its numbers and what is wrong with them."""
    return read_documents(pages).drop("chunks")


def verified_templates(readings: DataFrame, expected: DataFrame, listed: DataFrame) -> DataFrame:
    """Readings of documents against frozen expectations: doc_id, got_status, outcome and the ``reasons`` of a mismatch.

    ``readings`` are rows of ``read_documents``, defects that are waived taken out
    before (``waived``).  ``expected`` has doc_id, status, unique_numbers, recommendations
    and the sets unparsed, not_derived and unknown_levels (null: empty), ``listed`` the
    doc_id of documents that are no targets.  That a document is no target is what
    the expectation says, never that nothing was read: a reader that finds nothing
    must not pass.  A document that is read better than expected is a mismatch too,
    as is one that nothing was expected of, or that is not there any more.
    """
    graded = F.size(F.filter("chunks", lambda c: c["grade"].isNotNull()))
    unparsed = F.array_distinct(F.flatten(F.array("missing", "duplicated", "ungraded")))
    got = readings.select(
        "doc_id", F.size("numbers").alias("got_numbers"), graded.alias("got_recommendations"), unparsed.alias("got_unparsed"), F.col("not_derived").alias("got_not_derived"),
        F.col("unknown_levels").alias("got_unknown_levels"), F.when(F.size(unparsed) == 0, "OK").otherwise("PARTIAL").alias("got_status"),
    )
    both = got.join(expected.withColumn("expected", F.lit(True)), "doc_id", "full").join(listed.select("doc_id").distinct().withColumn("listed", F.lit(True)), "doc_id", "left")
    listed_, no_target = F.col("listed").isNotNull(), F.coalesce(F.col("status") == "NOT_TARGET", F.lit(False))

    def other(name: str) -> Column:
        sets = [F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))) for c in (f"got_{name}", name)]
        return sets[0] != sets[1]

    kinds = {
        "numbers": F.col("got_numbers") != F.col("unique_numbers"),
        "recommendations": F.col("got_recommendations") != F.col("recommendations"),
        "read_no_target": no_target & ((F.col("got_numbers") > 0) | (F.col("got_recommendations") > 0)),
        "status": ~no_target & (F.col("got_status") != F.col("status")),
        "unparsed": ~no_target & other("unparsed"),
        "unknown_levels": ~no_target & other("unknown_levels"),
        "not_derived": other("not_derived"),
        "not_listed": no_target & ~listed_,
        "listed": ~no_target & listed_,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(kind)) for kind, c in kinds.items()]))
    one_sided = F.when(F.col("expected").isNull(), "unexpected").when(F.col("got_status").isNull(), "missing")
    reasons = F.when(one_sided.isNull(), reasons).otherwise(F.array().cast("array<string>"))
    outcome = F.coalesce(one_sided, F.when(F.size(reasons) > 0, "mismatch").otherwise("same"))
    return both.select("doc_id", "got_status", outcome.alias("outcome"), reasons.alias("reasons"))


def guarded(diagnoses: DataFrame) -> DataFrame:
    """Adds ``failure``: why a document must not be taken in, null if it may."""
    bad = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(c)) for c in ("missing", "duplicated", "ungraded")]))
    return diagnoses.withColumn("failure", F.when(F.size("numbers") == 0, "no numbers").when(F.size(bad) > 0, F.array_join(bad, ",")))


def waived(diagnoses: DataFrame, waivers: DataFrame) -> DataFrame:
    """Takes known defects of the source out of the diagnosis; ``unused`` holds waivers that match nothing any more."""
    got = diagnoses.join(waivers, "doc_id", "left")  # however many there are: the planner knows their size
    known = F.coalesce("waived", F.array().cast("array<string>"))
    rest = {c: F.array_except(c, known) for c in ("missing", "duplicated", "ungraded")}
    found = F.flatten(F.array("missing", "duplicated", "ungraded"))
    return got.withColumn("unused", F.array_except(known, found)).withColumns(rest).drop("waived")


def decision(marker, parses, listed, expired):
    """Take in, skip or fail a document, by whether it has markers, parses, and is listed as no target."""
    return F.when(marker & parses, "INGEST").when(listed & ~expired, "SKIP").otherwise("FAIL")


def template_status(unique, produced, defects):
    return F.when(unique == 0, "NOT_TARGET").when((produced == unique) & (defects == 0), "OK").otherwise("PARTIAL")
