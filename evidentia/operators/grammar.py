"""The written forms that guideline documents use.

Fixed values: the patterns, word lists and limits in this file define which
text is a marker, a heading or a grade, and have to be as they are for the
results to be right.
"""

from __future__ import annotations

import re

BLOCK_LIMIT, EXPLANATION_LIMIT = 6000, 2000
EVIDENCE_LINES, HEADER_LINES, HEADER_CHARS = 10, 3, 40

PRINTED_PAGE = re.compile(r"^(\d{1,3})(?:[^\d\s].*)?$", re.A)
CHAPTER = re.compile(r"^([IVX]{1,4}|[Ⅰ-Ⅻ])\.?\s+(\S.*)$")
SECOND_LEVEL = re.compile(r"^(\d+\))\s*(\S.*)$", re.A)
FIRST_LEVEL = re.compile(r"^(\d+)\.?\s+(\S.*)$", re.A)
SYMBOL_LEVEL = re.compile(r"^([●■▣◆□▶])\s*(\S.*)$")
CHAPTER_WORD = "권고"

NUMBER = r"(R(?:\([^)]*\d[^)]*\)|\d[0-9-]*))"
BRACKETED = re.compile(rf"^【\s*{NUMBER}\s*】\s*(.*)$")
BARE = re.compile(rf"^{NUMBER}\.?(?:\s+(.*))?$")
MENTIONED = re.compile(rf"【\s*{NUMBER}\s*】")

TABLE_HEAD = re.compile(r"^권고안(\s+번호)?\s+(권고\s*내용\s+)?권고등급\s*/\s*근거수준")
CONSIDERATION = re.compile(r"^\[?\s*임상적\s*고려사항\s*\]?$")
SUBSECTION = re.compile(r"^(?:\(\d+\)|[①-⑳])")
REFERENCES = re.compile(r"^\[참고문헌\]$")
REFERENCES_PART = re.compile(r"^(?:\[?\s*참고문헌\s*\]?|\(\d+\)\s*참고문헌)")
EXPLANATION_PART = re.compile(r"^(?:\(\d{1,2}\)|[①-⑳])")
CONSENSUS, NOT_DERIVED = "합의를통해권고한다", "권고안도출에반영하지않"

_LEVEL = r"(?:Very\s+Low|High|Moderate|Low|CTB|Insufficient)"
_GRADE = rf"(Inconclusive|{_LEVEL}\s*/\s*GPP|GPP(?:\s*/\s*{_LEVEL})?|[A-D]\.?\s*/\s*{_LEVEL})"
GRADE_TOKEN = re.compile(rf"(?:^|\s){_GRADE}(?=\s|$)", re.I)
GRADE_TAIL = re.compile(rf"(?:^|\s){_GRADE}(?:\s.*)?$", re.I)
UNKNOWN_LEVEL = re.compile(r"(?:^|\s)([A-D])\.?\s*/\s*([A-Za-z]+(?:\s+[A-Za-z]+)?)\s*(?:\d+(?:\s*[,\-–~]\s*\d+)*\)?)?$")
SENTENCE_END = re.compile(r"[.!?。]\s*(?:\d+(?:\s*[,\-–~]\s*\d+)*\))?$")
STOPS = ".!?。"
#: Korean case particles: a line that ends in one ends a word.
PARTICLES = frozenset("을를이가은는의에로와과도만")
