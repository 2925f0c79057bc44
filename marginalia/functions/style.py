"""Citation styles, and the forms by whose counts they are told apart."""

from __future__ import annotations

AUTHOR_YEAR, NUMERIC = "author-year", "numeric"
NUMERIC_STYLES = ("vancouver", "ieee", "nature", "ama")
PLAIN_STYLES = ("harvard", "asa", "chicago-ad")

# The forms that are counted.
HEADER = r"\n\s*(?:References|Bibliography|Literature)\s*\n"
_NAME = r"[A-ZÀ-Ÿ][a-zà-ÿā-ž'-]+"
_IN_TEXT = rf"\(\s*{_NAME}(?:\s+(?:et\s+al\.?|(?:&|and)\s+{_NAME}))?"
COMMA_YEAR, PLAIN_YEAR = rf"{_IN_TEXT}\s*,\s*\d{{4}}[a-z]?\s*\)", rf"{_IN_TEXT}\s+\d{{4}}[a-z]?\s*\)"
RAISED = r"[¹²³⁰⁴-⁹][¹²³⁰⁴-⁹⁻,–—-]*"
FULL_NAMES = rf"{_NAME},\s+[A-ZÀ-Ÿ][a-zà-ÿā-ž]{{2,}}"
CHICAGO_VOLUME, ASA_VOLUME = r"\d+\s+\(\d+\)\s*:\s+\d", r"\d+\(\d+\):\d"
VANCOUVER_AUTHOR = rf"{_NAME}\s+[A-Z]{{1,4}}[,;.]"
IEEE_AUTHOR = r"(?:\[\d+\]|\d+\.)\s*[A-Z]\.\s*(?:[A-Z]\.\s*)*[A-Z][a-z]"
NUMBERED_LINE, LINE = r"^\s*(?:\d+\.\s|\[\d+\]\s)", r"^\s*\S"
FIRST_ENTRY, LINE_NUMBER = r"(?:^|\n)(1\.\s)", r"(?:^|\n)\s*(\d+)\.\s"
GLUED = r"\d{1,3}(?:[,–-]\d{1,3})*"
STATISTIC_AT_END = r"[tFrpzZχ]\s*\([^)]*\)$"
BARE_YEAR = r"[A-Za-z)]\.{0,2}\s+(?:19|20)\d{2}[a-z]?\.\s+[A-Z\"'“”‘’]"
YEAR_AT_END = r"\((?:19|20)\d{2}[a-z]?\)\.(?:\s*$|\s+(?:https?:|doi[.:]|10\.\d))"
