"""Forms of in-text citations with authors and a year, before which a comma stands; what a citation is.

Rules stand in order of priority: the first that claims a span keeps it. `operators.author_year` finds and decides.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from . import lexicons as words
from .patterns import COMPOUND, COMPOUND_LIST, ET_AL, INITIALS, ORG, PAGES, SIGNAL, SURNAME, YEAR, YEAR_ANY, YEAR_ND

CONTEXT = 100
PAREN, NARRATIVE = "parenthetical", "narrative"


@dataclass
class Author:
    raw: str
    normalized: str
    is_et_al: bool = False
    is_organization: bool = False
    abbreviation: str | None = None


@dataclass
class Citation:
    raw: str
    normalized: str
    type: str
    citation_style: str
    authors: list[Author]
    year: str
    year_suffix: str | None
    start: int
    end: int
    context: str
    page_numbers: str | None = None
    original_author: str | None = None
    original_year: str | None = None
    citation_numbers: list[int] = field(default_factory=list)


def decompose_ligatures(text: str) -> str:
    return "".join([words.LIGATURES.get(c, c) for c in text])


def without_accents(text: str) -> str:
    return "".join([c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ"])


@dataclass(frozen=True)
class Rule:
    """pattern with groups; names: groups of one name each; listed: a group of names with commas; veto: what voids a match."""

    name: str
    pattern: str
    names: tuple[int, ...] = ()
    listed: int | None = None
    year: int = 0
    page: int | None = None
    et_al: bool = False
    kind: str | None = None
    style: str = PAREN
    any_case: bool = False
    veto: tuple[str, ...] = ()


_P = rf"\(\s*{SIGNAL}"
_TAIL = r"(?:,\s*[^)]+)?\)"

#: The rules of one citation for a match, in two runs: those before and after the rules for several years.
FIRST_RULES = (
    Rule("et_al_page", rf"\(\s*({SURNAME})\s+{ET_AL}\s*,\s*({YEAR})\s*,\s*({PAGES})\s*\)", (1,), year=2, page=3, et_al=True, kind="et_al", any_case=True),
    Rule("et_al", rf"{_P}({SURNAME})\s*,?\s+{ET_AL}\s*,?\s*({YEAR_ND})\s*\)", (1,), year=2, et_al=True, kind="et_al", any_case=True),
    Rule("two_page", rf"\(\s*{INITIALS}({SURNAME})\s*&\s*{INITIALS}({SURNAME})\s*,\s*({YEAR})\s*,\s*({PAGES})\s*\)", (1, 2), year=3, page=4, kind="two_authors", any_case=True),
)
RULES = (
    Rule("list_et_al_narrative", rf"\b({COMPOUND_LIST})\s*,?\s+{ET_AL}\s+\(({YEAR_ND})\)", listed=1, year=2, et_al=True, kind="et_al", style=NARRATIVE, veto=("connector",)),
    Rule("list_et_al", rf"\(\s*({COMPOUND_LIST})\s*,?\s+{ET_AL}\s*,?\s*({YEAR_ND})\s*\)", listed=1, year=2, et_al=True, kind="et_al", veto=("connector",)),
    Rule("many", rf"\(\s*({COMPOUND_LIST})\s*,?\s*&\s*({COMPOUND})\s*,\s*({YEAR_ND})\s*\)", (2,), listed=1, year=3, veto=("connector",)),
    Rule("two", rf"{_P}{INITIALS}({COMPOUND})\s*&\s*{INITIALS}({COMPOUND})\s*,\s*({YEAR_ND})\s*\)", (1, 2), year=3, kind="two_authors", any_case=True),
    Rule("one_page", rf"\(\s*{INITIALS}({SURNAME})\s*,\s*({YEAR})\s*,\s*({PAGES})\s*\)", (1,), year=2, page=3, any_case=True),
    Rule("one", rf"{_P}{INITIALS}({COMPOUND})\s*,\s*({YEAR_ANY})\s*\)", (1,), year=2, any_case=True, veto=("month", "parts")),
    Rule("org", rf"{_P}({ORG})\s*,\s*({YEAR_ND})\s*\)", (1,), year=2, kind="group_full", veto=("org",)),
    Rule("plain_et_al", rf"\(\s*({SURNAME})\s+{ET_AL}\s+({YEAR})\s*\)", (1,), year=2, et_al=True, kind="et_al", any_case=True),
    Rule("plain_two", rf"\(\s*({SURNAME})\s+and\s+({SURNAME})\s+({YEAR})\s*\)", (1, 2), year=3, kind="two_authors"),
    Rule("plain_one", rf"\(\s*({COMPOUND})\s+({YEAR})\s*\)", (1,), year=2, veto=("month", "parts")),
    Rule("possessive_et_al", rf"\b({SURNAME})\s+{ET_AL}['’]s\s+\(({YEAR_ND})\)", (1,), year=2, et_al=True, kind="et_al", style=NARRATIVE),
    Rule("possessive_two", rf"\b({SURNAME})\s+and\s+({SURNAME})['’]s\s+\(({YEAR_ND})\)", (1, 2), year=3, kind="two_authors", style=NARRATIVE),
    Rule("possessive_one", rf"\b({SURNAME})['’]s\s+\(({YEAR_ND})\)", (1,), year=2, kind="single", style=NARRATIVE),
    Rule("et_al_narrative", rf"\b({SURNAME})\s+{ET_AL}\s+\(({YEAR_ND}){_TAIL}", (1,), year=2, et_al=True, kind="et_al", style=NARRATIVE, veto=("used", "connector")),
    Rule("and_colleagues", rf"\b({SURNAME})\s+(?:and|&)\s+colleagues\s+\(({YEAR_ND})\)", (1,), year=2, et_al=True, kind="et_al", style=NARRATIVE),
    Rule("with_colleagues", rf"\b({SURNAME})\s+with\s+colleagues\s+\(({YEAR_ND})\)", (1,), year=2, et_al=True, kind="et_al", style=NARRATIVE),
    Rule("two_narrative", rf"\b({COMPOUND})\s+and\s+({COMPOUND})\s+\(({YEAR_ND}){_TAIL}", (1, 2), year=3, kind="two_authors", style=NARRATIVE, veto=("used", "connector")),
    Rule("one_narrative", rf"\b({COMPOUND})\s+\(({YEAR_ND}){_TAIL}", (1,), year=2, kind="single", style=NARRATIVE, veto=("used", "connector", "common")),
)

# Forms of organisations, of secondary sources, and of several years for the same authors.
SECONDARY = rf"\(\s*([^,]+)\s*,\s*({YEAR})\s*,\s*as\s+cited\s+in\s+([^,]+)\s*,\s*({YEAR})\s*\)"
GROUP_BRACKET = rf"\(\s*([A-Z][A-Za-z\s&.'’-]+)\s*\[([A-Z]{{2,}})\]\s*,\s*({YEAR_ND})\s*\)"
GROUP_ACRONYM = rf"\(\s*([A-Z]{{2,}})\s*,\s*({YEAR_ND})\s*\)"
GROUP_NARRATIVE = rf"\b([A-Z]{{2,}})\s+\(({YEAR_ND})\)"
GROUP_COLON = rf"\(\s*(?:(?:e\.g\.|i\.e\.|see)[\s,]+)?([A-Z]{{2,}})\s*:\s*[A-Z][A-Za-z&,'’.\-\s]+?\s*,\s*({YEAR_ND})\s*\)"
GROUP_FULL = (
    r"\(\s*((?:World|American|National|United|International|European|Centers|Federal|British|Canadian|Australian)[A-Za-z\s&]+"
    r"(?:Organization|Association|Institute|Agency|Foundation|Committee|Council|Department|Bureau|Board|Commission|Center|Centre|Administration|Service|Office))"
    rf"\s*,\s*({YEAR_ND})\s*\)"
)
YEARS = rf"(?:{YEAR})(?:\s*,\s*{YEAR})"
YEARS_NARRATIVE = rf"\b({SURNAME})(\s+{ET_AL}|\s+and\s+{COMPOUND})?\s+\(({YEARS}++)\)"
BRACKETED = rf"\b({SURNAME})\s+{ET_AL}\s+\[{SURNAME},\s*[A-Z]\.[^\]]*?\(({YEAR})\)"
MANY_NARRATIVE = rf"\b({COMPOUND_LIST})\s*,?\s+and\s+({COMPOUND})\s+\(({YEAR_ND})\)"
YEARS_PAREN = rf"{_P}({COMPOUND})\s*(,?\s+{ET_AL})?\s*,\s*({YEARS}{{1,8}})\s*\)"
PROSE = r"\(([^)]{1,400})\)"
IN_PROSE = rf"(?<![A-Za-zÀ-ÿ])({COMPOUND}(?:\s*,\s*{COMPOUND})*(?:\s*,?\s*(?:&|and)\s*{COMPOUND})?)(?:\s*,?\s*({ET_AL}))?\s*,\s*({YEAR})(?![\d])"
WITHOUT_YEAR = rf"\(({COMPOUND})(?:\s*(?:&|and)\s*({COMPOUND}))?,\s*pp?\.\s*\d+[^)]*\)"

# What is stripped from the parts of a bundle, and their forms, the first that fits.
STRIPS = (
    (r"^(?:e\.g\.?|i\.e\.?|cf\.?|see(?:[\s,]+(?:also|for\s+example|e\.g\.?))?|as in|c\.f\.?|most recently,? in|for [^,;()]{0,40}?,?\s*see|(?:also\s+)?see\s+[^,;()]{0,30}?\s+in)\s*,?\s+", "i", ""),
    (r"^(?:and|in)\s+(?=[A-ZÀ-Ÿ])", "i", ""),
    (r",\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*$", "i", ""),
    (r"((?:19|20)\d{2}[a-z]?)\s*:\s*\d+(?:\s*[-–—]\s*\d+)?\s*$", "i", r"\1"),
    (r"(,\s*\d{4}[a-z]?)\s+[a-z][\s\S]*$", "", r"\1"),
)
PART_COLON = rf"^([A-Z]{{2,}})\s*:\s*[A-Z][A-Za-z&,'’.\-\s]+?\s*,\s*({YEAR_ND})$"
PART_BRACKET = rf"^([A-Z][A-Za-z&.'’\-\s]+?)\s*\[([A-Z]{{2,}})\]\s*,\s*({YEAR_ND})$"
PART_YEARS = rf"^({COMPOUND})(\s*,?\s+{ET_AL})?\s*,\s*({YEARS}{{1,8}})$"
PART_RULES = (
    Rule("et_al", rf"^({SURNAME})\s*,?\s+{ET_AL}\s*,?\s*({YEAR_ND})$", (1,), year=2, et_al=True, kind="et_al"),
    Rule("two", rf"^{INITIALS}({COMPOUND})\s*&\s*{INITIALS}({COMPOUND})\s*,\s*({YEAR_ND})$", (1, 2), year=3, kind="two_authors"),
    Rule("list_et_al", rf"^({COMPOUND_LIST})\s*,?\s+{ET_AL}\s*,?\s*({YEAR_ND})$", listed=1, year=2, et_al=True, kind="et_al"),
    Rule("many", rf"^({COMPOUND_LIST})\s*,?\s*&\s*({COMPOUND})\s*,\s*({YEAR_ND})$", (2,), listed=1, year=3),
    Rule("one", rf"^{INITIALS}({COMPOUND})\s*,\s*({YEAR_ND})$", (1,), year=2, veto=("parts",)),
)
PART_ORG = rf"^({ORG})\s*,\s*({YEAR_ND})$"
