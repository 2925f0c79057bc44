"""Functions of columns: names as keys, years, number ranges, similarity. All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons
from .patterns import jvm


def _accents() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter and marks, and these letters: by the Unicode rule, not by a list."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all("̀" <= m <= "ͯ" for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_FROM, _TO = _accents()
SPECIAL = (("ø", "o"), ("æ", "ae"), ("ð", "d"), ("þ", "th"), ("ł", "l"), ("ß", "ss"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decompose_ligatures(text: Column) -> Column:
    return _replaced(text, lexicons.LIGATURES.items())


def organization_names(acronym: Column) -> Column:
    """The full names of a body that is known by an acronym, whatever its case; null for others."""
    names = F.create_map(*(x for a, known in lexicons.ORGANIZATIONS.items() for x in (F.lit(a), F.array(*map(F.lit, known)))))
    return F.try_element_at(names, F.upper(acronym))


def organization_acronym(name: Column) -> Column:
    """The acronym of a body that reference lists know by its full name, whatever its case; null for others."""
    known = F.create_map(*(F.lit(x) for pair in lexicons.ACRONYM_OF.items() for x in pair))
    return F.try_element_at(known, F.lower(name))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, jvm(r"\s+"), " "))


def _key(text: Column) -> Column:
    bare = F.regexp_replace(F.translate(text, _FROM, _TO), "[̀-ͯ]", "")
    return _spaced(F.regexp_replace(F.replace(bare, F.lit("`"), F.lit("'")), "[.,;:]", ""))


def _unless_plain(low: Column, key: Column) -> Column:
    """The key of a text in small letters: of one word of ASCII letters, as most names are, it is the word."""
    return F.when(F.rlike(low, F.lit(r"^[a-z]+\z")), low).otherwise(key)


def normalize_text(text: Column) -> Column:
    return _unless_plain(F.lower(text), _key(decompose_ligatures(F.lower(text))))


def normalize_name(text: Column) -> Column:
    """The key by which names are compared."""
    plain = F.regexp_replace(decompose_ligatures(F.lower(text)), "[´ˆ¨`˜ˊˋ]", "")
    return _unless_plain(F.lower(text), F.trim(F.replace(_key(_replaced(plain, SPECIAL)), F.lit("-"), F.lit(""))))


def expand_range(text: Column, limit: int = 100) -> Column:
    """Numbers of a list like 1,3-5: thousands commas go, a range gives `limit` numbers at most, a falling one none."""
    parts = F.split(F.regexp_replace(text, r"([0-9]),([0-9]{3})(?![0-9])", "$1$2"), jvm(r"\s*,\s*"))
    span = jvm(r"^(\d+)\s*[-–—]\s*(\d+)$")

    def numbers(part):
        low, high = (F.regexp_extract(part, span, g).try_cast("int") for g in (1, 2))
        one = F.regexp_extract(part, jvm(r"^\s*([-+]?\d+)"), 1).try_cast("int")
        listed = F.when(high >= low, F.sequence(low, F.least(high, low + limit - 1))).otherwise(F.array().cast("array<int>"))
        return F.when(low.isNotNull() & high.isNotNull(), listed).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, numbers))


def context(text: Column, start: Column, end: Column, radius: int = 100) -> Column:
    """The text around a span, clamped."""
    begin = F.greatest(start - radius, F.lit(0))
    return F.substring(text, begin + 1, end + radius - begin)


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two name keys: 0 where either is null.

    Equal 1; one in the other 0.95; the first four fifths of the shorter equal (four letters or more) 0.9; then by edits.
    """
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    head = F.ceil(short * 0.8).cast("int")
    edits = F.levenshtein(a, b)
    return (
        F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.95)
        .when((short >= 4) & (F.left(a, head) == F.left(b, head)), 0.9).when(edits == 1, 0.9).when(edits == 2, 0.8)
        .when(edits <= long * 0.2, 0.7).when(edits <= long * 0.3, 0.5).otherwise(0.0)
    )


def base_year(year: Column) -> Column:
    """A year without its letter. So `in press` loses its last letter and equals itself only."""
    return F.lower(F.regexp_replace(F.coalesce(year, F.lit("")), "(?i)[a-z]$", ""))


def year_number(base: Column) -> Column:
    return F.regexp_extract(base, r"^\s*([0-9]+)", 1).try_cast("int")


def year_score(c_year: Column, c_suffix: Column, r_year: Column, r_suffix: Column) -> Column:
    """Agreement of a citation's year and a reference's. A cited letter that the reference lacks scores 0."""
    c, r = base_year(c_year), base_year(r_year)
    cs, rs = (F.lower(F.coalesce(s, F.lit(""))) for s in (c_suffix, r_suffix))
    return (
        F.when((c == "n.d.") | (r == "n.d."), F.when(c == r, 0.9).otherwise(0.5)).when((c == r) & (cs == rs), 1.0).when((c == r) & (cs == ""), 0.95)
        .when((c == r) & (rs != ""), 0.3).when(F.abs(year_number(c) - year_number(r)) == 1, 0.6).otherwise(0.0)
    )
