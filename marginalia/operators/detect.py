"""Styles, in-text citations and references of documents, as rows.

Each takes rows of (doc_id, text); null texts are empty. Every document is worked on alone; only the matches of author-year
forms are exchanged, to bring those of a document together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, reference_fields, reference_list, style
from . import author_year
from .style import styled
from .lift import flat_map

CITATION = (
    "cit_idx int, raw string, normalized string, type string, citation_style string,"
    " authors array<struct<raw: string, normalized: string, is_et_al: boolean, is_organization: boolean, abbreviation: string>>,"
    " year string, year_suffix string, page_numbers string, start int, `end` int, context string, original_author string, original_year string, citation_numbers array<int>"
)
REFERENCE = (
    "ref_idx int, raw string, authors array<struct<last_name: string, last_name_normalized: string, first_name: string, initials: string, suffix: string, is_organization: boolean>>,"
    " author_count int, first_author string, first_author_norm string, second_author string, second_author_norm string, all_authors array<string>, all_authors_norm array<string>,"
    " year string, year_suffix string, title string, source string, volume string, issue string, pages string, doi string, url string, is_group_author boolean,"
    " group_name string, group_abbreviation string, list_number int, type string"
)
FAMILIES = ("comma", "plain", "numeric")


def family_of(name: Column) -> Column:
    """The family of in-text forms that a style uses."""
    return F.when(name.isin(*style.NUMERIC_STYLES), "numeric").when(name.isin(*style.PLAIN_STYLES), "plain").otherwise("comma")


def numbered_citations(docs: DataFrame, key: str, text: str, limit: str | None = None) -> DataFrame:
    """Citations by number; limit: a column with the place of the reference list, from which on other rules hold."""
    make = lambda t, start=None: [{"cit_idx": i, **asdict(c)} for i, c in enumerate(numeric.detect(t, start))]
    return flat_map(docs, key, [text, *([limit] if limit else [])], make, CITATION)


def reference_row(i: int, r: reference_fields.Reference) -> dict:
    names, keys = [a.last_name for a in r.authors], [a.last_name_normalized for a in r.authors]
    row = vars(r) | {"authors": [vars(a) for a in r.authors]}
    first = lambda x, n: x[n] if len(x) > n else None
    return row | {
        "ref_idx": i, "author_count": len(names), "first_author": first(names, 0) or "", "first_author_norm": first(keys, 0) or "", "second_author": first(names, 1),
        "second_author_norm": first(keys, 1), "all_authors": names, "all_authors_norm": keys, "is_group_author": r.is_group,
    }


def detect_styles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Style, paradigm and confidence of each document."""
    return styled(docs, key, text).drop("_text")


def detect_citations(docs: DataFrame, family: str = "comma", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Citations of one family of forms, in order of place (cit_idx from 0). Numeric ones are taken from the whole text."""
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    if family == "numeric":
        return numbered_citations(docs, key, text)
    return (author_year.plain_citations if family == "plain" else author_year.comma_citations)(docs, key, text)


def section_starts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where the reference list begins (null without one)."""
    return flat_map(docs, key, [text], lambda t: [{"section_start": reference_list.section_start(t)}], "section_start int")


def parse_references(docs: DataFrame, style_column: str | None = None, key: str = "doc_id", text: str = "text", fields: Sequence[str] | None = None) -> DataFrame:
    """References of documents, by the style that a column names, if any; all fields of REFERENCE, or some of them."""
    make = lambda t, s=None: [reference_row(i, r) for i, r in enumerate(reference_fields.parse_references(t, s or None))]
    return flat_map(docs, key, [text, *([style_column] if style_column else [])], make, REFERENCE, fields)


def parse_entries(entries: DataFrame, style_column: str, key: str, text: str) -> DataFrame:
    """Fields of single entries, by the style that a column names."""
    return flat_map(entries, key, [text, style_column], lambda t, s: [reference_row(0, reference_fields.parse_entry(t, s or None))], REFERENCE)


SPLITTERS = {"apa": reference_list.split_apa, "harvard": reference_list.split_harvard, "aom": reference_list.split_aom}


def split_run_on(blocks: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """Entries of blocks in which several run on: idx from 0 and entry."""
    return flat_map(blocks, key, [text], lambda t: [{"idx": i, "entry": e} for i, e in enumerate(SPLITTERS[kind](t))], "idx int, entry string")
