"""Violations of style rules, as rows. Every rule is a condition on columns; all of a kind are checked in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import jvm


class Rule(NamedTuple):
    type: str
    severity: str
    code: str
    description: str | Column
    broken: Column
    location: Column
    suggestion: str | Column | None = None
    affected: Column | None = None


# Words of a title that may be small or capital.
SMALL_WORDS = "a an the and or but of in on at to for from by as is was are were".split()


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def violations(df: DataFrame, keep: Iterable[str], rules: list[Rule]) -> DataFrame:
    """A row for each broken rule, with the columns `keep`."""
    made = F.array(
        *(
            F.when(r.broken, F.struct(
                F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), _text(r.description).alias("description"),
                r.location.alias("location"), _text(r.suggestion).cast("string").alias("suggestion"), _text(r.affected).cast("string").alias("affected_text"),
            ))
            for r in rules
        )
    )
    return df.select(*keep, F.explode(F.array_compact(made)).alias("v")).select(*keep, "v.*")


def _has(text: str | Column, pattern: str, flags: str = "") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(jvm(pattern, flags)), F.lit(False))


def _place(text: str) -> Column:
    return F.when(F.length(F.coalesce("id", F.lit(""))) > 0, F.col("id")).otherwise(F.left(F.col(text), F.lit(50)))


# The codes, severities, messages and patterns of the rules below.


def citation_rules() -> list[Rule]:
    rule = lambda code, what, pattern: Rule("citation", "warning", code, what, _has("citation_text", pattern), _place("citation_text"), affected=F.left("citation_text", F.lit(100)))
    return [
        rule("CITATION_MISSING_COMMA", "Citation missing comma between author and year. Should be (Author, Year)", r"\(\w+\s+\d{4}\)"),
        rule("CITATION_MISSING_PARENS", "Multiple author citation missing parentheses. Should be (Author et al., Year)", r"\b\w+\s+et\s+al\.\s+\d{4}"),
        rule("CITATION_MISSING_PERIOD", 'et al. missing period. Should be "et al."', r"\(\s*et\s+al\s*,"),
        rule("CITATION_SHOULD_USE_ET_AL", 'Three or more authors in citation should use "et al." format', r"\(([A-Z][a-z]+),\s*([A-Z][a-z]+)\s*&\s*([A-Z][a-z]+),\s*\d{4}\)"),
    ]


def author_rules() -> list[Rule]:
    rule = lambda code, what, pattern: Rule("reference", "warning", code, what, _has("raw_text", pattern), _place("raw_text"), affected=F.left("raw_text", F.lit(100)))
    return [
        rule("AUTHOR_FULL_FIRST_NAME", 'Reference should use first initial only (e.g., "Smith, J." not "Smith, John")', r"^[A-Z][a-z]+,\s+[A-Z][a-z]+"),
        rule("MISSING_AMPERSAND", 'Last author in list should be preceded by & (e.g., "& Smith, J.")', r"\b\w+,\s+\w+\.\s*$"),
    ]


def year_rules() -> list[Rule]:
    year, some = F.regexp_extract("raw_text", r"\([0-9]{4}\)", 0), F.length(F.coalesce("raw_text", F.lit(""))) > 0
    bare = some & ~_has("raw_text", r"\(\d{4}\)")
    open_ = some & ~bare & ~F.contains("raw_text", F.concat(year, F.lit(".")))
    return [
        Rule("reference", "warning", "MISSING_YEAR_PARENS", "Reference year should be in parentheses near the start", bare, _place("raw_text"), 'Add year in parentheses: "(Year)."'),
        Rule("reference", "warning", "YEAR_MISSING_PERIOD", "Year in parentheses should be followed by a period", open_, _place("raw_text"), F.concat(F.lit('Format as: "'), year, F.lit('."'))),
    ]


def title_rules(title: Column) -> list[Rule]:
    """Sentence case: more than two words after the first that equal their capital form (digits and quotes do) break it."""
    words = F.split(title, jvm(r"\s+"))
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    capital = F.filter(rest, lambda w: ~F.lower(w).isin(SMALL_WORDS) & (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (F.length(w) > 0))
    broken = (F.length(F.coalesce(title, F.lit(""))) > 0) & (F.size(capital) > 2)
    what = "Reference title appears to have excessive capitalization. APA 7 uses sentence case (only first word capitalized)"
    return [Rule("reference", "info", "TITLE_CAPITALIZATION", what, broken, F.left(title, F.lit(50)), "Only capitalize the first word and proper nouns", title)]


def journal_rules() -> list[Rule]:
    rule = lambda code, what, broken: Rule("reference", "info", code, what, broken, _place("raw_text"))
    return [
        rule("JOURNAL_SPACING", "Missing space before volume number", _has("raw_text", r"[a-z]\d+\(")),
        rule("JOURNAL_ABBREVIATION", 'Should use volume number only, not "Volume" or "Vol."', _has("raw_text", r"Volume\s+\d+|Vol\.\s+\d+", "i")),
    ]


def doi_rules() -> list[Rule]:
    doi, known = F.col("doi"), F.length(F.coalesce("doi", F.lit(""))) > 0
    bare = F.trim(F.regexp_replace("doi", r"(?i)^(https://doi\.org/|doi:)", ""))
    shown = F.coalesce(F.contains("raw_text", F.concat(F.lit("https://doi.org/"), bare)) | F.contains("raw_text", F.concat(F.lit("doi:"), bare)), F.lit(False))
    suggestion = F.concat(F.lit('Format as: "https://doi.org/'), F.regexp_replace("doi", r"^(https://doi\.org/|doi:)", ""), F.lit('"'))
    rule = lambda code, what, broken: Rule("reference", "warning", code, what, known & broken, doi, suggestion, doi)
    return [
        rule("DOI_INVALID_PREFIX", 'DOI should start with "https://doi.org/" or "doi:"', ~shown & ~doi.startswith("https://doi.org/") & ~doi.startswith("doi:")),
        rule("DOI_INSECURE", "DOI URLs should use https:// not http://", F.contains("doi", F.lit("http://"))),
    ]


def url_rules(url: Column) -> list[Rule]:
    known = F.length(F.coalesce(url, F.lit(""))) > 0
    rule = lambda code, what, broken: Rule("reference", "warning", code, what, known & broken, url, affected=url)
    return [
        rule("URL_MISSING_PROTOCOL", "URL should start with http:// or https://", ~url.startswith("http://") & ~url.startswith("https://")),
        rule("URL_INSECURE", "URLs should use https:// not http://", F.contains(url, F.lit("http://"))),
        rule("URL_TRAILING_PUNCTUATION", "URL should not include trailing punctuation", url.endswith(",")),
    ]


def page_rules() -> list[Rule]:
    rule = lambda code, what, pattern, flags="": Rule("reference", "info", code, what, _has("raw_text", pattern, flags), _place("raw_text"))
    return [
        rule("PAGE_FORMAT", 'Use "pp." for multiple pages or "p." for single page', r"\bpages?\s+\d+", "i"),
        rule("PAGE_EXTRA_PERIOD", "Remove period after page numbers", r"pp\.\s+\d+-\d+\."),
        rule("PAGE_DASH", "Use hyphen (-) not en-dash (–) for page ranges", r"\d+–\d+"),
    ]


def validate_citations(citations: DataFrame, keep: Iterable[str] = ("id",)) -> DataFrame:
    """Of rows with id and citation_text."""
    return violations(citations, keep, citation_rules())


def reference_rules() -> dict[str, list[Rule]]:
    """The checks of a reference by the part that they look at."""
    title, url = F.col("parsed_data")["title"], F.col("parsed_data")["url"]
    return {
        "authors": author_rules(), "year": year_rules(), "journal": journal_rules(), "doi": doi_rules(), "url": url_rules(url), "page": page_rules(), "title": title_rules(title),
    }


def validate_references(references: DataFrame, keep: Iterable[str] = ("id",), parts: Iterable[str] | None = None) -> DataFrame:
    """Of rows with id, raw_text, doi and parsed_data (title, url): all checks of a reference, or those of some of its parts."""
    rules = reference_rules()
    return violations(references, keep, [r for part in (rules if parts is None else parts) for r in rules[part]])


def validate_both(rows: DataFrame, keep: Iterable[str] = ("id",)) -> DataFrame:
    """All checks of rows that hold a reference and a citation, in one pass: rows of a group stay where they are."""
    return violations(rows, keep, [*(r for rules in reference_rules().values() for r in rules), *citation_rules()])


def validate_pairs(pairs: DataFrame, keep: Iterable[str] = ("id",)) -> DataFrame:
    """Of rows with id (of the reference), citation_text and raw_text: years that differ."""
    cited, listed = F.regexp_extract("citation_text", "[0-9]{4}", 0), F.regexp_extract("raw_text", r"\(([0-9]{4})\)", 1)
    broken = (F.length(cited) > 0) & (F.length(listed) > 0) & (cited != listed)
    what = F.concat(F.lit("Citation year ("), cited, F.lit(") doesn't match reference year ("), listed, F.lit(")"))
    return violations(pairs, keep, [Rule("reference-match", "error", "YEAR_MISMATCH", what, broken, _place("raw_text"), "Verify the year in both citation and reference")])


def _quoted(prefix: str, text: str, end: str) -> Column:
    return F.concat(F.lit(prefix), F.left(F.coalesce(text, F.lit("")), F.lit(60)), F.lit(end))


def validate_for_style(style: str, citations: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rules of one style: citations have citation_type, citation_text, citation_number; references raw_text and authors.

    APA has no rules here, nor have ASA and Chicago: the frame is empty.
    """
    ref_place = _quoted('Reference: "', "raw_text", '..."')
    if style == "harvard":
        broken = (F.col("citation_type") == "parenthetical") & _has("citation_text", r"[A-Za-z]\s*,\s*\d{4}")
        place = _quoted('Citation: "', "citation_text", '"')
        rule = Rule(
            "citation", "warning", "HARVARD_COMMA_BEFORE_YEAR", "Harvard style: no comma before year in parenthetical citations", broken, place,
            "Remove the comma before the year: (Smith 2020) not (Smith, 2020)", F.col("citation_text"),
        )
        return violations(citations, [key], [rule])
    if style in ("vancouver", "ama"):
        most = citations.where(F.col("citation_type") == "numeric").groupBy(key).agg(F.max("citation_number").alias("most")).where("most IS NOT NULL")
        both = most.join(references.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        what = F.concat(F.lit("Citation ["), F.col("most"), F.lit("] found but only "), F.col("n"), F.lit(" references listed"))
        rule = Rule(
            "reference-match", "error", "VANCOUVER_MISSING_REFS", what, F.col("most") > F.col("n"), F.lit("Reference list"),
            "Ensure all cited reference numbers have corresponding entries in the reference list",
        )
        return violations(both, [key], [rule])
    if style == "nature":
        broken = (F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 5) & ~F.contains(F.lower(F.coalesce("raw_text", F.lit(""))), F.lit("et al"))
        what = 'Nature style: list up to 5 authors, then "et al."'
        return violations(references, [key], [Rule("reference", "warning", "NATURE_AUTHOR_LIMIT", what, broken, ref_place, 'List the first 5 authors followed by "et al."', F.col("raw_text"))])
    if style == "ieee":
        broken = (F.length(F.coalesce("raw_text", F.lit(""))) > 0) & ~_has("raw_text", r"^\[?\d+\]?")
        return violations(references, [key], [Rule("reference", "info", "IEEE_NUMBERED_REFS", "IEEE style: references should be numbered [1], [2], etc.", broken, ref_place)])
    broken = _has("raw_text", r"\(\d{4}[a-z]?\)") if style == "aom" else F.lit(False)
    what = "AOM style: year should not be in parentheses in references"
    rule = Rule("reference", "warning", "AOM_YEAR_NOT_PARENS", what, broken, ref_place, 'Use bare year after author: "Smith, J. A. 2020. Title..."', F.col("raw_text"))
    return violations(references, [key], [rule])


def adapt_citations(citations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detected citations with the names that the rules read; a numeric one gives a row for each number."""
    kind = F.when(F.col("type") == "numeric", "numeric").otherwise(F.col("citation_style"))
    rows = citations.select(key, F.col("cit_idx").cast("string").alias("id"), F.col("raw").alias("citation_text"), kind.alias("citation_type"), F.explode_outer("citation_numbers").alias("citation_number"))
    return rows


def adapt_references(references: DataFrame, key: str = "doc_id") -> DataFrame:
    return references.select(
        key, F.col("ref_idx").cast("string").alias("id"), F.col("raw").alias("raw_text"), "doi", F.struct("title", "url").alias("parsed_data"), F.col("all_authors").alias("authors")
    )


def severity_counts(found: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(*by).agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("info"))


def by_type(found: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """For each type the list of its violations, in order of code and location."""
    each = F.struct("code", "location", "severity", "description", "suggestion", "affected_text")
    return found.groupBy(*by, "type").agg(F.array_sort(F.collect_list(each)).alias("violations"))
