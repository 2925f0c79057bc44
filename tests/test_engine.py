"""One pass over texts, tables, batches of bounded bytes, entries that come again, and junk of a megabyte."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import reference_fields, reference_list
from marginalia.operators import detect, match, validate
from marginalia.operators.batches import SLICE, map_batches, slices
from marginalia.plans.analyze import analyze
from marginalia.sources.tables import Tables

from .test_functions import APA
from .test_operators import CITED, LISTED, _citation, _reference


def test_the_analysis_reads_texts_once(spark):
    """All four frames read written tables; no plan holds a Python stage."""
    found = analyze(spark.createDataFrame([(1, APA), (2, None)], "doc_id long, text string"))
    for frame in (found.styles, found.citations, found.references, found.matches, match.match_statistics(found.matches)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "FileScan parquet" in plan
    assert {r["doc_id"]: r["has_reference_section"] for r in found.styles.collect()} == {1: True, 2: False}


def test_headers_are_weighed_in_linear_time():
    text = "\nReferences\n(2001) some text here " * 7_000
    began = time.perf_counter()
    assert reference_list.section_start(text) is not None
    assert time.perf_counter() - began < 3


def test_rows_of_one_key_are_documents_of_their_own(spark):
    """Neither citations nor references of rows with one key meet those of another."""
    texts = [f"so ({name}, 2001) said.\n\nReferences\n{name}, B. (2001). A first study of it. Journal of Themes, 1(2), 3-4.\n" for name in ("Adler", "Benson")]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (None, texts[0])], "doc_id long, text string")
    found = analyze(docs)
    assert found.citations.count() == found.references.count() == 5
    assert sorted((r["doc_id"] or 0, r["ref_idx"], r["status"]) for r in found.matches.collect()) == [(0, 0, "matched")] + [(1, 0, "matched")] * 3 + [(2, 0, "matched")]


def test_tables_stay_until_they_are_dropped(spark):
    tables = Tables(spark)
    a = tables.keep(spark.range(10).withColumn("s", F.struct(F.lit("x").alias("y"))))
    b = tables.keep(a.where("id > 20"))
    assert a.count() == 10 and b.count() == 0 and b.schema == a.schema
    tables.drop(a)
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE"):
        a.agg(F.sum("id")).collect()


def test_slices_are_bounded_by_bytes(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 4, None, "b" * 30, "", "c" * 5, "d" * 5])], names=["k", "t"])
    assert [s.column(0).to_pylist() for s in slices([batch, batch.slice(0, 0)], 1, 10)] == [[0, 1], [2], [3, 4, 5]]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    big = spark.range(200).select(F.col("id"), F.repeat(F.lit("x"), 200_000).alias("t")).coalesce(1)
    found = [r["n"] for r in map_batches(big, sizes, "n long").collect()]
    assert max(found) < 2 * SLICE and len(found) > 5


def test_repeated_entries_keep_their_first_place():
    a, b = "Adler, B. (2001). A first study. Journal of Themes, 1(2), 3-4.", "Benson, D. (2002). A second study. Journal of Themes, 2(3), 4-5."
    text = f"body\n\nReferences\n{a}\n{b}\n{a.upper().replace('ADLER', 'Adler')}\n{a}\n"
    assert [r.authors[0].last_name for r in reference_fields.parse_references(text)][:2] == ["Adler", "Benson"]
    assert [r.raw for r in reference_fields._distinct([reference_fields.Reference(x) for x in ("A", "B", "a")])] == ["A", "B"]


@pytest.mark.parametrize("junk", ["Alpha Beta Gamma " * 60_000, "Alpha Beta, J. Gamma (2001). " * 30_000, "[1] " * 250_000, "1. " * 300_000])
def test_splitting_is_linear_in_junk(junk):
    began = time.perf_counter()
    for split in (reference_list.split_apa, reference_list.split_harvard, reference_list.split_aom):
        split(junk)
    assert time.perf_counter() - began < 10


def test_years_with_a_second_one_are_neighbours(spark):
    """A reference of 2020/21 is a year away from a citation of 2021, whichever side has the slash."""
    for cited, listed in (("2021", "2020/21"), ("2020/21", "2021"), ("2019", "2020/21")):
        rows = match.match_author_year(spark.createDataFrame([_citation(["Smith"], cited, "single")], CITED), spark.createDataFrame([_reference(0, ["Smith"], listed)], LISTED)).collect()
        assert [(r["ref_idx"], round(r["confidence"], 4)) for r in rows] == [(0, 0.88)]


def test_one_citation_is_matched_by_itself(spark):
    listed = spark.createDataFrame([_reference(0, ["Smith"], "2020"), _reference(1, ["Lee"], "2020")], LISTED)
    names = ("doc_id", "cit_idx", "type", "year", "year_suffix", "authors", "citation_numbers")
    (row,) = match.match_citation(dict(zip(names, _citation(["Lee"], "2020", "single"), strict=True)), listed).collect()
    assert (row["ref_idx"], row["status"]) == (1, "matched")
    assert match.match_citation({"doc_id": 7, "cit_idx": 0, "type": "numeric", "citation_numbers": [1]}, listed).first()["status"] == "no_match"


def test_titles_are_checked_to_their_end(spark):
    title = "a " + "the " * 150_000 + "Big Study Of Things"
    row = spark.createDataFrame([("x", None, None, (title, None))], "id string, raw_text string, doi string, parsed_data struct<title: string, url: string>")
    assert [r["code"] for r in validate.validate_references(row, parts=["title"]).collect()] == ["TITLE_CAPITALIZATION"]


def test_long_papers_pass_in_small_batches(spark):
    docs = spark.createDataFrame([(i, "so it was (Smith, 2001). " * 2_000) for i in range(30)], "doc_id long, text string").coalesce(1)
    assert detect.detect_citations(docs).count() == 30 * 2_000
