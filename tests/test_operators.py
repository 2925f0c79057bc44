"""Operators on DataFrames: matching, statistics, rules, the whole analysis and streams."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import columns, numeric, reference_fields
from marginalia.operators import detect, match, validate
from marginalia.plans.analyze import analyze
from marginalia.streaming.detect import stream_citations, stream_documents

from .test_functions import APA, VANCOUVER


@pytest.fixture(scope="module")
def analysed(spark):
    docs = spark.createDataFrame([(1, APA), (2, VANCOUVER), (3, None), (4, "")], "doc_id long, text string")
    return analyze(docs)


def test_analysis(analysed):
    rows = analysed.matches.orderBy("doc_id", "cit_idx", "number").collect()
    assert [(r["doc_id"], r["cit_idx"], r["ref_idx"], r["status"]) for r in rows] == [
        (1, 0, 0, "matched"), (1, 1, 1, "matched"), (2, 0, 0, "matched"), (2, 1, 1, "matched"), (2, 1, 2, "matched"), (2, 2, 1, "matched"),
    ]
    stats = {r["doc_id"]: r for r in match.match_statistics(analysed.matches).collect()}
    assert stats[1]["match_rate"] == 1.0 and stats[2]["total"] == 4
    assert analysed.styles.where("doc_id > 2").select("style").distinct().collect()[0][0] == "apa"


def test_every_author_year_citation_has_one_row_under_any_partitioning(analysed):
    cited, listed = analysed.citations.where("doc_id = 1"), analysed.references.where("doc_id = 1")
    a = match.match_author_year(cited, listed).collect()
    b = match.match_author_year(cited.repartition(7), listed.repartition(3)).collect()
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == cited.count()


def _citation(names, year, kind, suffix=None, acronym=None):
    authors = [(n, n.lower(), n == "et al.", bool(acronym), acronym) for n in names]
    return (1, 0, kind, year, suffix, authors, None)


def _reference(i, names, year, suffix=None, group=None, acronym=None, raw=""):
    keys = [reference_fields.normalize_name(n) for n in names]
    return (1, i, raw or ", ".join(names), year, suffix, len(names), names[0], keys[0], keys[1] if len(keys) > 1 else None, keys, group is not None, group, acronym, None)


CITED = "doc_id long, cit_idx int, type string, year string, year_suffix string, authors array<struct<raw: string, normalized: string, is_et_al: boolean, is_organization: boolean, abbreviation: string>>, citation_numbers array<int>"
LISTED = (
    "doc_id long, ref_idx int, raw string, year string, year_suffix string, author_count int, first_author string, first_author_norm string, second_author_norm string,"
    " all_authors_norm array<string>, is_group_author boolean, group_name string, group_abbreviation string, list_number int"
)


#: (citation, references, best reference, status, confidence)
CASES = [
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2020")], 0, "matched", 1.0),
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2020", "a")], 0, "matched", 0.985),
    (_citation(["Smith"], "2020", "single", "a"), [_reference(0, ["Smith"], "2020")], None, "no_match", 0.0),  # a letter that the list lacks
    (_citation(["Smith"], "2020", "single", "a"), [_reference(0, ["Smith"], "2020", "b")], 0, "matched", 0.79),
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2021")], 0, "matched", 0.88),
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2023")], None, "no_match", 0.0),
    (_citation(["Smith"], "n.d.", "single"), [_reference(0, ["Smith"], "2023")], 0, "matched", 0.85),
    (_citation(["Smith"], "in press", "single"), [_reference(0, ["Smith"], "in press")], 0, "matched", 1.0),
    (_citation(["Smith"], "in press", "single"), [_reference(0, ["Smith"], "2023")], None, "no_match", 0.0),
    (_citation(["Li"], "2020", "single"), [_reference(0, ["Wu"], "2020")], 0, "matched", 0.86),  # two edits, however short
    (_citation(["Smith", "et al."], "2020", "et_al"), [_reference(0, ["Smith", "Lee", "Ng"], "2020")], 0, "matched", 0.965),
    (_citation(["Smith", "et al."], "2020", "et_al"), [_reference(0, ["Smith"], "2020", raw="Smith, J. et al. (2020)")], 0, "matched", 0.8685),
    (_citation(["Smith", "Lee"], "2020", "two_authors"), [_reference(0, ["Smith", "Lee"], "2020"), _reference(1, ["Smith", "Ng"], "2020")], 0, "matched", 1.0),
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2020"), _reference(1, ["Smyth"], "2020")], 0, "ambiguous", 1.0),
    (_citation(["Smith"], "2020", "single"), [_reference(0, ["Smith"], "2020"), _reference(1, ["Smith"], "2020")], 0, "matched", 1.0),  # the same key
    (_citation(["Zyx"], "2020", "single"), [_reference(0, ["Abcdefgh"], "2020")], None, "no_match", 0.0),
    (_citation(["WHO"], "2020", "group", acronym="WHO"), [_reference(0, ["World Health Organization"], "2020", group="World Health Organization", acronym="WHO")], 0, "matched", 1.0),
]


def test_scores(spark):
    cited = [(i, *c[1:]) for i, (c, *_) in enumerate(CASES)]
    listed = [(i, *r[1:]) for i, (_, rs, *_) in enumerate(CASES) for r in rs]
    rows = {r["doc_id"]: r for r in match.match_author_year(spark.createDataFrame(cited, CITED), spark.createDataFrame(listed, LISTED)).collect()}
    for i, (_, _, ref, status, score) in enumerate(CASES):
        assert (rows[i]["ref_idx"], rows[i]["status"]) == (ref, status) and rows[i]["confidence"] == pytest.approx(score), CASES[i]


def test_without_references_nothing_matches(spark):
    cited = spark.createDataFrame([_citation(["Smith"], "2020", "single"), (1, 1, "numeric", "", None, [], [1, 2])], CITED)
    rows = match.match(cited, spark.createDataFrame([], LISTED)).collect()
    assert sorted((r["cit_idx"], r["status"]) for r in rows) == [(0, "no_match"), (1, "no_match")]


def test_numbers_of_references(spark):
    cited = spark.createDataFrame([(1, 0, "numeric", "", None, [], [1, 2, 9]), (1, 1, "numeric", "", None, [], [])], CITED)
    listed = spark.createDataFrame([_reference(0, ["A"], "1")[:-1] + (1,), _reference(1, ["B"], "1")[:-1] + (1,), _reference(2, ["C"], "1")], LISTED)
    rows = match.match_numeric(cited, listed).orderBy("cit_idx", "number").collect()
    assert [(r["cit_idx"], r["number"], r["ref_idx"], r["status"]) for r in rows] == [(0, 1, 1, "matched"), (0, 2, None, "no_match"), (1, None, None, "no_match")]


def test_columns_agree_with_functions(spark):
    names = ["Müller-Łø", "O`Neil  jr.", "Straße", "ÆSIR", "ﬁne", "", "Ðorđe", "van 't Hoff"]
    ranges = ["1,3-5", "1,123", "7-5", "x", "2 – 4, 9", "1-300", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(columns.normalize_name(F.col("n"))).collect()] == [reference_fields.normalize_name(n) for n in names]
    df = spark.createDataFrame([(n,) for n in ranges], "n string")
    assert [r[0] for r in df.select(columns.expand_range(F.col("n"))).collect()] == [numeric.expand_range(n) for n in ranges]


def test_context_is_clamped(spark):
    df = spark.createDataFrame([("abcdefghij", 4, 6)], "t string, s int, e int")
    assert df.select(columns.context(F.col("t"), F.col("s"), F.col("e"), 2), columns.context(F.col("t"), F.col("s"), F.col("e"))).first()[:] == ("cdefgh", "abcdefghij")


def test_rules(spark):
    refs = spark.createDataFrame(
        [("a", "Smith, J. (2020). Fine title. Journal of Things, 12(3), 45-67.", None, ("Fine title", "https://x.org")), ("b", "Smith, John (2020) Bad. Journal12(3), pages 45–67", "10.1/x", ("The Big Study Of Many Things", "http://x.org,")), ("c", None, None, None)],
        "id string, raw_text string, doi string, parsed_data struct<title: string, url: string>",
    )
    found = validate.validate_references(refs)
    codes = {r["id"]: set(r["codes"]) for r in found.groupBy("id").agg(F.collect_set("code").alias("codes")).collect()}
    assert codes == {"b": {"AUTHOR_FULL_FIRST_NAME", "YEAR_MISSING_PERIOD", "JOURNAL_SPACING", "PAGE_FORMAT", "PAGE_DASH", "DOI_INVALID_PREFIX", "URL_INSECURE", "URL_TRAILING_PUNCTUATION", "TITLE_CAPITALIZATION"}}
    assert validate.severity_counts(found).first()[:] == (0, 5, 4)
    assert [r["type"] for r in validate.by_type(found).collect()] == ["reference"]
    assert validate.validate_for_style("apa", refs.withColumn("doc_id", F.lit(1)), refs.withColumn("doc_id", F.lit(1))).count() == 0


def test_streams_give_what_batches_give(spark, tmp_path):
    docs = spark.createDataFrame([(1, APA), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    keep = lambda found, number: found.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
    query = stream_citations(stream_documents(spark, str(tmp_path / "in")), keep).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    cited = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, cited.collect())) == sorted(map(str, detect.detect_citations(docs).collect())) and cited.count() > 0
