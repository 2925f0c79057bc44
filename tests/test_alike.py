"""Equal texts are worked on once, and what is found in them goes to every row that holds them."""

import random
import re
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import reference_fields, reference_list
from marginalia.operators import author_year, places, style
from marginalia.operators.alike import different, once, once_by, once_made
from marginalia.operators.detect import detect_citations, detect_styles
from marginalia.plans.analyze import analyze
from marginalia.queries import queries
from marginalia.sources import corpus
from marginalia.sources.corpus import ordered, works

from .test_functions import APA

ROWS = [(1, "(Smith, 2020)"), (1, "(Smith, 2020)"), (2, "(Smith, 2020)"), (None, "(Smith, 2020)"), (3, "no"), (4, None), (5, "Lee (2001)")]


def test_once_gives_what_an_operator_gives(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    whole = detect_citations(docs)
    assert sorted(map(str, once(docs, "doc_id", "text", lambda each, key: detect_citations(each, key=key)).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert different(docs, "text").count() == 4  # null: empty
    assert once(docs, "doc_id", "text", detect_styles).count() == len(ROWS)


def test_further_inputs_tell_texts_apart(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", None), (4, "x", None)], "doc_id long, text string, style string")
    found = once(docs, "doc_id", "text", lambda each, key: each.select(key, F.coalesce("style", F.lit("-")).alias("seen")), "style")
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, "b"), (3, "-"), (4, "-")] and different(docs, "text", "style").count() == 3


def test_the_analysis_works_on_each_text_once(spark):
    """Texts that came again were analysed again: the work grew with copies."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(APA).alias("text"))
    found = analyze(docs)
    assert found.styles.count() == 50 and found.citations.count() == 100 and {r["status"] for r in found.matches.collect()} == {"matched"}
    read = [p for p in found.references.inputFiles() if p]
    assert min(spark.read.parquet(p).count() for p in read) == 1


def test_entries_and_lines_that_come_again_are_read_once(monkeypatch):
    calls = []
    entry = "Zeno, B. (2001). A study that is read once. Journal of Themes, 1(2), 3-4."
    monkeypatch.setattr(reference_fields, "cleaned", lambda raw, before=reference_fields.cleaned: calls.append(raw) or before(raw))
    first = reference_fields.parse_entry(entry, "apa")
    first.authors[0].last_name, first.title = "changed", "changed"  # it is the caller's own
    again = reference_fields.parse_entry(entry, "apa")
    assert len(calls) == 1 and (again.authors[0].last_name, again.title) == ("Zeno", "A study that is read once.")
    reference_fields.parse_entry(entry + "x" * reference_fields.KEPT_LENGTH, "apa")
    assert reference_fields._read_before.cache_info().maxsize and reference_list._kind_before.cache_info().maxsize


def test_headers_are_looked_for_at_line_breaks(spark):
    """Looking back from every character took most of the time of styles."""
    docs = spark.range(8).select(F.repeat(F.lit("some words of a long line, "), 60_000).alias("text")).cache()
    docs.count()

    def seconds(pattern):
        began = time.perf_counter()
        assert {r[0] for r in docs.select(F.size(F.split("text", F.lit(pattern), 2))).collect()} == {1}
        return time.perf_counter() - began

    slow = r"(?Uiu)(?<!\n[^\S\n]{0,200})" + style.forms.HEADER
    seconds(style.jvm(style.HEADER_ONCE, "i"))
    assert seconds(style.jvm(style.HEADER_ONCE, "i")) * 3 < seconds(slow)


def test_works_meet_by_document_once(spark, tmp_path):
    """Works, their order and their documents need one exchange of numbers; two of texts were made."""
    rows = [(o, p, s) for o in range(3) for p in (1, 61, 2, 7, 41) for s in (1, 6, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = ordered(works(spark, str(tmp_path)))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.groupBy("doc_id").count().collect()[0]["count"] == 7  # parts 1 and 61, suppliers 1 and 6 are alike


def test_queries_take_each_text_once(spark, tmp_path):
    rows = [(o, p, 1, 1, 5.0) for o in range(40) for p in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, n in (("citations_comma", 80), ("citations_numeric", 80), ("references_apa", 80), ("cases_comma", None), ("split_apa", 80)):
        found = queries()[name](spark, str(tmp_path))
        assert n is None or found.count() == n
        assert "sha2" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_all_parts_are_one_pass(spark, tmp_path):
    """Each part read the works again, and the two kinds of rules met by document in an exchange of their texts."""
    spark.createDataFrame([(1, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("violations_parts", "violation_types"):
        plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1, name


def test_texts_are_made_once_for_what_they_are_made_of(spark):
    """Texts of single citations were made for each row, three times, and tested for null down at the scan."""
    rows = spark.createDataFrame([(i, "Lee" if i % 2 else None, 1 + i % 2) for i in range(10)], "id long, a string, n int")
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda a, n: made.add(1) or f"{a} {n}", "string").asNondeterministic()
    found = once_made(rows, "id", ("a", "n"), {"text": count("a", "n")}, lambda each, key: each.select(key, F.upper("text").alias("seen")))
    assert sorted(map(tuple, found.collect())) == [(i, "LEE 2" if i % 2 else "NONE 1") for i in range(10)]
    assert made.value <= 8  # two values, in the distinct texts and in their digests
    lists = rows.select("id", F.array("n", F.lit(None)).alias("ws"))
    found = once_made(lists, "id", ("ws",), {"text": F.col("ws")[0].cast("string")}, lambda each, key: each.select(key, F.col("text").alias("seen")))
    assert sorted(map(tuple, found.collect())) == [(i, str(1 + i % 2)) for i in range(10)]


def test_digests_are_not_tested_for_null(spark):
    """The test went down to the scan, and made each row's text there."""
    docs = spark.range(3).selectExpr("id", "concat('x', id) AS text")
    plan = once(docs, "id", "text", lambda each, key: each.select(key))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "isnotnull" not in plan


def test_tasks_get_works_by_the_bytes_of_their_table(spark, tmp_path, monkeypatch):
    """Works were dealt by the bytes of three numbers each: a task got some millions, and made their texts."""
    spark.range(2000).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(corpus, "TASK", 500)
    assert works(spark, str(tmp_path)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_tasks_get_matches_by_their_estimated_bytes(spark, monkeypatch):
    """Matches were dealt by what is exchanged, which packs well: a task's windows sorted some gigabytes."""
    rows = spark.range(100).selectExpr("id", "0L AS _hash", "0L AS _row", "'x' AS raw")
    monkeypatch.setattr(places, "TASK", 50)
    plan = places.Rows("id").together(rows)._jdf.queryExecution().optimizedPlan()
    assert plan.numPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert detect_citations(spark.createDataFrame(ROWS, "doc_id long, text string")).count() == 5


def test_lists_of_bits_are_the_grouped_works(spark, tmp_path):
    """Of all parts and suppliers, with lines that repeat; a line without a part or a supplier has the works that SQL gives it."""
    rows = [(k % 97, p, s) for k, (p, s) in enumerate((p, s) for p in [*range(60), 127] for s in [*range(5), 13])]
    odd = {1000: (None,) * 5, 1001: ("Benson", None, None, "1991", "two")}
    for name, lines in (("sound", [*rows, *rows[:50]]), ("odd", [(1000, None, None), (1001, 1, None)])):
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    right = {r["doc_id"]: r["ws"] for r in corpus.grouped(works(spark, f"{tmp_path}/sound")).collect()}
    found = [corpus.lists(spark, f"{tmp_path}/{name}").select("doc_id", "n_works", corpus.works_of().alias("ws")).collect() for name in ("sound", "odd")]
    assert {r["doc_id"]: r["ws"] for r in found[0]} == right and all(r["n_works"] == len(r["ws"]) for r in found[0])
    assert {r["doc_id"]: tuple(r["ws"][0]) for r in found[1]} == odd


def test_lists_meet_as_numbers_and_references_have_only_what_is_read(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = queries()["references_harvard"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "to_json" not in plan and "title#" not in plan and "volume#" in plan


def test_headers_are_where_each_form_is_found():
    """As all forms are looked for in the whole text, where they stand behind each other too."""
    rng, bits = random.Random(4), ["\n", "\n\n", " ", "References", "WORKS CITED", "Literature", "Cited Literature", "#", "1. ", "---", "R\nE\nF\nERENCES", "word (2001). "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        right: list[int] = []
        for at in (m.start() for p in reference_list.HEADERS for m in re.finditer(p, text, re.I)):
            if all(abs(at - p) >= reference_list.MERGE_WITHIN for p in right):
                right.append(at)
        assert reference_list._headers(text) == sorted(right)


def test_values_are_worked_on_once(spark, tmp_path):
    """Documents with the same works were matched, and analysed, one by one."""
    rows = [(o, p, 1, 1, 5.0) for o in range(60) for p in (1, 2)] + [(None, 1, 1, 1, 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, n in (("matches", 121), ("match_statistics", 61), ("cases_groups", 120), ("cases_dispatch", 120), ("analysis_statistics", 61)):
        found = queries()[name](spark, str(tmp_path))
        assert found.count() == n and "_made" in found._jdf.queryExecution().optimizedPlan().toString(), name
    assert {r["status"] for r in queries()["matches"](spark, str(tmp_path)).where("doc_id IS NULL").collect()} == {"no_match"}


def test_values_come_once_to_what_is_run(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(30)], "id long, n int")
    found = once_by(rows, "id", ("n",), lambda each, key: each.select(key, "n", F.count("*").over(Window.partitionBy("n")).alias("times")))
    assert sorted((r["id"], r["n"], r["times"]) for r in found.collect()) == [(i, None if i % 3 == 0 else i % 3, 1) for i in range(30)]


def test_citations_before_a_list_need_no_more_of_the_text(spark):
    """The forms were looked for in the whole list, most of a text."""
    rng = random.Random(7)
    bits = ["Smith", "Lee and Ng", "Zeno et al.", " (2001)", "(", ")", " ", ", ", ". ", "and ", "(Lee, 2001)", "(Lee & Ng, 2001; Zeno, 1999a)", "(Lee 2001)", "\n", "n.d.", "WHO", "see ", "; ", "2001", "&", "'s ", "x" * 90]
    far = ["[", "]", "(Lee, p. 4)", " as cited in "]
    texts = []
    for i in range(1500):
        a, b = ("".join(rng.choice(bits if i % 4 else bits + far) for _ in range(rng.randrange(n))) for n in (14, 50))
        texts.append((i, a + "\n\nReferences\n" + b, len(a) + 2))
    docs = spark.createDataFrame(texts, "doc_id long, text string, begin int").repartition(4)
    cut = docs.withColumn("text", author_year.before_list(F.col("text"), F.col("begin")))
    shorter = docs.alias("d").join(cut.alias("c"), "doc_id").where("length(c.text) < length(d.text)").count()
    assert shorter > 100
    for find in (author_year.comma_citations, author_year.plain_citations):
        both = [sorted(map(str, find(d, "doc_id", "text", ("begin",)).where("start < begin").collect())) for d in (docs, cut)]
        assert both[0] == both[1] and len(both[0]) > 300
    far = spark.createDataFrame([("It is.\n\nReferences\nLee (2001). " + "More words (2002). " * 500, 8)], "text string, begin int")
    assert far.select(F.length(author_year.before_list(F.col("text"), F.col("begin")))).first()[0] < 200


def test_texts_of_lists_are_made_once(spark, tmp_path):
    """They were made again for a digest of each, and exchanged to be compared, though lists differ."""
    spark.createDataFrame([(o, p, 1) for o in range(9) for p in (1, 2)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("split_apa", "split_aom"):
        plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "_made" in plan and "_same" not in plan, name


def test_ends_of_entries_are_told_by_the_last_word(monkeypatch):
    """All text before was searched for a last word from each of its places, and for an address though a full stop had decided."""
    seen = []
    monkeypatch.setattr(reference_list, "compiled", lambda p, flags="", before=reference_list.compiled: seen.append(p) or before(p, flags))
    for kind, before, ends in (("apa", "12(3), 45-67.", True), ("aom", "12(3): 45-67.", True), ("aom", "12(3): 45-67. van ", False), ("aom", "Smith, B.,\n", False), ("harvard", "word", False), ("apa", "", False)):
        assert reference_list._ends_entry(before, reference_list.RUN_ON[kind]) is ends
        assert not ends or reference_list.RUN_ON[kind].url not in seen
