"""Each operator and each stage on nulls in any column, empty and very long texts, repeated rows, empty tables and clashing columns; and results against plain versions."""

import hashlib
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bag_minhash, decontaminate, pivot_index, queries, secret_scan, toxic_spans, url_filter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _naive_base(text: str) -> list[tuple[int, int, int]]:
    """The contract of base spans, pattern by pattern."""
    either = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join([either(w) for w in ("password", "passwd", "secret", "token")] + [either("api") + "_?" + either("key")])
    kinds = (
        (rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    return sorted((m.start(), k, m.end()) for k, (pattern, fits) in enumerate(kinds) for m in re.finditer(pattern, text) if fits(m))


def test_base_spans_are_those_of_the_contract(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    name = dict(enumerate(("assign", "access", "hex")))
    for r in queries.op9_secret_scan(spark, DATA).collect():
        right = _naive_base(docs[r["doc_id"]])
        listed = ",".join(f"{name[k]}:{s}:{e}" for s, k, e in right)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in right) for i in range(3))
        assert {*listed.split(",")} - {""} <= {*r["spans"].split(",")}
    rng, parts = random.Random(2), ["pass", "word", "Token", "API_key", "apikey", "secret", ":", "=", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é", "eyJ", ".", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in secret_scan.spans(text) if s[1] < 3] == _naive_base(text), text


def test_scans_are_linear():
    for junk in ("eyJ" * 350_000, "eyJ." * 250_000, "password " * 110_000, "token" + " " * 1_000_000, "-----BEGIN RSA PRIVATE KEY-----" * 30_000):
        began = time.perf_counter()
        secret_scan.spans(junk)
        assert time.perf_counter() - began < 3


def test_secrets_in_odd_rows(spark):
    rows = [(1, "token=abcdefgh12"), (1, "token=abcdefgh12"), (None, "x" * 200_000 + " secret: abcdefgh12"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"secrets": F.lit(1), "kind": F.lit("x"), "start": F.lit(2)})
    found = sorted((r["doc_id"] or 0, [(s["kind"], s["start"], s["end"]) for s in r["secrets"]]) for r in secret_scan.scan(df).collect())
    assert found == [(0, [("assign", 200_001, 200_019)]), (1, [("assign", 0, 16)]), (1, [("assign", 0, 16)]), (2, []), (3, [])]


def test_toxicity_of_held_out_documents(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IN (0, 1)").collect()}
    rows = queries.op6_toxic_spans(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.93 and sum(p and not y for p, y in held) <= 0.02 * len(held)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(1)
    plain = ["alpha", "beta", "gamma", "delta", "so", *(f"{a}{b}{c}" for a in "bdfgk" for b in ("ana", "ele", "ovo") for c in "lmnrst")]

    def text(bad):
        words = [rng.choice(plain) for _ in range(40)]
        words[rng.randrange(40)] = "vilest" if bad else "so"
        return " ".join(words)

    docs = [(i, text(i % 2)) for i in range(200)]
    odd = [(None, "so vilest"), (900, "so vilest"), (900, "so vilest"), (901, None), (902, ""), (903, "alpha beta " * 50_000 + "vilest " + "gamma delta " * 50_000), (904, "alpha " * 50_000)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "spans", "k", "t", "y")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, 1), (3, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxic_spans.train(df, labels)
    found: dict = {}
    for r in toxic_spans.score(df, model).collect():
        found.setdefault(r["doc_id"], []).append((r["score"] >= 0.7, [(s["start"], s["end"]) for s in r["spans"]]))
    assert found[900] == [(True, [(3, 9)])] * 2 and found[None] == [(True, [(3, 9)])]
    assert [found[k][0][0] for k in (901, 902, 903, 904)] == [False, False, True, False] and found[903][0][1] == [(550_000, 550_006)]
    kept = toxic_spans.clean(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] is None or r["doc_id"] >= 900} == {901, 902, 904}


def test_one_band_loses_no_link_of_three(spark):
    """With one band of one register a bucket of three is the only one that its texts share."""
    rng, docs, right = random.Random(5), [], {}
    for g in range(200):
        base = [f"g{g}w{i}" for i in range(60)]
        texts = []
        for edits in (1, 0, 1):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(60)] = f"z{rng.randrange(10**9)}"
            texts.append(" ".join(words))
        docs += [(3 * g + i, t) for i, t in enumerate(texts)]
    described = bag_minhash._described([t.encode() for _, t in docs], bag_minhash.WORDS, 1, 1)
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(56)) for _, t in docs]
    for g in range(200):
        ids = [3 * g + i for i in range(3)]
        low = {i: i for i in ids}
        for _ in ids:
            for i in ids:
                for j in ids:
                    if (described[i][3] == described[j][3]).all() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        low[i] = low[j] = min(low[i], low[j])
        right |= low
    found = {r["doc_id"]: r["component_id"] for r in bag_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bands=1, rows=1).collect()}
    assert found == right and len(set(right.values())) < 400


def test_near_copies_of_odd_rows(spark):
    words = [f"w{i}" for i in range(100)]
    one, near, other = " ".join(words), " ".join([*words[:99], "z"]), " ".join(f"v{i}" for i in range(100))
    rows = [(1, one), (1, one), (2, near), (3, other), (4, near), (4, other + " x"), (None, one), (None, one), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("c", "n", "kept", "component_id", "lead")})
    found = {r["doc_id"]: r["component_id"] for r in bag_minhash.near_duplicates(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}  # the two texts of 4 join the groups of both
    kept = bag_minhash.clean(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 5, 6]


def test_vectors_of_several_lengths_and_odd_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), *((10 + i, [float(i == k) for k in range(5)], 1) for i in range(5)), (20, [1.0, 0.0, 0.0, 0.0, 0.1], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (30, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0) for r in pivot_index.links(df).collect())
    assert found == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), (2, 0, 2), (0, 0, 0), (30, 0, 30), (10, 1, 10), (20, 1, 10), *((10 + i, 0, 10 + i) for i in range(1, 5))])
    with pytest.raises(ValueError):
        pivot_index.links(df, nearest=1)


def test_contamination_of_odd_rows(spark):
    words = " ".join(f"b{i}" for i in range(13))
    bench = spark.createDataFrame([(1, words), (1, words), (None, words + " x"), (2, None)], "item_id long, text string").withColumn("n", F.lit(1))
    rows = [(1, f"a {words} c"), (1, f"a {words} c"), (1, "clean words"), (None, words), (None, "clean"), (2, None), (3, ""), (4, "q " * 100_000 + words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "row", "hit", "item")})
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(((r["doc_id"] or 0), (r["text"] or "")[:5]) for r in kept.collect()) == [(0, "clean"), (1, "clean"), (2, ""), (3, ""), (4, "q q q")]
    assert {(r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.report(df, bench).collect()} >= {(None, 13, 13), (1, 15, 13), (4, 100_013, 13), (2, 0, 0)}


def test_urls_of_odd_rows(spark):
    long = "http://a.example/" + "x/" * 100_000 + "casino/poker"
    df = spark.createDataFrame([(1, long), (1, long), (None, "http://x.com/spam-farm"), (2, None), (3, "")], "page_id long, url string").withColumns({"host": F.lit(1), "strict_hits": F.lit(2)})
    found = sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.judge(df, "page_id", "url", queries.URL_RULES).collect())
    assert found == [(0, "block"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    terms = spark.createDataFrame([("Zork", True), ("frob", None), ("", True), (None, True), ("frob", False)], "term string, strict boolean")
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (("zork",), ("frob",)) and url_filter.hits("http://a/ZORK-frob", strict, soft) == (["zork"], ["frob"])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    """Nulls in any column, repeated rows, ids with several texts, and no rows at all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema = docs.schema
    text = "one two three four five six seven eight nine ten\nand a second line of it\nand a third line of it"
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, None, None, None, None), (None, text, None, "s", None), (None, None, None, None, None), (3, "", "en", "s", 0), (1, "another text of one", "en", "s", 3)]
    odd = spark.createDataFrame(rows, schema)
    out = stage(spark, odd, DATA)
    found = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in found]
        assert {1, 2, 3, None} == {*ids} and ids.count(None) == 2
        assert ids.count(1) == (2 if name == "MinHash near-dedup" else 3)
    else:
        assert len(found) == len(rows)
    assert stage(spark, odd.where("false"), DATA).count() == 0
