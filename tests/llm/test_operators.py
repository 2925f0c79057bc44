"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; and on none."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bag_minhash, bpe_codec, decontaminate, edit_counts, line_chunks, pivot_index, repeats, secret_scan, toxic_spans, url_filter
from marginalia.llm.components import components

BPE, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "a long line of words that goes on and on " * 3000
PASSAGE = "first line of the passage\nsecond line of the passage\nthird line of it\nfourth line of it\nfifth line of it\nsixth line of it"
TEXTS = [(1, PASSAGE), (2, "own start\nand more\n" + PASSAGE + "\nown end\nand more"), (3, None), (4, ""), (5, LONG), (6, PASSAGE), (7, "short"), (None, PASSAGE), (6, PASSAGE)]
#: Columns that clash with names that operators use inside.
CLASH = ["id", "n", "key", "row", "code", "codes", "lines", "removed", "spans", "component", "ws", "hit", "t", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_line_chunks(docs, none):
    out = line_chunks.clean(docs)
    assert out.count() == len(TEXTS) and set(CLASH) <= set(out.columns) and line_chunks.clean(none).count() == 0
    rows = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert rows[1]["text"] == PASSAGE and PASSAGE.endswith(rows[6]["text"]) and rows[6]["n_lines_removed"] >= 5  # a last line alone is no chunk
    assert rows[2]["n_lines_removed"] >= 2 and rows[2]["text"].startswith("own start") and rows[2]["text"].endswith("and more")
    assert rows[3]["text"] is None and rows[5]["text"] == LONG
    assert out.where("doc_id IS NULL").first()["text"] == PASSAGE


def test_line_chunks_of_a_hot_passage_and_clashing_columns(spark):
    lines = [f"own {i}" for i in range(40)]
    texts = [(i, f"{lines[i]}\n{PASSAGE}\n{lines[i]} end\nlast of {i}", i, "a") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_lines int, __lines string").withColumns({"__removed": F.lit(1), "__numbers": F.lit(2), "salt": F.lit(3), "salts": F.lit(4), "c": F.lit(5), "code": F.lit(6)})
    out = line_chunks.clean(df, hot=3)
    assert set(out.columns) == {*df.columns, "n_lines_removed"}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["text"] == (texts[i][1] if i == 0 else f"{lines[i]}\n{lines[i]} end\nlast of {i}") and r["n_lines"] == 9 and r["salt"] == 3 for i, r in rows.items()) and len(rows) == 40


def test_planted_passages_go_whole(spark):
    texts, right = [], {}
    for n in range(2, 11):
        for k in range(12):
            passage = [f"shared line {i} of passage {n} {k}" for i in range(n)]
            if k % 3 == 0:
                passage.insert(1, "")  # a blank line inside
            for place in (0, 1):
                own = [f"own line {i} of {n} {k} {place}" for i in range(6)]
                i = (n * 100 + k) * 2 + place
                texts.append((i, "\n".join(own[:3] + passage + own[3:])))
                right[i] = "\n".join(own) if place else texts[-1][1]
    texts += [(9001, "x\nx\nx\nx\nx"), (9002, "one line\n\nmine"), (9003, "one line\n\nyours")]
    found = {r["doc_id"]: r for r in line_chunks.clean(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: found[i]["text"] for i in right} == right
    assert all(found[i]["n_lines"] - found[i]["n_lines_removed"] == right[i].count("\n") + 1 for i in right)
    assert found[9001]["text"] in ("x\nx", "x\nx\nx") and found[9003]["text"].endswith("yours")


def test_near_duplicates(docs, none):
    rows = {r["doc_id"]: r for r in bag_minhash.near_duplicates(docs).collect()}
    assert bag_minhash.near_duplicates(none).count() == 0
    assert {i: r["component_id"] for i, r in rows.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7}
    assert [i for i, r in rows.items() if not r["kept"]] == [6]


def test_near_duplicates_lose_no_link_in_large_groups(spark):
    import random

    rng = random.Random(5)
    base, docs = [f"w{i}" for i in range(100)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(100)] = f"z{rng.randrange(10**7)}"
        docs.append((i, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in bag_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(96)) for i, t in docs}
    right = {i: i for i in sets}
    for _ in sets:
        low = {i: min(right[j] for j in sets if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()) for i in sets}
        if low == right:
            break
        right = low
    assert found == right


def test_near_duplicates_compare_all_pairs_of_buckets_of_three(spark):
    """a is near b and b near c, but a isn't near c; a leads all rounds: its id is the least and its hash the greatest."""
    import random

    rng, docs, right = random.Random(7), [], {}
    codes = {r["id"]: r["h"] for r in spark.range(300 * 50).select("id", F.xxhash64("id").alias("h")).collect()}

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(5, 95)] = f"z{rng.randrange(10**9)}"
        return " ".join(words)

    for g in range(300):
        base, ids = [f"g{g}w{i}" for i in range(100)], range(g * 50, g * 50 + 50)
        a = max(ids[:40], key=codes.get)
        b, c = [i for i in ids if i > a and codes[i] < codes[a]][:2]
        texts = {a: edited(base, 1), b: " ".join(base), c: edited(base, 2)}
        docs += texts.items()
        sets = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(96)) for i, t in texts.items()}
        near = {(i, j): (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total() for i, j in ((a, b), (a, c), (b, c))}
        assert near[a, b]
        right |= {a: a, b: a, c: a if near[a, c] or near[b, c] else c}
    found = {r["doc_id"]: r["component_id"] for r in bag_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    met = bag_minhash._described([t.encode() for _, t in docs], bag_minhash.WORDS, bag_minhash.BANDS, bag_minhash.ROWS)
    apart = {docs[k][0] for k in range(2, len(docs), 3) if not any((met[k][3] == met[j][3]).any() for j in (k - 1, k - 2))}
    assert len(apart) < 10 and {i: x for i, x in found.items() if i not in apart} == {i: x for i, x in right.items() if i not in apart}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}


def test_vectors(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [
        (1, v(1, 0, 0), 1), (2, v(2, 0, 0), 1), (3, v(1, 0.1, 0), 1), (4, v(1, 0, 0), 2), (5, None, 1), (6, v(0, 0, 0), 1), (7, [1.0, None, 0.0], 1), (8, v(1, float("nan"), 0), 1),
        (9, v(1, 0, 0), None), (10, v(1, 0, 0), 1), (11, v(0, 1, 0), 1), (12, v(1, float("inf"), 0), 1), (13, v(-1, 0, 0), 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("v", "id", "rep", "pair", "links")})
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.links(df).collect()}
    assert found == {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 11, 12, 13)} | {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 10: (3, 1, False)}
    assert pivot_index.links(df.where("false")).count() == 0


def test_recall_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    near = np.repeat(x[:60], 4, axis=0) + 0.16 * rng.normal(size=(240, 24))
    every = np.vstack([x, near]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(every)], "vec_id long, embedding array<float>, label int")
    found = sum(r["n_links"] for r in pivot_index.links(df).collect())
    unit = pivot_index.unit(every.astype(np.float64))
    right = int(((unit @ unit.T) >= 0.93).sum() - len(unit))
    assert 0.9 * right <= found <= right and right > 300


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_decontaminate(spark, docs, none, small):
    words = [f"b{i}" for i in range(30)]
    items = [(1, " ".join(words)), (2, "tiny item"), (3, None), (4, ""), (1, "another text of the same id"), (5, " ".join(words[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"w": F.lit(1), "n": F.lit(2)})
    texts = [(1, "x " + " ".join(words[3:17]).upper() + " y"), (2, "a Tiny, item! b"), (3, None), (4, ""), (5, " ".join(words[:12])), (6, "tiny item " * 2000), (7, " ".join(words[3:16] + ["q"] * 400))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.report(df, bench, small=small).collect()}
    assert found == {1: (16, 14, [1]), 2: (4, 2, [2]), 3: (0, 0, []), 4: (0, 0, []), 5: (12, 0, []), 6: (4000, 4000, [2]), 7: (413, 13, [1])}
    assert decontaminate.report(df, bench.where("false"), small=small).where("n_hit > 0").count() == 0
    assert decontaminate.report(none, bench, small=small).count() == 0


def test_codec(docs, none):
    ids = bpe_codec.encode(docs, BPE)
    back = bpe_codec.decode(ids, BPE)
    trip = bpe_codec.round_trip(docs, BPE)
    assert ids.count() == back.count() == trip.count() == len(TEXTS) and bpe_codec.round_trip(none, BPE).count() == 0
    both = ids.where("doc_id = 5").first()["ids"], trip.where("doc_id = 5").first()["n_tokens"]
    assert len(both[0]) == both[1] and trip.where("doc_id = 3").first()["n_tokens"] == 0
    assert back.where("doc_id = 7").first()["decoded"] == "short</w>"


def test_counts(docs, none):
    rows = {r["doc_id"]: r for r in edit_counts.count_edited(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == 0 and rows[5]["n_chars"] == len(LONG) and edit_counts.count_edited(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_kept_trees_follow_edits(spark):
    """Edits of kept trees give the counts of the edited texts, though only what they touch is encoded."""
    import random

    rng, texts, edits, right = random.Random(3), [], [], {}
    count = lambda s: len(edit_counts.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(s))
    for k in range(60):
        text = "".join(rng.choice(["some", " words", " and", "\n", "  ", "é", ", ", " x1", "\t", "."]) for _ in range(rng.randrange(0, 400)))
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4))))
        after = text
        for a, b in reversed(list(zip(places[::2], places[1::2], strict=False))):
            new = "".join(rng.choice(["new", " ", " word", "\n", "!"]) for _ in range(rng.randrange(12)))
            edits.append((k, a, b, new))
            after = after[:a] + new + after[b:]
        texts.append((k, text or None))
        right[k] = after
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"chars": F.lit(1), "edits": F.lit(2)})
    kept = edit_counts.trees(df, RANKS, public_tokenizers.PATTERN)
    changes = spark.createDataFrame([*edits, (None, 0, 1, "x")], "doc_id long, start int, end int, new string")
    found = {r["doc_id"]: r for r in edit_counts.edited(kept, df, changes, RANKS, public_tokenizers.PATTERN).collect()}
    assert {k: (r["text"], r["n_tokens"]) for k, r in found.items()} == {k: (t, count(t)) for k, t in right.items()}
    untouched = [k for k, _ in texts if k not in {e[0] for e in edits}]
    assert untouched and all(found[k]["n_encoded_again"] == 0 for k in untouched)
    again = edit_counts.trees(spark.createDataFrame(list(right.items()), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["n_tokens"] for r in again.collect()} == {k: r["sums"][1] for k, r in found.items()}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (6, 0)], "doc_id long, toxic int")
    model = toxic_spans.train(docs, labels)
    assert toxic_spans.train(none, labels.where("false")).words == {}
    out = toxic_spans.score(docs, model)
    assert out.count() == len(TEXTS) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0 and toxic_spans.score(none, model).count() == 0


def test_repeats(spark, docs, none):
    out = repeats.remove(docs)
    assert out.count() == len(TEXTS) and repeats.remove(none).count() == 0
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[6]["n_removed"] == len(PASSAGE) and rows[1]["n_removed"] == 0 and rows[2]["n_removed"] == len(PASSAGE) and rows[None]["n_removed"] == 0
    assert bytes(rows[2]["kept"]) == b"own start\nand more\n\nown end\nand more" and rows[5]["n_removed"] == 0 and rows[3]["n_bytes"] == 0


@pytest.mark.parametrize(("hot", "slices"), [(repeats.HOT, 30), (3, 30), (3, 3)])
def test_repeats_as_brute_force(spark, hot, slices):
    import random

    rng = random.Random(9)
    pool = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(30, 120))) for _ in range(8)]
    texts = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice("xyz") * rng.randrange(5) for _ in range(6))) for i in range(60)]
    found = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove(spark.createDataFrame(texts, "doc_id long, text string").repartition(slices), hot=hot).collect()}
    seen: dict[bytes, int] = {}
    for i, t in texts:
        b = t.encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t in texts:
        b, gone = t.encode(), set()
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone |= {*range(k, k + 50)}
        assert found[i] == bytes(x for k, x in enumerate(b) if k not in gone)


def test_repeats_of_odd_rows(spark):
    """Texts of one key remove nothing from each other, repeated rows are alike, other integers are keys, strings aren't."""
    a, b = "a" * 30 + "b" * 30 + "c" * 30, "b" * 30 + "c" * 30 + "d" * 5
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (2, b), (3, "x" * 60), (4, None), (None, b)], "k int, text string")
    found = sorted((r["k"] or 0, r["n_bytes"], r["n_removed"]) for r in repeats.remove(df, "k").collect())
    assert found == [(0, 65, 0), (1, 65, 0), (1, 90, 0), (2, 65, 65), (2, 65, 65), (3, 60, 0), (4, 0, 0)]
    with pytest.raises(TypeError):
        repeats.remove(df.withColumn("k", F.col("k").cast("string")), "k")


def test_only_the_transform_removes(monkeypatch):
    """With all of its boundaries kept apart nothing is removed: neither anchors nor equal fragments decide."""
    one = b"some words that are long enough to be a string of fifty bytes and more"
    pool, n = np.frombuffer(one * 2, dtype=np.uint8), len(one) - 49
    z = np.zeros(2, np.int64)
    p = repeats.Pieces(z, np.array([1, 2]), z, z, np.array([n, n]), np.array([0, len(one)]), z + 1)
    assert repeats.decide(pool, p, 50).tolist() == [False] * n + [True] * n
    monkeypatch.setattr(repeats, "joined_prefixes", lambda data, length: (repeats.suffix_order(data, length), np.zeros(len(data), bool)))
    assert not repeats.decide(pool, p, 50).any()


def test_large_anchors_are_halved():
    import random

    rng, length = random.Random(3), 8
    for _ in range(30):
        texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(8, 40))).encode() for _ in range(6)]
        found = [(d // 2, t[a:]) for d in range(rng.randrange(2, 25)) for t in [rng.choice(texts)] for a in [rng.randrange(len(t) - 7)]]
        size = np.array([len(t) for _, t in found])
        z = np.zeros(len(found), np.int64)
        p = repeats.Pieces(z, np.array([d for d, _ in found]), z, z, size - length + 1, np.cumsum(size) - size, z + 1)
        pool, best = np.frombuffer(b"".join(t for _, t in found), dtype=np.uint8), {}
        for d, t in found:
            for i in range(len(t) - length + 1):
                best[t[i : i + length]] = min(best.get(t[i : i + length], 99), d)
        right = [best[t[i : i + length]] < d for d, t in found for i in range(len(t) - length + 1)]
        assert all(repeats.hits(pool, p, length, most).tolist() == right for most in (30, 100, 10**6))


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x#y", "http://net", "net/", None, "", "http://example.com/de/1", "http://myexample.com/de/", "http://x.org/fr/casino/poker", "http://x.org/casino/poker", "http://x.com/spam-farm"]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    rows = [r[1:5] for r in url_filter.judge(df, "page_id", "url", rules).orderBy("page_id").collect()]
    assert rows == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"), ("myexample.com", "/de/", None, "allow"), ("x.org", "/fr/casino/poker", "org/fr/", "allow"),
        ("x.org", "/casino/poker", None, "block"), ("x.com", "/spam-farm", None, "block"),
    ]
    assert url_filter.judge(df.where("false"), "page_id", "url", rules).count() == 0


def test_secrets(docs, none):
    assert secret_scan.scan(docs).where(F.size("secrets") > 0).count() == 0 and secret_scan.scan(none).count() == 0
    assert re.fullmatch("[a-z]+", secret_scan.KINDS[0])
