"""Ranked search, filter audit and packing against plain versions, and on odd rows."""

import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import best_fit, filter_audit, queries, ranked_search

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ranked search


def _terms(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(docs, items, k=10):
    """Every document scored for every item."""
    words = [(d, _terms(t)) for d, t in docs]
    words = [(d, Counter(w), len(w)) for d, w in words if w]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, w, _ in words for t in w)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= {*_terms(text)}
    out = []
    for i, terms in asked.items():
        scored = []
        for d, w, n in words:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def _texts(rng, n, vocabulary):
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(60)))) for i in range(n)]


def test_search_scores_as_all_pairs_do(spark, monkeypatch):
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(300)] + ["É", "x-y", "Zé", "A1"]
    docs = _texts(rng, 400, vocabulary)
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # copies: ties in plenty
    docs += [(3, "w1 w2"), (3, "w1 w2"), (None, "w200 w201 é"), (None, docs[7][1]), (5000, None), (5001, ""), (5002, "?!"), (5003, "w1 " * 400_000 + "w250")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(30)] + [(30, docs[7][1]), (31, None), (32, "nowhere"), (33, "W250"), (33, "w3 w4"), (33, "w3 w4"), (None, "É w5")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "term": F.lit("x"), "item_id": F.lit(7)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit(1), "doc_id": F.lit(2)})
    right = _ranked(docs, items)
    found = ranked_search.search(frame, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, found.collect()), key=str) == right
    monkeypatch.setattr(ranked_search, "BLOCK", 2000)
    assert sorted(map(tuple, ranked_search.search(frame, asked).collect()), key=str) == right


@pytest.mark.parametrize("seed", range(6))
def test_shards_skip_nothing_that_counts(seed):
    """Shards of any size, one after the other under the threshold of those before, hold the k best of all."""
    rng, n_terms = np.random.default_rng(seed), 40
    weights = np.sort(rng.integers(0, 9000, n_terms))[::-1].copy()
    rows = [(i, int(n), {int(t): int(rng.integers(1, 5)) for t in rng.zipf(1.5, 12) % n_terms}) for i, n in enumerate(rng.integers(12, 400, 900))]
    rows += [(1000 + i, *rows[int(rng.integers(5))][1:]) for i in range(200)]
    total = sum(n for _, n, _ in rows)

    def table(part):
        return pa.table({"key": [r[0] for r in part], "n": [r[1] for r in part], "terms": pa.array([[*r[2]] for r in part], pa.list_(pa.int32())), "tfs": pa.array([[*r[2].values()] for r in part], pa.list_(pa.int32()))})

    for _ in range(12):
        terms = rng.permutation(n_terms)[: rng.integers(1, n_terms)]
        score = lambda n, w: sum(int(weights[t]) * (10**9 * w[t] // (1000 * w[t] + 8 * (10 + 90 * n * len(rows) // total))) for t in terms if t in w)  # noqa: B023, E731
        right = sorted((-s, i) for i, n, w in rows if (s := score(n, w)) > 0)[:10]
        heap, found = [], []
        for low in range(0, len(rows), size := int(rng.integers(50, 700))):
            shard = ranked_search.Shard(table(rows[low : low + size]), weights, len(rows), total)
            docs, scores = shard.best(terms, 10, min(heap) if len(heap) == 10 else 0)
            found += [(-int(s), shard.keys[int(d)].as_py()) for d, s in zip(docs, scores, strict=True)]
            heap = sorted([*heap, *map(int, scores)])[-10:]
        assert sorted(found)[:10] == right


def test_search_skips_documents():
    """Documents that hold only common terms aren't touched once ten better ones are known."""
    n = 20_000
    rows = {"key": range(n), "n": [50] * n, "terms": [[0, 1] if i % 100 == 0 else [1] for i in range(n)], "tfs": [[1, 1] if i % 100 == 0 else [1] for i in range(n)]}
    shard = ranked_search.Shard(pa.table({k: pa.array(v, pa.list_(pa.int32())) if k in ("terms", "tfs") else pa.array(v, pa.int64()) for k, v in rows.items()}), np.array([4000, 100]), n, 50 * n)
    taken, whole = [], shard._list
    shard._list = lambda term: taken.append(term) or whole(term)
    docs, _ = shard.best(np.array([0, 1]), 10, 0)
    assert [shard.keys[int(d)].as_py() for d in docs] == list(range(0, 1000, 100)) and shard._sums.astype(bool).sum() == 200 and taken == [0, 1]


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


# filter audit


def _audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    texts = defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].add(i)
    rows = []
    for i, t, part in docs:
        t, fails = t or "", set()
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len({*words}) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if {*t} & {*"#$%&*|"} else set()
        fails |= {"E"} if i is not None and any(j < i for j in texts[t]) else set()
        rows.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        here, shares = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            kept = here
            for step, c in enumerate(order, 1):
                removed, before = [r for r in kept if c in r[1]], {*order[: step - 1]}
                kept = [r for r in kept if c not in r[1]]
                shares[c] += len(removed)
                out[part, "".join(order), step] = [len(kept), len(removed), sum(c in r[1] and bool(r[1] & before) for r in here), sum(r[1] == {c} for r in here), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_is_that_of_each_document(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(150)]
    text = lambda: rng.choice(["\t", " ", "\n\x0b"]).join(rng.sample(words, rng.choice([40, 110, 130]))) + rng.choice(["", "", " # ", " |x", " ABC" * 60, " é word1" * 90])
    docs = [(i, text(), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[9][1], rng.choice(["en", "xx"])) for i in range(60)] + [(-1, docs[9][1], "yy")]
    docs += [(5, "same", "en"), (5, "same", "de"), (6, "same", "en"), (None, "same", "en"), (None, None, None), (7, None, "en"), (8, "", "en"), (9, "A" * 300_000, "zz"), (9, "A" * 300_000, "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-1, 240)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "mask", "digest", "quality", "id")}).repartition(6)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "n": F.lit(3)})
    found = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(frame, known).collect()}
    assert found == _audited(docs, labels)
    no_labels = filter_audit.audit(frame, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(no_labels) == (0, 0) and filter_audit.audit(frame.limit(0), known).count() == 0


def test_matrices_agree_with_orders():
    orders, by = filter_audit.matrices("ABCDE")
    assert len(orders) == 120 and all(m.shape == (32, 600) for m in by.values())
    total = sum(by[k] for k in ("kept", "removed", "redundant"))
    # what is neither kept, removed now nor redundant was removed earlier without failing this filter
    assert total.min() == 0 and total.max() == 1 and (by["unique_fails"] <= by["removed"] + by["redundant"]).all()


# packing


def _plain_best_fit(lengths, most):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(most - n)
    return len(left)


def _placed(plan, counts):
    held = defaultdict(list)
    for n, c in counts.items():
        where, at = plan.places(np.full(c, n), np.arange(c))
        for s, o in zip(where.tolist(), at.tolist(), strict=True):
            held[s].append((o, n))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
    return held


@pytest.mark.parametrize("seed", range(8))
def test_plans_hold_and_are_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    most = rng.choice([8, 100, 1024])
    counts = Counter(min(most, max(1, int(rng.expovariate(3 / most)) if seed % 2 else rng.randint(1, most))) for _ in range(3000))
    held = _placed(plan := best_fit.Plan(counts, most), counts)
    assert [*sorted(held)] == list(range(plan.sequences)) and all(sum(n for _, n in p) <= most for p in held.values())
    assert len(held) <= _plain_best_fit([*counts.elements()], most) + 1
    for rule in ("norm", "dot"):
        documents, cost = rng.randint(1, 6), most * most // rng.randint(1, 3)
        fitting = Counter({n: c for n, c in counts.items() if n * n <= cost})
        held = _placed(best_fit.Plan(fitting, most, documents, cost, rule=rule), fitting)
        assert all(sum(n for _, n in p) <= most and len(p) <= documents and sum(n * n for _, n in p) <= cost for p in held.values())


def test_plans_refuse_what_no_sequence_holds():
    for counts, more in (({11: 1}, {}), ({0: 2}, {}), ({8: 1}, {"cost": 50})):
        with pytest.raises(ValueError):
            best_fit.Plan(counts, 10, **more)
    assert best_fit.Plan({}, 10).sequences == 0
    began = time.perf_counter()
    best_fit.Plan({n: 10**9 + n * 977 for n in range(1, 1025)})  # only counts matter
    assert time.perf_counter() - began < 60


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library, ours, rng = Tokenizer.from_file(BYTE_BPE), best_fit.Encoder(BYTE_BPE), random.Random(6)
    parts = ["the", " of", "\n", "\n\n", " ", "  ", "\t", " ", "　", "'s", "'", "é", "中文", "🙂", "x" * 60, "1234", "?!", "\x00", "\r\n", "\x1c", "́", "<|endoftext|>", "<|", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    long = "lorem ipsum dolor\n" * 200_000
    assert np.frombuffer(ours.encode(long), dtype="<u4").tolist() == library.encode(long, add_special_tokens=False).ids


def _check_packing(docs, rows, most):
    from tokenizers import Tokenizer

    library, right = Tokenizer.from_file(BYTE_BPE), Counter()
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % most or most
        cuts = [0, *range(first, len(ids) + 1, most)]
        for n, (a, b) in enumerate(itertools.pairwise(cuts)):
            right[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == right
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [*itertools.accumulate([0, *[n for _, n in sorted(parts)][:-1]])] and sum(n for _, n in parts) <= most
    assert len(held) <= _plain_best_fit([r["length"] for r in rows], most) + 1


def test_packing_of_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    _check_packing(docs, queries.op13_best_fit(spark, DATA).collect(), 1024)


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "BUCKET", 40)
    rng = random.Random(7)
    docs = [(i, "word " * rng.randrange(90)) for i in range(300)] + [(7, "same text")] * 200 + [(None, "same text"), (None, None), (1, None), (2, ""), (3, "long text " * 30_000), (3, "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "length", "sequence_id", "offset", "_copies")}).repartition(5)
    cut = best_fit.pieces(frame, BYTE_BPE, most=64, with_ids=True)
    packed = best_fit.pack(cut.withColumn("note", F.lit(1)), 64)
    rows = packed.collect()
    assert {r["note"] for r in rows} == {1}
    _check_packing(docs, rows, 64)
    right = defaultdict(list)
    for r in rows:
        right[r["sequence_id"]].append((r["offset"], r["ids"]))
    assert {r["sequence_id"]: r["ids"] for r in best_fit.sequences(packed).collect()} == {s: [i for _, ids in sorted(p) for i in ids] for s, p in right.items()}
    assert best_fit.pack(cut.limit(0)).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack(cut, 32).count()
