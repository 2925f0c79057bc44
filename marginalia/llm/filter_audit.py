"""Filter interaction audit: what each filter removes in every order of the filters, by parts of the corpus.

A document is a mask of the filters that it fails. Masks, with the labels, are counted by part; a part's counts are rows of
an incidence matrix with a column for each mask. What is kept, removed, removed earlier or failed by one filter alone after
each step of each order is linear in these counts, so that products with integer matrices of masks by (order, step), 32 by
600 for five filters, give all outcomes at once. Only counts by part and mask get that far, whatever the size of the corpus.

Texts are read once and leave as a mask and a digest (SHA-256). Whether a smaller id has the same text isn't joined back to
the rows: a digest's rows are summed by part before they are shuffled, with the least id and its rows; what isn't of the
least id fails. So a text that a third of all rows hold is a few sums, and no group is collected.

Null texts are empty; a null part is the empty string. Rows with a null id are judged as others, are never smaller or
greater than another id, and have no labels; rows that repeat an id are separate documents, and none of them is smaller than
the others. An id with several rows of labels has a label if any of these has. Empty tables give no rows. Other columns are
ignored, but `labels` must have the id, `quality` and `toxic`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: The filter for texts that a smaller id has.
REPEATED = "E"


def tests(text: Column) -> dict[str, Column]:
    """Filters of one text, each true for a text that fails it."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def counts(docs: DataFrame, labels: DataFrame, failing=tests, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents, and those with the labels, of each part and mask: (part, mask, n, good, toxic).

    Bit i of a mask is the i-th filter of `failing`; the highest one is set where a smaller id has the same text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    bits = list(failing(F.col("text")).values())
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(bits)), F.lit(0))
    facts = read.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    facts = facts.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col(key).alias("id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    facts = facts.join(known, "id", "left").select("*", *((F.col("n") * F.coalesce(c, F.lit(0))).alias(f"n_{c}") for c in ("good", "toxic")))

    # of each digest and part all rows and those of the least id, then the least id of all parts
    measures = ("n", "n_good", "n_toxic")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *measures)))
    free = lambda c: F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col(c))), F.lit(0)).alias(f"free_{c}")
    groups = facts.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in measures), least.alias("least"), *map(free, measures))
    first = groups.groupBy("digest").agg(F.min("least.id").alias("first"))
    groups = groups.join(first, "digest")
    stays = lambda c: F.col(f"free_{c}") + F.when(F.col("least.id") == F.col("first"), F.col(f"least.{c}")).otherwise(0)
    by_mask = groups.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in measures), *(F.sum(stays(c)).alias(f"first_{c}") for c in measures))
    top = 1 << len(bits)
    split = F.array(
        F.struct("mask", *(F.col(f"first_{c}").alias(c) for c in measures)),
        F.struct((F.col("mask") + top).alias("mask"), *((F.col(c) - F.col(f"first_{c}")).alias(c) for c in measures)),
    )
    out = by_mask.select("part", F.explode(split).alias("r")).select("part", "r.*").where("n > 0")
    return out.select("part", "mask", "n", F.col("n_good").alias("good"), F.col("n_toxic").alias("toxic"))


def matrices(letters: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of the filters, and for each outcome the matrix of masks by orders and steps."""
    orders = ["".join(o) for o in itertools.permutations(letters)]
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    now = np.array([[bit[c] for c in o] for o in orders]).reshape(-1)
    earlier = np.array([[sum(bit[c] for c in o[:i]) for i in range(len(o))] for o in orders]).reshape(-1)
    masks = np.arange(1 << len(letters))[:, None]
    fails, gone = (masks & now) > 0, (masks & earlier) > 0
    made = {"kept": ~gone & ~fails, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(masks == now, fails.shape)}
    return orders, {k: v.astype(np.int64) for k, v in made.items()}


def outcomes(counted: DataFrame, letters: str = "ABCD" + REPEATED) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    orders, by = matrices(letters)
    steps, n_masks = len(letters), 1 << len(letters)
    of_filter = np.array([[letters.index(c) for c in o] for o in orders]).reshape(-1)
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # a row for each mask at most
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                stacked = np.zeros((3, n_masks), np.int64)
                for h in b.column(1)[i].as_py():
                    stacked[:, h["mask"]] = h["n"], h["good"], h["toxic"]
                found = {name: stacked[0] @ m for name, m in by.items()}
                found["good_lost"], found["toxic_lost"] = stacked[1:] @ by["removed"]
                share = np.zeros(steps, np.int64)
                np.add.at(share, of_filter, found["removed"])
                found["shapley"] = share[of_filter]
                n = len(orders) * steps
                keys = pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array(np.repeat(orders, steps).tolist(), pa.string()), pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32())
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(found[c], pa.int64()) for c in names)], names=["part", "filter_order", "step", *names])

    return map_batches(rows, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Outcomes of the five filters in all their orders."""
    return outcomes(counts(docs, labels, tests, key, text, part))


#: The same for each document, order and step.
SQL = r"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
         w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
         l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
         f AS (SELECT w.r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                      concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                             CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                             CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END,
                             CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                             CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
               FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
         x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
         o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
               WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
         s AS (SELECT filter_order, step, filter_order[step] AS now, filter_order[1:step - 1] AS earlier
               FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
         g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
         j AS (SELECT part, filter_order, step, now, n, good, toxic, contains(fails, now) AS hit, fails = now AS alone,
                      len(fails) <> len(translate(fails, earlier, '')) AS gone FROM g, s),
         m AS (SELECT part, filter_order, step, now,
                      sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN hit AND NOT gone AND good = 1 THEN n ELSE 0 END) AS good_lost,
                      sum(CASE WHEN hit AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley FROM m"""
