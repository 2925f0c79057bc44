"""The registered queries over these operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, best_fit, bpe_codec, decontaminate, edit_counts, filter_audit, line_chunks, pivot_index, ranked_search, repeats, secret_scan, toxic_spans, url_filter
from .common import read

#: Host and path rules of the URL filter: the longest that fits decides.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.links(read(spark, sf_dir, "embeddings"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_chunks.clean(read(spark, sf_dir, "documents").select("doc_id", "text"), passages=False)  # as its SQL
    return cleaned.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxic_spans.score(docs, toxic_spans.train(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxic_spans.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxic_spans.held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "spans")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), "page_id", "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_sql() -> str:
    host, path = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)", r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    # boundaries are ASCII, and a term is as it stands
    hit = lambda terms: [f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in terms]
    rules = " ".join(
        f"WHEN (host = '{top}' OR ends_with(host, '.{top}')) AND starts_with(path, '/{tail}') THEN '{top}/{tail}'"
        for top, tail in (r.split("/", 1) for r in sorted(URL_RULES, key=lambda r: (-len(r), r)))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())
    return f"""
        WITH u AS (SELECT page_id, translate({host}, '{url_filter._UPPER}', '{url_filter._LOWER}') AS host, {path} AS path,
                          {" OR ".join(hit(url_filter.STRICT))} AS strict, {" + ".join(f"CAST({x} AS INT)" for x in hit(url_filter.SOFT))} AS soft FROM pages),
             r AS (SELECT *, CASE {rules} END AS rule FROM u)
        SELECT page_id, host, path, rule,
               CASE rule {verdicts} ELSE CASE WHEN strict OR soft >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END END AS verdict
        FROM r"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edited(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = best_fit.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit.pack(cut, documents=best_fit.TOKENS, cost=best_fit.TOKENS**2)


ALL = (
    op1_bag_minhash, op2_pivot_index, op3_line_chunks, op4_bpe_codec, op5_decontaminate, op6_toxic_spans, op7_repeats, op8_url_filter, op9_secret_scan, op10_edit_counts,
    op11_ranked_search, op12_filter_audit, op13_best_fit,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pivot_index": pivot_index.SQL, "op3_line_chunks": line_chunks.SQL, "op5_decontaminate": decontaminate.sql(), "op8_url_filter": op8_sql(),
        "op11_ranked_search": ranked_search.SQL, "op12_filter_audit": filter_audit.SQL,
    }
