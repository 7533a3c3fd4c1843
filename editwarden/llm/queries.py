"""The queries of the text operators, and the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from editwarden.llm.additive import quality
from editwarden.llm.archives import archived
from editwarden.llm.collocations import collocations, collocations_sql
from editwarden.llm.frames import table
from editwarden.llm.languages import held_out, identified, train
from editwarden.llm.leaks import leaked
from editwarden.llm.licenses import licences, licences_sql
from editwarden.llm.lines import without_repeated_runs
from editwarden.llm.mixing import mix_sources
from editwarden.llm.near import near_duplicates
from editwarden.llm.quality import judged, judged_sql
from editwarden.llm.resampling import resampled, resampled_sql
from editwarden.llm.substrings import without_repeated_passages
from editwarden.llm.suffixes import without_repeated_strings

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


@query("op7_substring_dedup")
def _(spark, sf):
    out = without_repeated_passages(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_minhash_near_dedup")
def _(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=4, percent=80)


@query("op9_mixing")
def _(spark, sf):
    return mix_sources(table(spark, sf, "documents"))


@query("op10_decontamination")
def _(spark, sf):
    return leaked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op6_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    out = identified(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


@query("op4_line_dedup")
def _(spark, sf):
    out = without_repeated_runs(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@query("op1_suffix_dedup")
def _(spark, sf):
    out = without_repeated_strings(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_warc", """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f""")
def _(spark, sf):
    return archived(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_quality_rules", judged_sql())
def _(spark, sf):
    return judged(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_license_scan", licences_sql())
def _(spark, sf):
    return licences(table(spark, sf, "documents"))


@query("op12_importance_resampling", resampled_sql())
def _(spark, sf):
    return resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op11_quality_classifier")
def _(spark, sf):
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_collocations", collocations_sql())
def _(spark, sf):
    return collocations(table(spark, sf, "documents"))
