"""Repeated runs of lines by winnowing over line hashes (operator 4).

A run is RUN or more neighbouring lines, or fewer that hold LONG or more words together (lines without a word are passed
over). Each window of RUN lines, and each of fewer lines with LONG words,
selects its smallest line hash (the leftmost of equals) as fingerprint, so two equal runs always select equal fingerprints.
Fingerprints met at two positions are joined; from such a position a match extends both ways over the windows
that hold it, each compared with the earliest equal window in (doc_id, line) order. The union
of the windows that also start earlier, in a smaller document or further up in the same one, is
deleted: later runs go, the first stays. A line shared by many documents costs one row per
position and never a pair: each position meets only the earliest one. A repeat of one or two lines with fewer than
LONG words stays, even if it is a whole text: short common lines are not runs.

A null text stays null and has no lines. Repeated rows of one doc_id count as one document. Rows without
doc_id are left alone. Other columns are passed through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwarden.llm.frames import WORD, ready, stored

RUN = 3
LONG = 20  # words that make a run of fewer lines
_STARTS = "__run_starts"


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\x0b\x0c\r"))


def windows(docs: DataFrame, run: int) -> DataFrame:
    """(doc_id, i, n, fp, at, w1, w2): each window of n lines (``run``, or fewer with LONG words) with its fingerprint, the fingerprint's line and two hashes."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # LONG words have that many characters and white space between them; more than LONG count as LONG
    count = lambda x: F.when(F.length(x) < 2 * LONG - 1, F.size(F.split(x, "[\\x20\\x09-\\x0D]+"))).otherwise(F.least(F.regexp_count(x, F.lit(WORD)), F.lit(LONG)))
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", lines.alias("l")).where(F.size("l") > 0).select(
        "doc_id", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
        F.transform("l", count).alias("words"))

    def cut(n):
        # a sequence to 0 or less would run downwards
        starts = F.when(F.size("h") >= n, F.sequence(F.lit(1), F.greatest(F.size("h") - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        if n < run:
            starts = F.filter(starts, lambda i: F.aggregate(F.slice("words", i, n), F.lit(0), lambda s, v: s + v) >= LONG)
        return F.transform(starts, lambda i: F.struct((i - 1).alias("i"), F.slice("h", i, n).alias("h"), F.slice("g", i, n).alias("g")))

    each = hashed.select("doc_id", F.explode(F.concat(*[cut(n) for n in range(1, run + 1)])).alias("w"))
    least = F.array_min("w.h")
    return each.select(
        "doc_id", "w.i", F.size("w.h").alias("n"), least.alias("fp"), (F.col("w.i") + F.array_position("w.h", least) - 1).alias("at"),
        F.xxhash64("w.h").alias("w1"), F.xxhash64(F.lit(2), "w.g").alias("w2"))


def later_windows(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, i, n): windows of n lines that start a second or later time, i counted in lines with a word."""
    rows = stored(windows(docs, run), "line-windows")
    place = F.struct("doc_id", "at")
    met = rows.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("fp")
    near = rows.join(met, "fp", "left_semi").select("doc_id", "i", "n", "w1", "w2")
    first = near.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "i")).alias("first"))
    return near.join(first, ["w1", "w2"]).where(F.struct("doc_id", "i") > F.col("first")).select("doc_id", "i", "n")


def without_repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The rows of ``docs`` with the later repeated runs deleted from ``text``; adds n_lines, n_removed as __n_lines, __n_removed."""
    ready(docs.sparkSession)
    starts = later_windows(docs.select("doc_id", "text"), run).groupBy("doc_id").agg(F.collect_set(F.struct("i", "n")).alias(_STARTS))
    joined = docs.join(starts, "doc_id", "left").select(*docs.columns, _STARTS)
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [
        T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())])
    place = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            many, removed = [], []
            for k, (text, found) in enumerate(zip(texts, batch.column(len(batch.columns) - 1).to_pylist())):
                lines = [] if text is None else text.split("\n")
                many.append(len(lines))
                removed.append(0)
                if not found or text is None:
                    continue
                gone = {w["i"] + d for w in found for d in range(w["n"])}
                kept, ordinal = [], 0
                for line in lines:
                    word = _has_word(line)
                    if not (word and ordinal in gone):
                        kept.append(line)
                    ordinal += word
                removed[-1] = len(lines) - len(kept)
                texts[k] = "\n".join(kept)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.record_batch(columns + [pa.array(many, pa.int64()), pa.array(removed, pa.int64())], names=kinds.names)

    return joined.mapInArrow(work, kinds)


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Stage form: the columns of ``docs``; n_chars follows the text; a document of which no word is left goes."""
    out = without_repeated_runs(docs, run)
    empty = (F.col("__n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    out = out.where(~F.coalesce(empty, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
