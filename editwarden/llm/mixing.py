"""Mixes sources to target weights by subset-sum budget fitting (operator 9).

The size of a document is its number of words. Sources in code-point order (null last) have the weights 5, 2, 1, repeating,
and share EPOCHS times all words; no target is above twice its source's size, what is above goes to the others by weight.
A source whose target reaches its size is taken whole once; the rest of the budget is fitted with
documents that are taken once (or once more): the documents are counted by exact length, each length gives its even
share, long ones fill up to a rest below FIT_WORDS, and a bounded-knapsack table over the lengths finds the largest
sum that still fits. Which documents of a length are taken follows a seeded hash, so reruns agree.

One row per source and length goes to one task: with S words there are at most sqrt(2 S) lengths.
Null texts have size 0; such documents are taken without words. Null sources are one source. Each row is a document of its own,
also without a doc_id or with one that repeats; such rows are told apart by a hash of the text, and rows alike in doc_id, source
and text are interchangeable. Other columns are ignored by ``mix_sources`` and kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwarden.llm.frames import ready, stored, words

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2
FIT_WORDS = 4096
SEED = 9
SUB_BUCKETS = 4096  # a length group is ranked in so many parts


def _size():
    return F.size(words(F.col("text"))).cast("long").alias("size")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, number, source_size, weight, target); the only windows without a key run over one row per source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    rows = sums.withColumn("number", order.cast("int")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1))
    whole = Window.partitionBy()
    # from the source that is full first: the level of words per weight if this one and all later ones are not full
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", F.lit(EPOCHS) * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole)).withColumn(
        "full", F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("all") - F.col("full")) / (F.col("weights") - F.col("used"))
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= MOST * F.col("source_size"), level))
    return rows.select("source", "number", "source_size", "weight", F.least(
        F.col("source_size") * float(MOST), F.max("level").over(whole) * F.col("weight")).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], wanted: int) -> list[int]:
    """How many documents of each length to take so that the words come closest to ``wanted`` from below."""
    total = sum(a * c for a, c in zip(lengths, counts))
    if total <= 0 or wanted <= 0:
        return [0] * len(lengths)
    if wanted >= total:
        return list(counts)
    taken = [c * wanted // total for c in counts]
    rest = wanted - sum(a * t for a, t in zip(lengths, taken))
    order = sorted((k for k in range(len(lengths)) if lengths[k] > 0), key=lambda k: -lengths[k])
    for k in order:
        if rest <= FIT_WORDS:
            break
        more = min(counts[k] - taken[k], (rest - FIT_WORDS // 2) // lengths[k])
        taken[k] += max(0, more)
        rest -= max(0, more) * lengths[k]
    for k in order:  # what the first pass left above the table
        if rest <= FIT_WORDS:
            break
        more = min(counts[k] - taken[k], rest // lengths[k])
        taken[k] += more
        rest -= more * lengths[k]
    # reach holds the sums that can be made, one bit each; steps keeps the bits before each item
    reach, mask, steps = 1, (1 << rest + 1) - 1, []
    for k in order:
        free, size = min(counts[k] - taken[k], rest // lengths[k]), 1
        while free > 0 and not reach >> rest & 1:
            size = min(size, free)
            steps.append((k, size, reach))
            reach |= reach << size * lengths[k] & mask
            free, size = free - size, size * 2
    left = reach.bit_length() - 1
    for k, size, earlier in reversed(steps):
        if not earlier >> left & 1:
            taken[k] += size
            left -= size * lengths[k]
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target >= total)
    extra = fit_lengths(rows["size"].tolist(), rows["count"].tolist(), int(target - whole * total + 0.5))
    return pd.DataFrame({"number": rows["number"], "size": rows["size"], "whole": whole, "extra": extra})


def _row_hash(seed: int):
    """A seeded hash of doc_id; of the text where there is no doc_id."""
    return F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.xxhash64("text")))


def _with_copies(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, h, tie and others) with source_size, target, copies and taken; ``sizes`` (source, size, h) are those of the same rows."""
    targets = stored(source_targets(sizes), "targets")
    sub = F.pmod(F.shiftrightunsigned("h", 40), F.lit(SUB_BUCKETS)).alias("sub")
    # one row per source: Spark broadcasts it while it is small
    numbered = lambda r: r.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))).select(
        *r.columns, "number", "source_size", "target", sub)
    counts = numbered(sizes).groupBy("number", "size", "sub", "source_size", "target").agg(F.count("*").alias("count"))
    plan = counts.groupBy("number", "size", "source_size", "target").agg(F.sum("count").alias("count")).groupBy("number").applyInPandas(
        _fit, "number int, size long, whole int, extra long")
    earlier = Window.partitionBy("number", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number", "size", "sub", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")).join(plan, ["number", "size"])
    rank = F.row_number().over(Window.partitionBy("number", "size", "sub").orderBy("h", "doc_id", "tie"))
    out = numbered(rows).withColumn("rank", rank).join(offsets, ["number", "size", "sub"])
    copies = F.col("whole") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("int")
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("size") * copies).cast("long"))


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken): how often each document is in the mix."""
    ready(docs.sparkSession)
    sizes = stored(docs.select("doc_id", "source", _size(), _row_hash(seed).alias("h"), F.xxhash64("text").alias("tie")), "sizes")
    return _with_copies(sizes, sizes).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the columns ``copies`` and ``taken``; one row each, those with no copy go.

    Rows carry their columns to the place where their copies are decided, so the texts are shuffled once."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    sizes = stored(docs.select("source", _size(), _row_hash(seed).alias("h")), "sizes")
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), "doc_id", "source", _size(), _row_hash(seed).alias("h"), F.xxhash64("text").alias("tie"))
    return _with_copies(sizes, rows).where("copies > 0").select(*[F.col("row")[c].alias(c) for c in names], "copies", "taken")
