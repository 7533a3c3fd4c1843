"""Importance resampling of documents towards a target distribution (operator 12).

Features are runs of 1 to ``grams`` words; each falls into one of BUCKETS by crc32. Two passes read the texts. The first counts the
features of a bucket in the corpus and in the target, the second adds up the gains of a document's features. Both intern
the features of a batch in an open-addressed numpy table: a key is the 64-bit xxhash of the bytes, an equal key counts only
after its bytes were compared, and a slot holds the feature's bucket and its count. So crc32 runs once for each different feature of a batch,
and the occurrences gather their gains by slot number.

A bucket's gain is floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) with t of T target features and s of S corpus features. A document weighs the
floored mean gain of its features; Gumbel noise from sha256 of seed and doc_id turns the highest scores into a sample without replacement.

Documents of fewer than ``least_words`` words are scored, not drawn. Null and empty texts have no features and weigh 0. Rows without
doc_id count in the statistics, have no score and are not drawn. Repeated doc_ids share their noise and are drawn each by itself;
rows alike in score and doc_id take neighbouring ranks. Without a target all gains come from the corpus alone. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import parts, ready, settle, stored
from editwarden.llm.texts import U64, batch_bytes, lowered, word_bounds

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
AT_ONCE = 1 << 20  # bytes of text interned in one table
# The five primes of 64-bit xxhash.
PRIME_1, PRIME_2, PRIME_3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
PRIME_4, PRIME_5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)
LONG = 32  # bytes from which a span is hashed by the library, one at a time
VERY_LONG = 256  # bytes from which spans are compared one at a time
# words are runs of digits, letters and bytes above 127
_APART = np.ones(256, dtype=bool)
_APART[0x30:0x3A] = False
_APART[0x61:0x7B] = False
_APART[0x80:] = False


def _crc_table():
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


CRC = _crc_table()


class Spans:
    """Byte spans of one buffer, hashed and compared as arrays."""

    def __init__(self, data, starts, ends):
        self.data, self.starts, self.sizes = data, starts, ends - starts
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[:len(data)] = data
        self.words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place

    def __len__(self):
        return len(self.starts)

    def raw(self, i) -> bytes:
        return self.data[self.starts[i]:self.starts[i] + self.sizes[i]].tobytes()

    def xxhash64(self):
        out = self.sizes.astype(U64) + PRIME_5
        short = np.flatnonzero(self.sizes < LONG)
        at, left = self.starts[short].copy(), self.sizes[short].copy()
        h = out[short]
        while len(some := np.flatnonzero(left >= 8)):
            k = self.words[at[some]] * PRIME_2
            k = ((k << U64(31)) | (k >> U64(33))) * PRIME_1
            v = h[some] ^ k
            h[some] = ((v << U64(27)) | (v >> U64(37))) * PRIME_1 + PRIME_4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        v = h[some] ^ ((self.words[at[some]] & U64(0xFFFFFFFF)) * PRIME_1)
        h[some] = ((v << U64(23)) | (v >> U64(41))) * PRIME_2 + PRIME_3
        at[some] += 4
        left[some] -= 4
        while len(some := np.flatnonzero(left > 0)):
            v = h[some] ^ ((self.words[at[some]] & U64(0xFF)) * PRIME_5)
            h[some] = ((v << U64(11)) | (v >> U64(53))) * PRIME_1
            at[some] += 1
            left[some] -= 1
        h = (h ^ (h >> U64(33))) * PRIME_2
        h = (h ^ (h >> U64(29))) * PRIME_3
        out[short] = h ^ (h >> U64(32))
        for i in np.flatnonzero(self.sizes >= LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw(i))
        return out

    def xxhash64_of(self, chosen):
        """xxhash64 of the chosen spans."""
        part = object.__new__(Spans)
        part.data, part.words, part.starts, part.sizes = self.data, self.words, self.starts[chosen], self.sizes[chosen]
        return part.xxhash64()

    def crc32(self, chosen):
        """crc32 of the chosen spans."""
        out = np.full(len(chosen), 0xFFFFFFFF, dtype=np.uint32)
        order = np.argsort(-self.sizes[chosen], kind="stable")
        sizes, starts = self.sizes[chosen][order], self.starts[chosen][order]
        long = int(np.searchsorted(-sizes, -VERY_LONG, side="right"))
        value = out[long:]
        for k in range(int(sizes[long]) if long < len(sizes) else 0):
            many = int(np.searchsorted(-sizes[long:], -k, side="left"))
            byte = self.data[starts[long:long + many] + k]
            value[:many] = CRC[(value[:many] ^ byte) & 0xFF] ^ (value[:many] >> np.uint32(8))
        value ^= np.uint32(0xFFFFFFFF)
        for i in range(long):
            out[i] = zlib.crc32(self.raw(chosen[order[i]]))
        back = np.empty_like(out)
        back[order] = out
        return back

    def equal(self, a, b):
        """Which spans of a hold the bytes of their spans of b."""
        sizes = self.sizes[a]
        same = sizes == self.sizes[b]
        for i in np.flatnonzero(same & (sizes >= VERY_LONG)).tolist():
            same[i] = self.raw(a[i]) == self.raw(b[i])
        some, done = np.flatnonzero(same & (sizes < VERY_LONG) & (a != b)), 0
        while len(some):
            left = sizes[some] - done
            differ = self.words[self.starts[a[some]] + done] ^ self.words[self.starts[b[some]] + done]
            differ = np.where(left < 8, differ << ((U64(8) - np.minimum(left, 8).astype(U64)) * U64(8) & U64(63)), differ)
            same[some[differ != 0]] = False
            done += 8
            some = some[(differ == 0) & (left > 8)]
        return same


def interned(spans: Spans):
    """(slot of each span, span that holds each slot or -1): equal bytes share a slot of the open-addressed table."""
    n = len(spans)
    size = 1 << max(4, (2 * n).bit_length())
    keys = spans.xxhash64()
    held = np.full(size, -1, dtype=np.int64)
    place = (keys & U64(size - 1)).astype(np.int64)
    slots = np.empty(n, dtype=np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = place[waiting]
        free = held[at] < 0
        held[at[free]] = waiting[free]  # of several the last one holds the slot
        holder = held[at]
        same = keys[holder] == keys[waiting]
        same[same] = spans.equal(waiting[same], holder[same])
        slots[waiting[same]] = at[same]
        waiting = waiting[~same]
        place[waiting] = (place[waiting] + 1) & (size - 1)
    return slots, held


def features(data, offsets, grams: int):
    """(spans, spans per document, words per document) of the runs of 1 to ``grams`` words, in any order within a document."""
    data = lowered(data)
    starts, ends, counts = word_bounds(data, offsets, _APART)
    if grams == 1:
        return Spans(data, starts, ends), counts, counts
    # words joined by one space: a run of words is then one span
    sizes = ends - starts + 1
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts
    text = np.append(data, np.uint8(0x20))[np.repeat(starts - begins, sizes) + np.arange(sizes.sum())]
    text[begins + sizes - 1] = 0x20
    doc = np.repeat(np.arange(len(counts)), counts)
    runs = []
    for n in range(1, grams + 1):
        first = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
        runs.append((doc[first], begins[first], (begins + sizes - 1)[first + n - 1]))
    owner, a, b = (np.concatenate(c) for c in zip(*runs))
    order = np.argsort(owner, kind="stable")
    return Spans(text, a[order], b[order]), np.bincount(owner, minlength=len(counts)), counts


def _slices(batch):
    """Parts of a batch with about AT_ONCE bytes of text each, as (rows, data, offsets)."""
    data, offsets = batch_bytes(batch.column("text"))
    cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] // AT_ONCE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _table(spans: Spans):
    """(slot of each span, slots in use, their buckets, their counts)."""
    slots, held = interned(spans)
    used = np.flatnonzero(held >= 0)
    bucket = np.zeros(len(held), dtype=np.int64)
    bucket[used] = spans.crc32(held[used]) % BUCKETS
    return slots, used, bucket, np.bincount(slots, minlength=len(held))


def bucket_counts(texts: DataFrame, grams: int = 1) -> np.ndarray:
    """Features of each bucket in the column ``text``. The driver gets one row per bucket."""
    def work(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in _slices(batch):
                _, used, bucket, count = _table(features(data, offsets, grams)[0])
                np.add.at(total, bucket[used], count[used])
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    over = (target + 1.0) * float(corpus.sum() + BUCKETS)
    return np.floor(1000 * np.log(over / ((corpus + 1.0) * float(target.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight). ``gain`` has a fixed size."""
    def work(batches):
        for batch in batches:
            for rows, data, offsets in _slices(batch):
                spans, many, words = features(data, offsets, grams)
                slots, _, bucket, _ = _table(spans)
                sums = np.concatenate([[0], np.cumsum(gain[bucket][slots])])
                ends = np.cumsum(many)
                weight = (sums[ends] - sums[ends - many]) // np.maximum(many, 1)
                yield pa.record_batch([rows.column("doc_id"), pa.array(words), pa.array(many), pa.array(weight)],
                                      names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise in thousandths from sha256 of seed and doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, grams: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    spark = ready(docs.sparkSession)
    gain = gains(bucket_counts(docs, grams), bucket_counts(target, grams))
    scored = stored(weights(docs, gain, grams).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"),
        (F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)).alias("enough")), "scores")
    # different scores are some 100,000 at most, whatever the documents: gains and noise are bounded and counted in thousandths
    sizes = scored.where("enough").groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    counts, values = sizes.column("n").to_numpy(), sizes.column("score").to_numpy()
    drawn = percent * int(counts.sum()) // 100
    if drawn == 0:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    cut = int(values[np.searchsorted(np.cumsum(counts), drawn)])
    near = scored.where(F.col("enough") & (F.col("score") >= cut))
    # placed by range, numbered within the partition, and checkpointed so that no row is placed anew
    order = [F.desc("score"), F.asc("doc_id")]
    placed = settle(near.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    each = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).toArrow().sort_by("part").to_pylist()  # one row per partition
    before = np.concatenate([[0], np.cumsum([r["n"] for r in each])])
    offsets = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(each, before)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(~F.coalesce(F.col("enough") & (F.col("score") >= cut), F.lit(False)))
    return ranked.union(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def resampled_sql() -> str:
    """DuckDB SQL for ``resampled`` with its default parameters over ``documents`` and ``benchmark``."""
    def grams(name, key):
        return f"""{name} AS (SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {'documents' if name == 'd' else 'benchmark'})"""
    return f"""WITH crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc
  FROM range(256) t(i)),
{grams('d', 'doc_id')}, {grams('b', 'item_id')},
w AS (SELECT DISTINCT word FROM (SELECT word FROM d UNION ALL SELECT word FROM b)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
  lambda a, x: xor(crc[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % {BUCKETS} AS bucket FROM w, crc_table),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE
  / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM d JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor((total - ((total % n) + n) % n) / n), 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS noise FROM documents LEFT JOIN f USING (doc_id)),
o AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= {LEAST_WORDS} AS enough FROM r),
p AS (SELECT *, CASE WHEN enough THEN row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) END AS place FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM o WHERE enough) // 100 THEN place END AS rank FROM p"""
