"""Phrase collocations from an FM-index per shard of the corpus (operator 13).

Texts are lowered (A-Z), cut into pieces at marks and line ends, and dealt by doc_id into shards of about SHARD_BYTES. A shard numbers
its words (a word of two languages is two words) and indexes the sequence of word numbers in both directions: rows are places in the
order of the words that follow (precede), the BWT names the word before (after) each row. An n-gram is a pair of intervals of rows.
Extending all n-grams to the left by one word is one pass over the BWT in stable symbol order: the rows of one n-gram that share a
symbol become the interval of the longer n-gram, and its reverse interval starts after the smaller symbols. To the right it is the same with the
indexes swapped. Rows are ordered by no more words than the longest phrase.

Counts are summed across shards, in two steps. First shards send hashes of their bigrams with counts; those that reach ``least`` in sum come back
to the shards that hold them. Then each shard keeps only the runs of words whose bigrams all came back, as no longer phrase can be frequent
otherwise, and enumerates their n-grams to the full length. Words and n-grams travel as text and are counted by it, so a collision
of hashes only costs time. Scores are exact in decimals.

Null texts are empty; a null lang counts as ``und``. Pieces without words give nothing. Repeated rows count each time. Rows without doc_id are dealt
at random. Ties go to the smallest cut, then to score, count and phrase in byte order. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwarden.llm.frames import parts, ready, stored
from editwarden.llm.resampling import Spans, interned
from editwarden.llm.texts import U64, batch_bytes, lowered, mix, word_bounds

LONGEST = 4
LEAST = 30
FIRST = 2000
SCALE = 2_000_000
INSIDE_PERCENT = 80
SHARD_BYTES = 8 << 20
SHARDS_A_TASK = 4
SALTS = 64  # parts of a language whose first phrases are found apart
ROWS_AT_ONCE = 200_000
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?\n\v\f\r")] = True
_APART = _MARK.copy()
_APART[list(b" \t")] = True


class Index:
    """One direction of a bidirectional FM-index over numbers; 0 separates and stands at both ends."""

    def __init__(self, sequence, depth):
        rank, words = sequence.astype(np.int64), 1
        while words < depth:
            after = np.zeros_like(rank)
            after[:-words] = rank[words:]
            keys = rank * (rank.max() + 1) + after
            order = np.argsort(keys)
            rank = np.empty_like(keys)
            rank[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[0]]) != 0)
            words *= 2
        rows = np.argsort(rank, kind="stable")
        bwt = sequence[rows - 1]
        self.order = np.argsort(bwt, kind="stable")  # row C[c] + Occ(c, i) of the longer suffix, for each row i
        self.symbols = bwt[self.order]

    def extend(self, starts, sizes):
        """All extensions of disjoint intervals: (start, size, number of the interval, symbol)."""
        gram = np.full(len(self.order), -1, dtype=np.int64)
        ends = np.cumsum(sizes)
        gram[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)] = np.repeat(np.arange(len(starts)), sizes)
        gram = gram[self.order]
        gram[self.symbols == 0] = -1
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (self.symbols[1:] != self.symbols[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(gram)))
        valid = gram[first] >= 0
        first = first[valid]
        return first, many[valid], gram[first], self.symbols[first]


class Grams:
    """N-grams of one length: their words and their intervals in both directions."""

    def __init__(self, words, ahead, back, sizes):
        self.words, self.ahead, self.back, self.sizes = words, ahead, back, sizes


class BiIndex:
    def __init__(self, sequence, depth):
        self.ahead, self.back = Index(sequence, depth), Index(sequence[::-1], depth)
        counts = np.bincount(sequence)
        words = np.flatnonzero(counts[1:]) + 1
        starts = (np.cumsum(counts) - counts)[words]
        self.single = Grams(words[:, None], starts, starts, counts[words])

    def _grown(self, index, starts, others, sizes):
        first, many, gram, symbol = index.extend(starts, sizes)
        # in the other direction the extensions lie side by side in symbol order, separators first
        order = np.lexsort((symbol, gram))
        total = np.bincount(gram, weights=many, minlength=len(sizes)).astype(np.int64)
        before = np.cumsum(many[order]) - many[order]
        begin = np.cumsum(total) - total
        place = others[gram[order]] + (sizes - total)[gram[order]] + before - begin[gram[order]]
        other = np.empty_like(first)
        other[order] = place
        return first, other, many, gram, symbol[:, None]

    def left(self, grams: Grams) -> Grams:
        ahead, back, sizes, gram, symbol = self._grown(self.ahead, grams.ahead, grams.back, grams.sizes)
        return Grams(np.hstack([symbol, grams.words[gram]]), ahead, back, sizes)

    def right(self, grams: Grams) -> Grams:
        back, ahead, sizes, gram, symbol = self._grown(self.back, grams.back, grams.ahead, grams.sizes)
        return Grams(np.hstack([grams.words[gram], symbol]), ahead, back, sizes)

    def enumerate(self, longest):
        """The n-grams of 2, 3, ... words: extended to the left and to the right by turns."""
        grams = self.single
        for n in range(2, longest + 1):
            grams = self.left(grams) if n % 2 == 0 else self.right(grams)
            yield grams


class Shard:
    """The words of a shard as numbers from 1, in sequence, with 0 between pieces."""

    def __init__(self, table: pa.Table):
        data, offsets = batch_bytes(table.column("text"))
        data = lowered(data)
        starts, ends, counts = word_bounds(data, offsets, _APART)
        spans = Spans(data, starts, ends)
        slots, held = interned(spans)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), counts).astype(np.int64)
        self.languages = langs.dictionary
        known, number = np.unique(slots * len(self.languages) + lang, return_inverse=True)
        self.lang = known % max(1, len(self.languages))  # of each word
        holder = held[known // max(1, len(self.languages))]
        self.words = _strings(spans, holder)
        named = np.array([mix(np.full(1, len(v), U64), 3)[0] ^ U64(int.from_bytes(v.encode()[:8], "big")) for v in self.languages.to_pylist()], dtype=U64)
        self.keys = mix(spans.xxhash64_of(holder) ^ mix(named, 4)[self.lang]) if len(known) else np.zeros(0, U64)
        self.counts = np.bincount(number, minlength=len(known))
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        doc = np.repeat(np.arange(len(counts)), counts)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (marks[starts[1:]] > marks[ends[:-1]])
        self.sequence = separated(number + 1, new)

    def bigram_keys(self):
        """(key of the two words from each place of the sequence, places that hold two words)."""
        both = np.flatnonzero((self.sequence[:-1] > 0) & (self.sequence[1:] > 0))
        return self.pair_keys(self.sequence[both], self.sequence[both + 1]), both

    def pair_keys(self, a, b):
        return mix(self.keys[a - 1] * U64(3) ^ mix(self.keys[b - 1], 6), 7)


def separated(numbers, new):
    """``numbers`` with a 0 before each one that is new, and at the end."""
    place = np.arange(len(numbers)) + np.cumsum(new)
    out = np.zeros(len(numbers) + int(new.sum()) + 1, dtype=np.int64)
    out[place] = numbers
    return out


def _strings(spans: Spans, chosen):
    """The chosen spans as a string column."""
    sizes, starts = spans.sizes[chosen], spans.starts[chosen]
    ends = np.cumsum(sizes)
    data = spans.data[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())]
    return pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data.tobytes()))


def _bigrams(shard, table):
    """(key, shard, n): the bigrams of a shard by hash."""
    found = Shard(table)
    index = BiIndex(found.sequence, 1)
    grams = index.left(index.single)
    keys = found.pair_keys(grams.words[:, 0], grams.words[:, 1]).view(np.int64)
    return pa.table([pa.array(keys), pa.array(np.full(len(keys), shard, np.int32)), pa.array(grams.sizes)], names=["key", "shard", "n"])


def _phrases(table, frequent, longest):
    """(lang, phrase, words, n): the words of a shard, and the n-grams whose bigrams are all frequent."""
    found = Shard(table)
    out = [(found.lang, found.words, 1, found.counts)]
    keys, places = found.bigram_keys()
    good = np.zeros(len(found.sequence), dtype=bool)
    good[places] = np.isin(keys.view(np.int64), frequent)
    inside = good.copy()
    inside[1:] |= good[:-1]
    kept = np.flatnonzero(inside)
    # a run goes on as long as the bigram before the word is frequent
    sequence = separated(found.sequence[kept], ~good[kept - 1]) if len(kept) else np.zeros(1, np.int64)
    for grams in BiIndex(sequence, longest).enumerate(longest):
        columns = [found.words.take(pa.array(grams.words[:, k] - 1)) for k in range(grams.words.shape[1])]
        out.append((found.lang[grams.words[:, 0] - 1], pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())), grams.words.shape[1], grams.sizes))
    return pa.concat_tables([pa.table([
        found.languages.take(pa.array(lang)).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(n), words, np.int32)), pa.array(n)],
        names=["lang", "phrase", "words", "n"]) for lang, phrase, words, n in out])


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): all words, and the phrases of up to ``longest`` words whose bigrams occur ``least`` times."""
    spark = ready(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, parts(spark), -(-size // SHARD_BYTES))
    tasks = max(parts(spark), -(-shards // SHARDS_A_TASK))
    # rows without an id must not meet in one shard
    key = F.when(F.col("doc_id").isNull(), F.rand(13) * (1 << 50)).otherwise(F.xxhash64("doc_id").cast("double"))
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    dealt = docs.select(shard.alias("shard"), F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(tasks, "shard")
    sent = dealt.groupBy("shard").applyInArrow(lambda k, t: _bigrams(k[0].as_py(), t), "key long, shard int, n long").repartition(tasks, "key")
    # a key has at most one row per shard
    answers = sent.withColumn("f", F.sum("n").over(Window.partitionBy("key"))).where(F.col("f") >= least).select("shard", "key")

    def work(key, table, told):
        return _phrases(table, told.column("key").to_numpy(), longest)

    found = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(work, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    counts = stored(phrase_counts(docs, longest, least), "phrases")
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("begin"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("end"))
    parts_of = frequent.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(parts_of.withColumnsRenamed({"part": "begin", "f": "l"}), ["lang", "begin"]).join(
        parts_of.withColumnsRenamed({"part": "end", "f": "r"}), ["lang", "end"])
    exact = F.expr(f"(cast({SCALE} AS decimal(18, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    # every shorter phrase of a candidate, with the most frequent candidate around it
    spans = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    around = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = lowest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * wide("longer") < INSIDE_PERCENT * wide("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then of the language: no task holds all phrases of one language
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first).drop("part", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """DuckDB SQL for ``collocations`` with its default parameters over ``documents``."""
    nexts = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, LONGEST))
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS k, {' || chr(32) || '.join(['w', *(f'w{i}' for i in range(1, n))])} AS phrase FROM x WHERE {'w' if n == 1 else f'w{n - 1}'} IS NOT NULL"
                               for n in range(1, LONGEST + 1))
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
t AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
y AS (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), x AS (SELECT lang, w, {nexts} FROM y WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS ({grams}),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a) // (l.f + r.f) AS score FROM c JOIN range(1, {LONGEST}) x(j) ON j < k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT c.lang, a, unnest(list_transform(range(1, k - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS phrase
  FROM c JOIN range(2, {LONGEST}) y(z) ON z < k) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN u USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {INSIDE_PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN n USING (lang) QUALIFY rank <= {FIRST}"""
