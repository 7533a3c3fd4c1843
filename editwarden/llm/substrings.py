"""Repeated passages of words by difference-cover anchors (operator 7).

Words are runs of bytes other than ASCII white space, unchanged. A window is WINDOW neighbouring words of one document;
each word covered by a window that also starts in a document with a smaller doc_id is removed.

COVER is a difference cover modulo PERIOD: for any two positions there is a shift below PERIOD that brings both to cover
positions. Two equal windows therefore share an aligned anchor: a run of WINDOW - PERIOD + 1 words that starts at a cover
position in both. Only anchors are hashed and compared across the corpus (first step). Around an anchor that repeats in another
document the match is extended: the full windows that hold it are compared across the corpus by 128-bit hashes, and of
each the earliest document is found (second step). Windows without a repeated anchor are never shipped.

Null and empty texts have no words and lose none. Rows of equal doc_id count as one document's parts that are not compared with
each other. Rows without doc_id are left alone (all words kept). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.blocks import KEY_BITS, PACKED, in_blocks, is_in, later_keys, packed_keys, received, shared_keys, table_batches
from editwarden.llm.frames import parts, ready, words
from editwarden.llm.texts import U64, batch_bytes, sequence_hashes, span_hashes, word_bounds

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set: every difference modulo 31 occurs


def anchor_length(window: int) -> int:
    return window - PERIOD + 1


class _Words:
    """Word hashes of a block's slice, with the place of each word in its document."""

    def __init__(self, part: pa.Table):
        self.doc = part.column("doc_id").to_numpy()
        data, offsets = batch_bytes(part.column("text"))
        self.data = data
        self.starts, self.ends, self.counts = word_bounds(data, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.doc)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.first[self.row]

    def fits(self, at, length):
        return self.place[at] + length <= self.counts[self.row[at]]

    def anchors(self, window):
        """(positions, keys) of the anchors."""
        length = anchor_length(window)
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        keys = sequence_hashes(self.hashes, length)
        at = np.flatnonzero(cover[self.place[:len(keys)] % PERIOD])
        at = at[self.fits(at, length)]
        # a document too short for one window has nothing to remove or to give
        at = at[self.counts[self.row[at]] >= window]
        return at, keys[at] >> U64(64 - KEY_BITS)


def _local_shared(keys, docs):
    """Sorted keys that two documents of the block hold."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    hit = (keys[1:] == keys[:-1]) & (docs[1:] != docs[:-1])
    return np.unique(keys[1:][hit])


def _candidates(table, known, window):
    """(slice, positions of the windows around repeated anchors, hash 1, hash 2, document) of a block."""
    slices = [_Words(part) for part in table_batches(table)]
    found = [s.anchors(window) for s in slices]
    if not found:
        return []
    shared = _local_shared(np.concatenate([k for _, k in found]), np.concatenate([s.doc[s.row[at]] for s, (at, _) in zip(slices, found)]))
    out = []
    for s, (at, keys) in zip(slices, found):
        at = at[is_in(keys, known) | is_in(keys, shared)]
        change = np.zeros(len(s.hashes) + 1, dtype=np.int64)
        low = np.maximum(at - (PERIOD - 1), s.first[s.row[at]])
        np.add.at(change, low, 1)
        np.add.at(change, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        starts = starts[s.fits(starts, window)]
        h1, h2 = sequence_hashes(s.hashes, window, 3), sequence_hashes(s.hashes, window, 4)
        out.append((s, starts, h1[starts], h2[starts], s.doc[s.row[starts]]))
    return out


def _by_key(found):
    """All windows of a block: (hash 1, hash 2, document, first window of each key, number of its key for each window)."""
    h1, h2, doc = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((2, U64), (3, U64), (4, np.int64)))
    order = np.lexsort((doc, h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return h1, h2, doc, order[new], number


def without_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans): the kept words joined by one space, and the removed runs of words."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    buckets = max(1, parts(ready(docs.sparkSession)) // 2)  # blocks times buckets is the number of packed rows
    dealt = in_blocks(docs)

    def anchor_keys(key, table):
        found = [_Words(part).anchors(window)[1] for part in table_batches(table)]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=U64)
        return packed_keys(key[0].as_py(), keys, buckets)

    known = shared_keys(dealt.groupBy("block").applyInArrow(anchor_keys, PACKED))

    def window_keys(key, table, answers):
        found = _candidates(table, received(answers), window)
        h1, h2, doc, first, _ = _by_key(found)
        return packed_keys(key[0].as_py(), h1[first], buckets, h2[first], doc[first], bits=64)

    late = later_keys(dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(window_keys, PACKED))
    both = known.withColumn("step", F.lit(1)).unionByName(late.withColumn("step", F.lit(2)))

    def remove(key, table, answers):
        step = answers.column("step").to_numpy()
        known, late = received(answers.filter(pa.array(step == 1))), received(answers.filter(pa.array(step == 2)))
        found = _candidates(table, known, window)
        h1, _, doc, first, number = _by_key(found)
        # a window goes if its block, or the answer of another block, has an earlier document with it
        gone = (doc > doc[first][number]) | is_in(h1[first], late)[number]
        out, at = [], 0
        for s, starts, *_ in found:
            out.append(_kept(s, starts[gone[at:at + len(starts)]], window))
            at += len(starts)
        return pa.concat_tables(out) if out else _RESULT.empty_table()

    out = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, text string, spans array<struct<first:long,last:long>>")
    mine = words(F.col("text"))
    return out.union(docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long"), F.size(mine).cast("long"), F.lit(0).cast("long"), F.array_join(mine, " "), F.array().cast(out.schema["spans"].dataType)))


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def _kept(s, starts, window):
    """Result rows of one slice, given the starts of the windows that go."""
    change = np.zeros(len(s.hashes) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    begins = gone & ((s.place == 0) | ~np.insert(gone, 0, False)[:-1])
    ends = gone & ((s.place == s.counts[s.row] - 1) | ~np.append(gone, False)[1:])
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    cuts = np.searchsorted(begins, s.first)
    raw, text, spans = s.data.tobytes(), [], []
    removed = np.concatenate([[0], np.cumsum(gone)])[s.first]
    for k in range(len(s.doc)):
        kept = np.flatnonzero(~gone[s.first[k]:s.first[k + 1]]) + s.first[k]
        text.append(b" ".join([raw[i:j] for i, j in zip(s.starts[kept].tolist(), s.ends[kept].tolist())]).decode("utf-8"))
        spans.append([{"first": a, "last": b} for a, b in zip((begins[cuts[k]:cuts[k + 1]] - s.first[k]).tolist(), (ends[cuts[k]:cuts[k + 1]] - s.first[k]).tolist())])
    return pa.table([pa.array(s.doc, pa.int64()), pa.array(s.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(text, pa.string()), pa.array(spans, _RESULT.field("spans").type)],
                    schema=_RESULT)
