"""Benchmark passages in documents, within an edit budget (operator 10).

Item and document are compared in lower case with runs of white space as one space. An item of m characters may
differ by m // EDIT_PERIOD edits (one at least): it is cut into one piece more than that, so whatever lies
within the budget holds one piece unchanged. All pieces are found at once by a search automaton; around each hit
the whole item is compared with Myers' bit-parallel distance. Items are a query set: they are read in
blocks of a bounded number of characters, each block meets all documents.

Items under SHORTEST characters have no budget: they match where they stand unchanged between word ends, so a one-word
item matches every document with that word. A null or empty text, of an item or a document, matches nothing.
Repeated items count each; items without item_id count as one and are not listed in item_ids. Each row of the documents is judged
by its own text, also without a doc_id or with one that repeats. Other columns are passed through or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import ready

EDIT_PERIOD = 16
SHORTEST = 24
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return "" if text is None else " ".join(text.lower().split())


def budget(item: str) -> int:
    return max(1, len(item) // EDIT_PERIOD) if len(item) >= SHORTEST else 0


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether the part from start to end is not cut out of a longer word."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    right = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not left and not right


def pieces(item: str):
    """(offset, piece): the item in budget + 1 pieces of nearly equal length."""
    many = budget(item) + 1
    cuts = [len(item) * k // many for k in range(many + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_distance(masks: dict[str, int], length: int, text: str) -> int:
    """Smallest edit distance between the item of these masks and any part of ``text`` (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best = length
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        diagonal = ((((equal & plus) + plus) ^ plus) | equal) & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full  # a match may begin anywhere: no carry into the first row
        down = (down << 1) & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
    return best


class Finder:
    """Finds the items of one block in texts. Made once per task."""

    def __init__(self, items):
        import ahocorasick
        self.items = [(key, text, letter_masks(text)) for key, text in items]
        places: dict[str, list] = {}
        for k, (_, text, _) in enumerate(self.items):
            for offset, piece in pieces(text):
                places.setdefault(piece, []).append((k, offset))
        self.search = ahocorasick.Automaton()
        for piece, at in places.items():
            self.search.add_word(piece, (len(piece), at))
        self.empty = not places
        if places:
            self.search.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """Least distance by number of the item, for items within their budget."""
        out: dict[int, int] = {}
        if self.empty or not text:
            return out
        text = normal(text)
        tried = set()
        for end, (length, at) in self.search.iter(text):
            for k, offset in at:
                start = end + 1 - length - offset
                if out.get(k) == 0 or (k, start) in tried:
                    continue
                if len(self.items[k][1]) < SHORTEST:
                    if stands_alone(text, start, end + 1):
                        out[k] = 0
                    continue
                tried.add((k, start))
                _, item, masks = self.items[k]
                edits = budget(item)
                part = text[max(0, start - edits):start + len(item) + edits]
                distance = 0 if item in part else least_distance(masks, len(item), part)
                if distance <= edits and distance < out.get(k, edits + 1):
                    out[k] = distance
        return out


def item_blocks(items: DataFrame):
    """Lists of (item_id, normal text), each of about BLOCK_CHARS characters."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = -(-size // BLOCK_CHARS)
    rows = items.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, many))))
    for block in range(many):
        got = [(r["item_id"], normal(r["text"])) for r in rows.where(F.col("block") == block).select("item_id", "text").collect()]
        yield sorted(((k, t) for k, t in got if t), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leak_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance) of every item found in a document within its budget."""
    ready(docs.sparkSession)
    found = None
    for block in item_blocks(items):
        def work(batches, block=block):
            finder = Finder(block)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [(doc, finder.items[k][0], d) for k, d in sorted(finder.find(text).items())]
                columns = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance"])
        hits = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, item_id long, distance long")
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long") if found is None else found


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids): one row for each row of ``docs``; one pass for each block of items, no shuffle."""
    ready(docs.sparkSession)
    out = docs.select("doc_id", "text", F.array().cast("array<bigint>").alias("item_ids"), F.lit(False).alias("unnamed"))
    for block in item_blocks(items):
        def work(batches, block=block):
            finder = Finder(block)
            for batch in batches:
                ids, unnamed = batch.column("item_ids").to_pylist(), batch.column("unnamed").to_pylist()
                for i, text in enumerate(batch.column("text").to_pylist()):
                    found = {finder.items[k][0] for k in finder.find(text)}
                    unnamed[i] |= None in found
                    ids[i] = sorted({*ids[i], *found} - {None})
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(unnamed, pa.bool_())],
                                      names=["doc_id", "text", "item_ids", "unnamed"])
        out = out.mapInArrow(work, out.schema)
    n_items = (F.size("item_ids") + F.col("unnamed").cast("int")).cast("long")
    return out.select("doc_id", (n_items > 0).alias("contaminated"), n_items.alias("n_items"), "item_ids")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns: one pass for each block of items, no shuffle."""
    ready(docs.sparkSession)
    for block in item_blocks(items):
        place = docs.columns.index("text")

        def work(batches, block=block, place=place):
            finder = Finder(block)
            for batch in batches:
                clean = [not finder.find(text) for text in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(np.array(clean, dtype=bool)))
        docs = docs.mapInArrow(work, docs.schema)
    return docs
