"""Keys that repeat across blocks of documents.

Documents are dealt into blocks by a hash of their id; each block is a bounded share of the corpus whatever key is
hot. A block ships every distinct key once, packed with its bucket's other keys; a bucket merges
the blocks' keys and returns to each block what it needs to know. A key held by a third of all documents is one entry
per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import parts
from editwarden.llm.texts import U64, batch_bytes, pack, unpack

BLOCKS_PER_PARTITION = 2
KEY_BITS = 48
PACKED = "block int, bucket int, n int, keys binary"


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text) of the documents with an id, dealt by block. Used again, this is one shuffle."""
    n = parts(docs.sparkSession)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n * BLOCKS_PER_PARTITION)).cast("int").alias("block")
    return docs.where("doc_id IS NOT NULL").select(block, "doc_id", "text").repartition(n, "block")


def table_batches(table: pa.Table, size: int = 4 << 20):
    """Slices of a block's table with about ``size`` bytes of text each."""
    table = table.combine_chunks()
    groups = batch_bytes(table.column("text"))[1][1:] // size
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), table.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield table.slice(a, b - a)


def packed_keys(block: int, keys, buckets: int, *more, bits: int = KEY_BITS) -> pa.Table:
    """Rows (block, bucket, n, keys): sorted keys of ``bits`` bits by range into buckets, packed with the columns ``more``."""
    bucket = ((keys >> U64(bits - 24)) * U64(buckets)) >> U64(24)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
    rows = [(block, b, int(j - i), pack(keys[i:j], *(m[i:j] for m in more))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
                    names=["block", "bucket", "n", "keys"])


def _answers(owner, keys):
    order = np.argsort(owner, kind="stable")
    owner, keys = owner[order], keys[order]
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    rows = [(int(owner[i]), int(j - i), pack(keys[i:j])) for i, j in zip(cuts, cuts[1:]) if j > i]
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["block", "n", "keys"])


def _gather(table, width):
    blobs = list(zip(table.column("block").to_pylist(), table.column("n").to_pylist(), table.column("keys").to_pylist()))
    owner = np.repeat(np.array([b for b, _, _ in blobs], dtype=np.int64), [n for _, n, _ in blobs])
    columns = [unpack(k, n, width) for _, n, k in blobs]
    return owner, [np.concatenate([c[w] for c in columns]) for w in range(width)]


def shared_keys(packed: DataFrame) -> DataFrame:
    """(block, n, keys): for each block its keys that another block holds too."""
    def merge(key, table):
        owner, (keys,) = _gather(table, 1)
        order = np.argsort(keys, kind="stable")
        owner, keys = owner[order], keys[order]
        same = keys[1:] == keys[:-1]
        many = np.append(same, False) | np.insert(same, 0, False)
        # stable: within a block the keys stay sorted
        return _answers(owner[many], keys[many])

    return packed.groupBy("bucket").applyInArrow(merge, "block int, n int, keys binary")


def later_keys(packed: DataFrame) -> DataFrame:
    """(block, n, keys): for each block its keys of which another block holds an earlier document.

    Packed are (key, second key, document); of the answer only the first key is needed, the block knows the rest."""
    def merge(key, table):
        owner, (keys, second, doc) = _gather(table, 3)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, second, keys))
        owner, keys, second, doc = owner[order], keys[order], second[order], doc[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])
        first = np.flatnonzero(new)
        least = np.repeat(doc[first], np.diff(np.append(first, len(keys))))
        late = doc > least
        return _answers(owner[late], keys[late])

    return packed.groupBy("bucket").applyInArrow(merge, "block int, n int, keys binary")


def received(table: pa.Table):
    """The sorted keys that came back to a block."""
    found = [unpack(k, n)[0] for n, k in zip(table.column("n").to_pylist(), table.column("keys").to_pylist())]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=U64)


def is_in(values, ordered):
    """Which values are in the sorted array."""
    if len(ordered) == 0:
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
