"""Repeated byte strings by a range-partitioned suffix sort (operator 1).

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id is removed. The bytes
are the whole UTF-8 texts; matches never cross documents.

1. Suffixes are entered at anchors. Each LENGTH-byte window has one: the position in it whose GRAM leading bytes hash
   lowest (the leftmost of equals). Equal windows have equal anchors, so the windows of one anchor, some 18 on average, travel as
   one context: the text from the first window's start to the last window's end.
2. Leading tokens first: an anchor whose GRAM bytes occur in no other document cannot match and leaves. Blocks of documents exchange
   packed hashes for this; a hash collision only keeps an anchor too much.
3. In a block equal contexts are combined: later documents lose them at once, one context goes on.
4. The others are ranged over buckets by splitters of the suffix at the anchor (its bytes, then the bytes before it, backwards), sampled
   from at most SAMPLE_CONTEXTS contexts of each of about SAMPLE_DOCS documents; the sample decides only how even the buckets are.
   In its bucket, each window of a context is sorted by multikey quicksort, eight bytes a time, and runs of equal windows give the
   earliest document. A token of a third of all documents spreads over buckets.
5. Across boundaries: suffixes in two buckets share only what they share with the outermost suffix of their bucket. Contexts with a
   window in that part are ranged once more, by the bytes before the anchor first; windows that also reach a boundary of
   this second order (they lie in text shared by very many documents) are compared by one more grouping of their 128-bit hashes, packed by
   ranges of the hash.

Null and empty texts have no bytes and lose none. Rows of one doc_id must hold one text and lose the same bytes. Rows
without doc_id are compared with nothing and keep all bytes. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.blocks import KEY_BITS, PACKED, in_blocks, is_in, packed_keys, received, shared_keys, table_batches
from editwarden.llm.frames import parts, ready
from editwarden.llm.texts import U64, batch_bytes, merged, mix, pack, unpack

LENGTH = 50
GRAM = 24
PIECE = 1 << 17  # windows handled at once
AT_ONCE = 1 << 20  # bytes of a slice of a block
SAMPLE_DOCS = 2000
SAMPLE_CONTEXTS = 50
_PLACE_BITS = 24


def leading_words(data):
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = data
    out = np.empty(n + 8, dtype=U64)
    for k in range(8):
        many = len(range(k, n + 8, 8))
        out[k::8] = padded[k:k + 8 * many].view(">u8")
    return out[:n]


def _anchors_of_piece(data, firsts, lasts, length):
    """Contexts of windows that start in [firsts, lasts): (anchor, first window, last window, key) as positions in ``data``."""
    n = len(data)
    words = leading_words(data)
    hashes = np.zeros(n, dtype=U64)
    for back in range(GRAM - 8, -1, -8):
        hashes[:max(0, n - back)] ^= words[back:]
        hashes = mix(hashes, 31 + back)
    low = (hashes >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | np.arange(n, dtype=U64)
    wide, span = length - GRAM + 1, 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, firsts, 1)
    np.add.at(change, lasts, -1)
    starts = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    anchor = (low[starts] & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    last = np.append(new[1:], True) if len(new) else new
    return anchor[new], starts[new], starts[last], hashes[anchor[new]] >> U64(64 - KEY_BITS)


def anchors(data, offsets, length):
    """(row, anchor, first window, last window, key) of a batch; positions count in ``data``."""
    pieces, firsts, lasts, filled = [], [], [], 0
    out = []

    def flush():
        if pieces:
            base = pieces[0]
            a, p, q, k = _anchors_of_piece(data[base:pieces[-1]], np.array(firsts) - base, np.array(lasts) - base, length)
            out.append((a + base, p + base, q + base, k))
            pieces.clear(), firsts.clear(), lasts.clear()

    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        windows = end - begin - length + 1
        for low in range(begin, begin + max(0, windows), PIECE):
            high = min(low + PIECE, begin + windows)
            if pieces and high + length - pieces[0] > 2 * PIECE:
                flush()
            pieces += [low] if not pieces else []
            firsts.append(low), lasts.append(high)
            pieces[1:] = [high + length - 1]
    flush()
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, U64))
    a, p, q, k = (np.concatenate(c) for c in zip(*out))
    return np.searchsorted(offsets, p, side="right") - 1, a, p, q, k


def equal_runs(words, starts, length):
    """Multikey quicksort of the ``length`` bytes from each start: (members in order, first member of each run of two or more).

    Each pass orders the runs left open by the next eight bytes; members alone in their run leave."""
    members = np.arange(len(starts))
    run = np.zeros(len(starts), dtype=np.int64)
    for depth in range(0, length, 8):
        if len(members) == 0:
            break
        at = starts[members] + depth
        key = words[at]
        if length - depth < 8:
            key = key >> U64(8 * (8 - (length - depth)))
        order = np.argsort(key)  # numpy's quicksort
        order = order[np.argsort(run[order], kind="stable")]
        members, run, key = members[order], run[order], key[order]
        new = np.ones(len(members), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        alone = new & np.append(new[1:], True)
        members, run = members[~alone], np.cumsum(new)[~alone]
    new = np.ones(len(members), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    return members, np.flatnonzero(new)


class _Slice:
    def __init__(self, part: pa.Table, length):
        self.doc = part.column("doc_id").to_numpy()
        self.data, self.offsets = batch_bytes(part.column("text"))
        self.row, self.anchor, self.first, self.last, self.key = anchors(self.data, self.offsets, length)


# a context: the bytes from the anchor on, those before it backwards, its places in one document, the bytes shared with a boundary
_SHIPPED = "block int, right binary, left binary, doc_id long, starts binary, reach int, n int, spans binary, bucket int"
_EDGES = ("block int, n int, spans binary, bucket int, home array<int>, right array<binary>, left array<binary>, doc_id array<long>, "
          "starts array<binary>, reach array<int>")
# packed spans of a block, or packed windows (hash, document, block, start) of a range of hashes
_FOUND = "block int, n int, spans binary, windows binary"
WINDOWS_AT_ONCE = 400_000


def _span_row(block, docs, starts, ends):
    """Packed spans of one block, merged for each document."""
    wide = 1 << 40  # texts are shorter; spans of documents never touch
    order, number = np.unique(docs, return_inverse=True)
    low, high = merged(number * wide + starts, number * wide + ends)
    return len(low), pack(order[low // wide].view(np.int64), low % wide, high - low)


def _spans(table):
    """(doc, start, end) arrays of the packed rows of a table."""
    out = [[np.zeros(0, np.int64)] * 3]
    for n, blob in zip(table.column("n").to_pylist(), table.column("spans").to_pylist()):
        if blob is not None and n:
            doc, start, size = (c.view(np.int64) for c in unpack(blob, n, 3))
            out.append([doc, start, start + size])
    return [np.concatenate(c) for c in zip(*out)]


def _splitters(docs: DataFrame, length: int, buckets: int) -> tuple[list, list]:
    """Up to ``buckets`` - 1 suffixes that cut a sample of all contexts into even parts: as (right, left) and as (left, right)."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1_000_000_007)) / 1_000_000_007
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (draw < share))

    def work(batches):
        for batch in batches:
            for part in table_batches(pa.Table.from_batches([batch]), AT_ONCE):
                found = _Slice(part, length)
                order = np.lexsort((found.key, found.row))
                row = found.row[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                raw = found.data.tobytes()
                chosen = order[place < SAMPLE_CONTEXTS].tolist()
                yield pa.record_batch([pa.array([raw[found.anchor[i]:found.last[i] + length] for i in chosen], pa.binary()),
                                       pa.array([raw[found.first[i]:found.anchor[i]][::-1] for i in chosen], pa.binary())], names=["right", "left"])

    got = some.mapInArrow(work, "right binary, left binary").toArrow()
    right, left = (got.column(c).to_pylist() for c in ("right", "left"))
    orders = (sorted(set(zip(*sides))) for sides in ((right, left), (left, right)))
    return tuple([rows[len(rows) * k // buckets] for k in range(1, buckets)] if rows else [] for rows in orders)


def without_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the removed runs as (first, last) byte and the bytes that are left."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM} bytes")
    buckets = parts(ready(docs.sparkSession))
    key_buckets = max(1, buckets // 2)
    ranges = max(16, 4 * isqrt(buckets))
    splitters, second = _splitters(docs, length, 2 * buckets)  # a hash deals the buckets to partitions: more of them are dealt more evenly
    dealt = in_blocks(docs)

    def anchor_keys(key, table):
        found = [_Slice(part, length).key for part in table_batches(table, AT_ONCE)]
        return packed_keys(key[0].as_py(), np.unique(np.concatenate(found)) if found else np.zeros(0, U64), key_buckets)

    known = shared_keys(dealt.groupBy("block").applyInArrow(anchor_keys, PACKED))

    def contexts(key, table, answers):
        block, known = key[0].as_py(), received(answers)
        slices = [_Slice(part, length) for part in table_batches(table, AT_ONCE)]
        keys = np.concatenate([s.key for s in slices]) if slices else np.zeros(0, U64)
        owner = np.concatenate([s.doc[s.row] for s in slices]) if slices else np.zeros(0, np.int64)
        order = np.lexsort((owner, keys))
        hit = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] != owner[order][:-1])
        local = np.unique(keys[order][1:][hit])
        seen: dict[bytes, tuple] = {}
        gone = ([], [], [])

        def lose(doc, starts, many):
            gone[0].extend([doc] * len(starts))
            gone[1].extend(starts)
            gone[2].extend(p + many for p in starts)

        for s in slices:
            take = np.flatnonzero(is_in(s.key, known) | is_in(s.key, local))
            begin = s.offsets[s.row[take]]
            raw = s.data.tobytes()
            for doc, p, q, a, b, k in zip(s.doc[s.row[take]].tolist(), s.first[take].tolist(), (s.last[take] + length).tolist(),
                                          s.anchor[take].tolist(), begin.tolist(), s.key[take].tolist()):
                text = raw[p:q]
                old = seen.get(text)
                if old is None or doc < old[0]:
                    if old is not None:
                        lose(old[0], old[3], q - p)
                    seen[text] = (doc, a - p, k, [p - b])
                elif doc > old[0]:
                    lose(doc, [p - b], q - p)
                else:
                    old[3].append(p - b)
        del slices, keys, owner
        each: dict[int, int] = {}
        for row in seen.values():
            each[row[2]] = each.get(row[2], 0) + 1
        elsewhere = is_in(np.array([r[2] for r in seen.values()], dtype=U64), known)
        out = []
        for (text, (doc, at, k, starts)), e in zip(seen.items(), elsewhere.tolist()):
            if e or each[k] > 1:
                right, left = text[at:], text[at - 1::-1] if at else b""
                places = starts[0].to_bytes(8, "little") if len(starts) == 1 else np.array(starts, dtype=np.int64).tobytes()
                out.append((right, left, doc, places, None, None, bisect_right(splitters, (right, left))))
        if gone[0]:
            n, spans = _span_row(block, *(np.array(g, dtype=np.int64) for g in gone))
            out.append((None, None, None, None, n, spans, block % (2 * buckets)))  # rows of spans only pass through
        out.sort(key=lambda r: (r[6], r[0] or b""))  # neighbours begin alike, which compresses well
        return _shipped(block, out)

    shipped = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(contexts, _SHIPPED)
    edges = shipped.repartition(buckets, "bucket").mapInArrow(lambda b: _buckets(b, length, second), _EDGES)
    found = edges.repartition(buckets, "bucket").mapInArrow(lambda b: _second_buckets(b, length, ranges), _FOUND).repartition(buckets, "block")

    def windows_only(batches):
        for batch in batches:
            yield batch.filter(pa.compute.is_valid(batch.column("windows"))).select(["block", "n", "windows"])

    def later(key, table):
        """The windows of a range of hashes that an earlier document has, too, as spans of their blocks."""
        columns = [unpack(w, n, 5) for n, w in zip(table.column("n").to_pylist(), table.column("windows").to_pylist())]
        h1, h2, doc, block, start = (np.concatenate(c) for c in zip(*columns))
        doc, block, start = doc.view(np.int64), block.view(np.int64), start.view(np.int64)
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, block, start = h1[order], h2[order], doc[order], block[order], start[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        late = doc > np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(h1))))
        return _found([(int(b), *_span_row(b, doc[mine], start[mine], start[mine] + length)) for b in np.unique(block[late]) for mine in [late & (block == b)]])

    # read by a Python step on purpose: a filter would be moved before the shuffle, which then could not be shared
    windows = found.mapInArrow(windows_only, "block int, n int, windows binary")
    both = found.union(windows.groupBy("block").applyInArrow(later, _FOUND))

    def remove(key, table, answers):
        doc, low, high = _spans(answers)
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], low[order], high[order]
        out = []
        ids = table.column("doc_id").to_numpy()
        cuts = zip(np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right"))
        for one, text, (i, j) in zip(ids.tolist(), table.column("text"), cuts):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            starts, ends = merged(low[i:j], high[i:j])
            at, kept = 0, []
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((one, len(raw), int((ends - starts).sum()), [{"first": a, "last": b - 1} for a, b in zip(starts.tolist(), ends.tolist())], b"".join(kept)))
        columns = list(zip(*out)) if out else [()] * 5
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))],
                        names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    out = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")
    text = F.coalesce("text", F.lit(""))
    return out.union(docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long"), F.octet_length(text).cast("long"), F.lit(0).cast("long"), F.array().cast(out.schema["spans"].dataType), text.cast("binary")))


def _buckets(batches, length, splitters):
    """The buckets of a partition, one after the other."""
    table = pa.Table.from_batches(list(batches), schema=_SCHEMA)
    bucket = table.column("bucket").to_numpy()
    for b in np.unique(bucket):
        yield from _bucket(table.filter(pa.array(bucket == b)), length, splitters=splitters)


def _second_buckets(batches, length, ranges):
    """The buckets of the second order, unpacked one after the other; rows of spans pass."""
    table = pa.Table.from_batches(list(batches), schema=_EDGE_SCHEMA)
    full = pa.compute.is_valid(table.column("spans"))
    passed = table.filter(full)
    if passed.num_rows:
        yield _found(list(zip(*(passed.column(c).to_pylist() for c in ("block", "n", "spans"))))).combine_chunks().to_batches()[0]
    table = table.filter(pa.compute.invert(full))
    bucket = table.column("bucket").to_numpy()
    for b in np.unique(bucket):
        part = table.filter(pa.array(bucket == b))
        flat = [pa.compute.list_flatten(part.column(c)) for c in ("home", "right", "left", "doc_id", "starts", "reach")]
        many = len(flat[0])
        yield from _bucket(pa.table([*flat, *(pa.nulls(many, _SCHEMA.field(c).type) for c in ("n", "spans", "bucket"))], schema=_SCHEMA), length, ranges)


def _bucket(table, length, ranges=None, splitters=()):
    """One bucket of contexts in the first order (by what follows the anchor) or, with ``ranges``, in the second (by what goes before it).

    Yields packed spans and, of the contexts with a window that may also be in another bucket, the contexts, packed by the
    ``splitters`` of the second order (first order), or the windows, packed by ranges of their hash (second order)."""
    second = ranges is not None
    give = _found if second else _edge_spans
    full = pa.compute.is_valid(table.column("spans"))
    passed = table.filter(full)
    if passed.num_rows:
        yield give(list(zip(*(passed.column(c).to_pylist() for c in ("block", "n", "spans"))))).to_batches()[0]
    table = table.filter(pa.compute.invert(full)).combine_chunks()
    if not table.num_rows:
        return
    # equal contexts: the earliest document keeps one, later documents lose theirs
    code = pa.compute.binary_join_element_wise(table.column("right"), table.column("left"), b"").combine_chunks().dictionary_encode().indices.to_numpy()
    _, same = np.unique(code * 4096 + pa.compute.binary_length(table.column("right")).to_numpy(), return_inverse=True)
    docs = table.column("doc_id").to_numpy()
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, docs)
    early = docs == least[same]
    late = np.flatnonzero(~early)
    sizes = (pa.compute.binary_length(table.column("right")).to_numpy() + pa.compute.binary_length(table.column("left")).to_numpy())[late]
    block, places = table.column("block").to_numpy(), table.column("starts")
    gone = [(late, np.zeros(len(late), np.int64), sizes)]
    mine = np.flatnonzero(early)
    right, left = (table.column(c).take(pa.array(mine)).to_pylist() for c in ("right", "left"))
    doc, kept_block, reach = docs[mine].tolist(), block[mine].tolist(), table.column("reach").take(pa.array(mine)).to_pylist()
    gram = [r[:GRAM] for r in right]
    kept = sorted(range(len(mine)), key=gram.__getitem__)
    late_windows = set()
    group: list[int] = []
    many = 0
    for k, i in enumerate(kept):
        # all contexts of a leading token together; several tokens at once
        group.append(i)
        many += len(right[i]) + len(left[i]) - length + 1
        if k + 1 == len(kept) or many >= WINDOWS_AT_ONCE and gram[kept[k + 1]] != gram[i]:
            found = list(_late(group, right, left, doc, length))
            if found:
                rows, low = (np.array(c, dtype=np.int64) for c in zip(*found))
                gone.append((mine[rows], low, low + length))
                if second:
                    late_windows.update(found)
            group, many = [], 0
    rows, low, high = (np.concatenate(c) for c in zip(*gone))
    if len(rows):
        raw = places.take(pa.array(rows))
        counts = pa.compute.binary_length(raw).to_numpy() // 8
        shift = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.int64)
        rows, low, high = np.repeat(rows, counts), np.repeat(low, counts) + shift, np.repeat(high, counts) + shift
        order = np.argsort(block[rows], kind="stable")
        rows, low, high = rows[order], low[order], high[order]
        cuts = [0, *(np.flatnonzero(np.diff(block[rows])) + 1).tolist(), len(rows)]
        out = [(int(block[rows[a]]), *_span_row(0, docs[rows[a:b]], low[a:b], high[a:b])) for a, b in zip(cuts, cuts[1:])]
        yield give(out).to_batches()[0]
    main = left if second else right
    ends = (min(main), max(main))
    end_grams = {end[:GRAM] for end in ends}
    out = []
    for i in kept:
        before = len(left[i])
        if not second:
            # the first window has the fewest bytes after the anchor, GRAM at least
            if gram[i] in end_grams and length - before <= (shared := max(_common(right[i], end) for end in ends)):
                out.append((right[i], left[i], doc[i], places[mine[i]].as_py(), shared, kept_block[i]))
            continue
        shared = max(_common(main[i], end) for end in ends)
        text = left[i][::-1] + right[i]
        for p in range(len(text) - length + 1):
            if length - (before - p) <= reach[i] and before - p <= shared and (i, p) not in late_windows:
                out.append((i, p, xxhash.xxh3_128_intdigest(text[p:p + length])))
    if not second:
        packs: dict[int, list] = {}
        for row in out:
            packs.setdefault(bisect_right(splitters, (row[1], row[0])), []).append(row)
        if packs:
            yield _edge_contexts(packs).to_batches()[0]
    elif out:
        yield _packed_windows(out, [np.frombuffer(places[mine[i]].as_py(), dtype=np.int64) for i, _, _ in out], doc, kept_block, ranges).to_batches()[0]


def _packed_windows(windows, starts, doc, block, ranges):
    """Rows (range of hashes, n, packed windows) of boundary windows (context, place, hash)."""
    counts = [len(s) for s in starts]
    hashes = np.array([[h >> 64, h & 0xFFFFFFFFFFFFFFFF] for _, _, h in windows], dtype=U64).repeat(counts, axis=0)
    owner = np.repeat(np.array([doc[i] for i, _, _ in windows], dtype=np.int64), counts)
    home = np.repeat(np.array([block[i] for i, _, _ in windows], dtype=np.int64), counts)
    start = np.concatenate(starts) + np.repeat(np.array([p for _, p, _ in windows], dtype=np.int64), counts)
    order = np.argsort(hashes[:, 0], kind="stable")
    h1, h2, owner, home, start = hashes[order, 0], hashes[order, 1], owner[order], home[order], start[order]
    part = ((h1 >> U64(40)) * U64(ranges)) >> U64(24)
    cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=U64))
    rows = [(r, int(b - a), None, pack(h1[a:b], h2[a:b], owner[a:b], home[a:b], start[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return _found(rows)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    if a[:GRAM] != b[:GRAM]:
        a, b = a[:GRAM], b[:GRAM]
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _late(group, right, left, doc, length):
    """(context, place) of the windows that an earlier document of the group has, too."""
    if len(group) < 2:
        return
    texts = [left[i][::-1] + right[i] for i in group]
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    many = sizes - length + 1
    of = np.repeat(np.arange(len(group)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner = np.array([doc[i] for i in group])[of]
    flat = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    members, first = equal_runs(leading_words(flat), begins[of] + place, length)
    if len(members):
        least = np.repeat(np.minimum.reduceat(owner[members], first), np.diff(np.append(first, len(members))))
        for m in members[owner[members] > least].tolist():
            yield group[of[m]], int(place[m])


_SCHEMA = pa.schema([("block", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("starts", pa.binary()),
                     ("reach", pa.int32()), ("n", pa.int32()), ("spans", pa.binary()), ("bucket", pa.int32())])


_EDGE_SCHEMA = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("spans", pa.binary()), ("bucket", pa.int32()), ("home", pa.list_(pa.int32())),
                          ("right", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())),
                          ("starts", pa.list_(pa.binary())), ("reach", pa.list_(pa.int32()))])


def _edge_spans(rows):
    """Rows of spans (block, n, spans); their block deals them out."""
    block, n, spans = zip(*rows)
    columns = [pa.array(c, f.type) for c, f in zip((block, n, spans, block), _EDGE_SCHEMA)]
    return pa.table(columns + [pa.nulls(len(rows), f.type) for f in list(_EDGE_SCHEMA)[4:]], schema=_EDGE_SCHEMA)


def _edge_contexts(packs):
    """One row for each bucket of the second order, with the lists of its contexts (right, left, document, places, reach, block)."""
    lists = [[list(c) for c in zip(*rows)] for rows in packs.values()]
    columns = [pa.nulls(len(packs), f.type) for f in list(_EDGE_SCHEMA)[:3]] + [pa.array(list(packs), pa.int32())]
    columns += [pa.array([p[k] for p in lists], f.type) for k, f in zip((5, 0, 1, 2, 3, 4), list(_EDGE_SCHEMA)[4:])]
    return pa.table(columns, schema=_EDGE_SCHEMA)


def _shipped(block, rows):
    columns = list(zip(*rows)) if rows else [()] * 7
    return _passed([block] * len(columns[0]), *columns[:4], None, *columns[4:])


def _passed(block, right=None, left=None, doc_id=None, starts=None, reach=None, n=None, spans=None, bucket=None):
    columns = (block, right, left, doc_id, starts, reach, n, spans, bucket)
    return pa.table([pa.nulls(len(block), f.type) if c is None else pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _found(rows):
    """Rows (block, n, spans) or (range, n, None, windows)."""
    columns = list(zip(*((*r, None)[:4] for r in rows))) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "n", "spans", "windows"])
