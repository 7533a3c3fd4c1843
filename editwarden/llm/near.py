"""Near-duplicates by chosen-path similarity join over word shingles (operator 8).

Documents with the same shingle set are one class from the start. Each of TREES independent trees puts
a class into the node of its minwise shingle; two sets with Jaccard similarity s meet in one tree with
probability s, so 10 trees miss a link at 0.8 with probability 0.2 ** 10 = 1e-7. Nodes up to SMALL
are compared exhaustively. A larger node is first compared with one pivot (its smallest class). Then its members
branch by CHILDREN further minwise shingles each, drawn anew for each tree and level, and nodes whose members are
known to be connected already are finished, as no pair of them can change a component. Branching does not part members that are
nearly alike: where half of a node or more is connected, the members outside are compared with all at once. What is still large and not
connected after LEVELS branchings is compared exhaustively in packs, so no link is dropped for size. A pair at 0.8 whose nodes stay large through all
levels is missed with probability 0.247 ** 10 = 1e-6. Links are confirmed on the full shingle sets, in integers.

Members of large nodes carry the number of their shingles that no other such member has. This bounds what two of them can share: pairs and
members that cannot reach the threshold leave, though their minwise values are alike. The member with the fewest such shingles is the pivot.

Each level is three written tables (nodes, pairs, links); links of a task are reduced to a spanning forest before they are
written. Components of up to LINKS_AT_ONCE links, which are counted, are found without a shuffle; of more links by steps of joins. Of all
links found so far a level passes on one for each linked document, to the least of its component. The rows of a step are counted or bounded first, and a step of few rows is written
by as many tasks as there are cores, not by one for each shuffle partition. Rows that are the work of one task are grouped in one partition,
without a shuffle, and few rows are broadcast to the sets. The texts are shuffled only where a doc_id is repeated or the documents to compare are too many to be broadcast.

Null or empty texts have no shingles, link with nothing and stay. Ties and repeated rows: the smallest
doc_id stands for a class. Rows without doc_id link with nothing, have no component_id and are kept. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import batches_of, ready, stored
from editwarden.llm.texts import U64, batch_bytes, lowered, mix, sequence_hashes, span_hashes, word_bounds

TREES = 10
SMALL = 24
CHILDREN = 2
LEVELS = 3
SIGNATURE = 3 * TREES  # minwise values kept per class: a root for each tree, all of them to see whether a pair can link
BRANCHES = TREES * LEVELS * CHILDREN  # further ones of the members of large nodes: each tree and level has its own
HASH_BYTES = 6  # of a shingle when sets are compared
PACK_BYTES = 1 << 18  # of sets that are compared at once in a crowd
BROADCAST_IDS = 1_000_000  # most ids that are broadcast to filter the sets
BROADCAST_ROWS = 250_000  # most rows of two numbers that are broadcast to a join
LINKS_AT_ONCE = 1_000_000  # most links that one task reduces to a forest
ROWS_A_TASK = 20_000  # rows of a step that are worth a task and a file of their own
PAIRS_A_TASK = 2_000  # the same for pairs that are confirmed on their sets
PACKS_A_TASK = 8  # the same for pairs of packs
PAIRS_AT_ONCE = 16  # pairs of packs in a batch
VOCABULARY = 4096  # shingles of two packs that are held as columns at once
SIZE_BINS = 1.005  # ratio of neighbouring classes of set sizes


def shingle_sets(data, offsets, shingle):
    """For each document its sorted distinct shingle hashes (fewer words: the whole sequence as one)."""
    data = lowered(data)
    starts, ends, counts = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = sequence_hashes(hashes, shingle)
    first = 0
    for count in counts.tolist():
        if count >= shingle:
            yield np.unique(runs[first:first + count - shingle + 1])
        elif count:
            # another seed for each length, so that a short text never equals a shingle
            yield sequence_hashes(hashes[first:first + count], count, seed=100 + count)
        else:
            yield np.zeros(0, dtype=U64)
        first += count


def _seeds(count):
    return [mix(np.arange(1, 2, dtype=U64), 1000 + k)[0] | U64(1) for k in range(count)]


def _minwise(flat, at, seeds):
    """32 bits of the minwise values of sets that begin at ``at`` in ``flat``, a column for each seed."""
    out = np.zeros((len(at), len(seeds)), dtype=np.uint32)
    for k, seed in enumerate(seeds):
        values = flat * seed
        values ^= values >> U64(32)
        out[:, k] = np.minimum.reduceat(values * seed, at) >> U64(4)
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, 128-bit digest of the set, 32 bits of each minwise value."""
    seeds = _seeds(SIGNATURE)

    def work(batches):
        for batch in batches:
            sets = list(shingle_sets(*batch_bytes(batch.column("text")), shingle))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            d1, d2 = np.zeros(len(sets), dtype=U64), np.zeros(len(sets), dtype=U64)
            sig = np.zeros((len(full), SIGNATURE), dtype=np.uint32)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                d1[full], d2[full] = np.add.reduceat(mix(flat, 21), at), np.add.reduceat(mix(flat, 22), at)
                sig = _minwise(flat, at, seeds)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, SIGNATURE, 0))]).astype(np.int32)
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1).view(np.int32)))],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, elements, branches): the sorted distinct shingles of each document, HASH_BYTES each, as one value, and its further minwise values.

    The documents have shingles."""
    seeds = _seeds(SIGNATURE + BRANCHES)[SIGNATURE:]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(shingle_sets(*batch_bytes(batch.column("text")), shingle))
            values = [np.sort(s >> U64(64 - 8 * HASH_BYTES)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes() for s in sets]
            ends = np.cumsum([len(s) for s in sets])
            branches = _minwise(np.concatenate(sets), np.concatenate([[0], ends[:-1]]), seeds)
            rows = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BRANCHES)
            yield pa.record_batch([batch.column("doc_id"), pa.array(values, pa.binary()), pa.ListArray.from_arrays(rows, pa.array(branches.reshape(-1).view(np.int32)))],
                                  names=["doc_id", "elements", "branches"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, elements binary, branches array<int>")


def _elements(blob):
    out = np.zeros((len(blob) // HASH_BYTES, 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return out.view(U64).reshape(-1)


def _forest(a, b):
    """(member, root) of the members of linked groups that are not the smallest of their group."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _tasks(rows: DataFrame, many: int, each: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` of a step that reads ``many`` rows, in no more partitions than these are worth, but in one for each core at least.

    Partitions are merged without a shuffle; their number only falls."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(cores, -(-many // each)))


def _together(rows: DataFrame, many: int) -> DataFrame:
    """``rows`` of a written table that has ``many``: in one partition where these are the work of one task, so that no grouping of them shuffles."""
    return rows.coalesce(1) if many <= ROWS_A_TASK else rows


def confirmed(pairs: DataFrame, many: int, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what those of the ``many`` pairs connect whose full sets have 100 * intersection >= percent * union."""
    def work(batches):
        held = (None, None)
        links = [np.zeros((2, 0), dtype=np.int64)]
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                if held[0] != a[i]:
                    held = (a[i], _elements(x.as_buffer()))
                mine, other = held[1], _elements(y.as_buffer())
                both = len(mine) + len(other) - len(np.unique(np.concatenate([mine, other])))
                keep[i] = 100 * both >= percent * (len(mine) + len(other) - both)
            links.append(np.stack([a[keep], b[keep]]))
        member, root = _forest(*np.concatenate(links, axis=1))
        yield pa.record_batch([pa.array(root), pa.array(member)], names=["a", "b"])

    full = sets.select("doc_id", "elements")
    if many <= BROADCAST_ROWS:
        # few pairs go to the sets of their second members, so that only what they meet is shuffled
        some, pairs = _only(full, pairs.select(F.col("a").alias("doc_id")), many), F.broadcast(pairs)
    else:
        some = full = _only(full, _ends(pairs), 2 * many)
    x = some.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    y = full.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return _tasks(both, many, PAIRS_A_TASK).mapInArrow(work, "a long, b long")


def _only(sets: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The sets of the documents ``ids`` (doc_id, may repeat), at most ``most``: a filter in the scan while the ids are few enough to be broadcast.

    They are made distinct and counted only where ``most`` does not tell already that they are few."""
    ids = ids if most <= BROADCAST_ROWS else ids.distinct()
    few = most <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _few(rows: DataFrame, many: int | None = None) -> DataFrame:
    """A written table of ``many`` rows (counted if not given), broadcast in joins where it is small: the rows it is joined to are not shuffled."""
    return F.broadcast(rows) if (rows.count() if many is None else many) <= BROADCAST_ROWS else rows


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))


def unique_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, unique): how many shingles of a document no other of these documents has; documents without one are left out."""
    def work(batches):
        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("elements")):
                values = _elements(blob.as_buffer()).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(values), doc, np.int64)), pa.array(values)], names=["doc_id", "shingle"])

    each = sets.select("doc_id", "elements").mapInArrow(work, "doc_id long, shingle long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("unique"))


def _can_link(p, q, percent):
    """Whether two members (doc_id, label, n_shingles, unique, sig) can link: other labels, enough shingles that others have, too,
    sizes alike, more than a quarter of the minwise values alike.

    Of SIGNATURE values a pair at 0.8 shares a quarter or less with probability below 1e-12."""
    most = F.least(*[m["n_shingles"] - m["unique"] for m in (p, q)], p["n_shingles"], q["n_shingles"])
    reach = 100 * most >= percent * (p["n_shingles"] + q["n_shingles"] - most)
    alike = reduce(add, [(F.get(p["sig"], i) == F.get(q["sig"], i)).cast("int") for i in range(SIGNATURE)])
    return (p["label"] != q["label"]) & reach & (4 * alike > SIGNATURE)


def _size_class(size):
    return F.floor(F.log(size.cast("double")) / float(np.log(SIZE_BINS))).cast("int")


def _that_can_link(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, tree, m) without members that no member of their node is of the right size to link with.

    With at most ``most`` shingles shared, the other set has from percent * n / 100 to most + 100 * most / percent - n shingles.
    Sizes of a node are kept as classes, some thousand at most."""
    sizes = rows.groupBy("key").agg(F.collect_set(_size_class(F.col("m.n_shingles"))).alias("classes"))
    n, most = F.col("m.n_shingles"), F.col("m.n_shingles") - F.col("m.unique")
    low = _size_class(F.greatest(n * percent / 100, F.lit(1)))
    high = _size_class(F.greatest(most + most * 100 / percent - n, F.lit(1)) + 1e-6)
    return rows.join(sizes, "key").where(F.exists("classes", lambda c: (c >= low) & (c <= high))).drop("classes")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (key, tree, m) of nodes whose members are not known to be connected, with the node's size and pivot."""
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min("m.label").alias("l1"), F.max("m.label").alias("l2"), F.min(F.struct("m.unique", "m")).alias("best")
    ).where("l1 <> l2").select("key", "size", F.col("best.m").alias("pivot"))  # a key belongs to one tree
    return rows.join(sizes, "key")


def _pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that can link: all pairs of small nodes, and each member of a large node with its pivot."""
    groups = nodes.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    left = groups.select("ms", F.posexplode("ms").alias("i", "p"))
    both = left.select("p", F.explode(F.slice("ms", F.col("i") + 2, SMALL)).alias("q"))
    star = nodes.where(F.col("size") > SMALL).select(F.col("pivot").alias("p"), F.col("m").alias("q"))
    return _ordered(both.union(star).where(_can_link(F.col("p"), F.col("q"), percent)))


def _ordered(pairs: DataFrame) -> DataFrame:
    a, b = F.col("p.doc_id"), F.col("q.doc_id")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _with_majority(rows: DataFrame) -> DataFrame:
    """Rows (key, tree, m) of unfinished nodes with size, the most frequent label of the node and the number of its members."""
    labels = rows.groupBy("key", F.col("m.label").alias("label")).agg(F.count("*").alias("n"))
    nodes = labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size")).where("most.n < size")
    return rows.join(nodes, "key").select("key", "tree", "m", "size", F.col("most.label").alias("major"), F.col("most.n").alias("major_size"))


def _shared(x, y):
    """The sizes of the intersections of each sorted set of x with each of y."""
    flat = [np.concatenate(v) for v in (x, y)]
    row = [np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for k in range(0, len(both), VOCABULARY):
        some = both[k:k + VOCABULARY]
        sides = []
        for values, rows, v in zip(flat, row, (x, y)):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            side = np.zeros((len(v), len(some)), dtype=np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _crowd_links(rows: DataFrame, many: int, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of whole crowds, of ``many`` rows: the members outside the largest connected part against all, pack by pack.

    Nodes whose largest part is the same one are a single crowd, so that a pair is met once and not in each tree. Packs hold
    about PACK_BYTES of sets; a pack of outsiders meets each pack of its crowd, and only links leave the comparison."""
    mostly = 2 * F.col("major_size") >= F.col("size")
    crowd = F.struct(F.when(mostly, F.lit(None)).otherwise(F.col("key")).alias("key"), "major")
    members = _together(rows, many).select(F.xxhash64(crowd).alias("crowd"), F.col("m.doc_id").alias("doc_id"), F.col("m.label").alias("label"),
                                           F.col("m.n_shingles").alias("n"), "major").dropDuplicates(["crowd", "doc_id"])
    members = stored(_tasks(members, many), "crowds")
    outside = F.col("label") != F.col("major")
    packs = lambda n: F.ceil(F.sum(n) * HASH_BYTES / PACK_BYTES).cast("long")
    sizes = _together(members, many).groupBy("crowd").agg(packs(F.col("n")).alias("packs"), packs(F.when(outside, F.col("n")).otherwise(0)).alias("outer"))
    sizes = stored(_tasks(sizes, many), "sizes")
    meetings = sizes.agg(F.sum(F.col("packs") * F.col("outer"))).first()[0]
    held = F.collect_list(F.struct("doc_id", "label", "elements"))
    some, wide = sets.select("doc_id", "elements"), 3 * many  # six numbers a row
    if wide > BROADCAST_ROWS:
        some = _only(some, members.select("doc_id"), many)
    full = _few(members.join(_few(sizes, wide), "crowd"), wide).join(some, "doc_id")
    every = full.groupBy("crowd", F.pmod(F.xxhash64("doc_id"), "packs").alias("pack")).agg(held.alias("y"))
    few = full.where(outside).groupBy("crowd", F.pmod(F.xxhash64("doc_id"), "outer").alias("number")).agg(held.alias("x"), F.first("packs").alias("packs"))
    few = few.select("crowd", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("pack"))

    def work(batches):
        links = [np.zeros((2, 0), dtype=np.int64)]
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                docs, labels = ([np.array([m[c] for m in side], dtype=np.int64) for side in (x, y)] for c in ("doc_id", "label"))
                values = [[_elements(m["elements"]) for m in side] for side in (x, y)]
                size = [np.array([len(v) for v in side]) for side in values]
                both = _shared(*values)
                linked = (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)) & (labels[0][:, None] != labels[1][None, :])
                i, j = np.nonzero(linked)
                links.append(np.stack([docs[0][i], docs[1][j]]))
        member, root = _forest(*np.concatenate(links, axis=1))
        yield pa.record_batch([pa.array(root), pa.array(member)], names=["a", "b"])

    return _tasks(few.join(every, ["crowd", "pack"]).select("x", "y"), meetings, PACKS_A_TASK).mapInArrow(work, "a long, b long")


def _followed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, label, next): the least label of the neighbours, then the label of that label: paths halve in each step."""
    near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
    low = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("low"))
    jump = labels.select(F.col("a").alias("low"), F.col("label").alias("far"))
    return low.join(jump, "low", "left").select("a", "label", F.least("low", "far").alias("next"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _first_labels(edges: DataFrame) -> DataFrame:
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    return _followed(edges, labels).select("a", F.col("next").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id): smallest doc_id reachable over the links (a, b), for documents with a link."""
    if links.count() <= LINKS_AT_ONCE:
        return stored(_components_at_once(links), "labels")
    edges = stored(_both_ways(links), "edges")
    labels = _first_labels(edges)
    while True:
        following = stored(_followed(edges, labels), "labels")
        labels = following.select("a", F.col("next").alias("label"))
        if following.where("label <> next").isEmpty():
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("component_id"))


def _components_at_once(links: DataFrame) -> DataFrame:
    def work(batches):
        some = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        if some:
            member, root = _forest(*[np.concatenate(side) for side in zip(*some)])
            roots = np.unique(root)
            yield pa.record_batch([pa.array(np.concatenate([member, roots])), pa.array(np.concatenate([root, roots]))], names=["doc_id", "component_id"])

    return links.coalesce(1).mapInArrow(work, "doc_id long, component_id long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    spark = ready(docs.sparkSession)
    sig = stored(signatures(docs, shingle), "signatures")
    named = ["d1", "d2", "n_shingles"]
    classes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*named).agg(F.min(F.struct("doc_id", "sig")).alias("c")).select(
        F.col("c.doc_id").alias("doc_id"), *named, F.col("c.sig").alias("sig"))
    copies = sig.groupBy("doc_id").agg(F.count("*").alias("n"))
    of_all, of_id = copies.agg(F.sum("n"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))).first()
    classes = stored(_tasks(classes, of_all or 0), "classes")

    member = F.struct("doc_id", "label", "n_shingles", "unique", "sig").alias("m")
    rows = classes.withColumns({"label": F.col("doc_id"), "unique": F.lit(0).cast("long")}).select(member, F.posexplode(F.slice("sig", 1, TREES)).alias("tree", "v")).select(
        F.xxhash64("tree", "v").alias("key"), "tree", "m")
    links, sets, many = None, None, classes.count() * TREES
    for level in range(LEVELS + 1):
        nodes = stored(_tasks(_sized(rows), many), "nodes")
        of_nodes, of_large = nodes.agg(F.count("*"), F.count_if(F.col("size") > SMALL)).first()
        pairs = stored(_tasks(_pairs(_together(nodes, of_nodes), percent), of_nodes), "pairs")
        of_pairs = pairs.count()
        large = nodes.where(F.col("size") > SMALL)
        if sets is None:
            # members of large nodes are compared at each level: one pass over the texts writes the sets of all
            texts = _only(docs.select("doc_id", "text"), _ends(pairs).union(large.select("m.doc_id")), 2 * of_pairs + of_large)
            # the texts are shuffled by doc_id only where one is repeated
            sets = stored(full_sets(texts if (of_id or 0) <= 1 else texts.dropDuplicates(["doc_id"]), shingle), "sets")
        new = stored(confirmed(pairs, of_pairs, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
        if not of_large:
            break
        if level == 0:
            unique = unique_shingles(_only(sets.select("doc_id", "elements"), large.select("m.doc_id"), of_large))
            unique = _few(stored(_tasks(unique, of_large), "unique"))
        at_end = level == LEVELS
        labels = components(links)
        # one link for each linked document says as much as all links
        links = labels.where("doc_id <> component_id").toDF("b", "a")
        labels = _few(labels).toDF("doc_id", "found")
        members = _together(large, of_large).select("key", "tree", "m.doc_id", "m.n_shingles", "m.sig").join(labels, "doc_id", "left").join(unique, "doc_id", "left").withColumns(
            {"label": F.coalesce("found", "doc_id"), "unique": F.coalesce("unique", F.lit(0).cast("long"))})
        rows = stored(_tasks(_with_majority(_that_can_link(members.select("key", "tree", member), percent)), of_large), "members")
        # branching cannot part what is alike: where most members are connected, the others are compared with all at once
        alike = F.lit(at_end) | (2 * F.col("major_size") >= F.col("size"))
        of_mostly, of_others = rows.agg(F.count_if(alike), F.count_if(~alike)).first()
        if of_mostly:
            with batches_of(spark, PAIRS_AT_ONCE):
                links = links.unionByName(stored(_crowd_links(rows.where(alike), of_mostly, sets, percent), "links"))
        if not of_others:
            break
        place = (F.col("tree") * LEVELS + level) * CHILDREN
        rows = rows.where(~alike).withColumn("doc_id", F.col("m.doc_id"))
        many = of_others * CHILDREN
        rows = (F.broadcast(rows) if many <= ROWS_A_TASK else rows).join(sets.select("doc_id", "branches"), "doc_id").select(
            F.col("key").alias("parent"), "tree", "m", F.posexplode(F.array(*[F.get("branches", place + c) for c in range(CHILDREN)])).alias("child", "v")).select(
            F.xxhash64("parent", "child", "v").alias("key"), "tree", "m")
        if many <= ROWS_A_TASK:
            # the work of one task, as in _together, but the sets are read by many
            rows = rows.repartition(1)
    labels = _few(components(links))
    of_class = classes.select("doc_id", *named).join(labels, "doc_id", "left").select(*named, F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sig.join(of_class, named, "left").select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays; all columns of the input are kept. Rows without a doc_id stay."""
    gone = near_duplicates(docs, shingle, percent).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
