"""Quality score of a text by a generalised additive model with pairwise interactions (operator 11).

Each text becomes FEATURES, plain measures of its whole bytes. A feature is cut into at most BINS bins at quantiles of the fitted rows.
The model is one table per feature and one per chosen pair of features. Training is cyclic boosting of the log loss: in each round every
feature in turn gets one shallow tree over its ordered bins (at most four leaves), added to its table at a small RATE; a fifth of the rows
tells after which round to stop. Then all pairs are ranked by what one cut in each of two features still gains, and the PAIRS best are boosted
in the same way with trees that cut one feature and then the other. Scoring finds bins and adds table entries, a whole batch at a time.

Labels are learnt only from rows that are not held out (crc32 of doc_id modulo 3 is not 1), from about PER_LABEL documents of each label, drawn by a
hash of the doc_id: this bounds what the driver holds. Weights give each label its share in all learnable rows. Scoring reads every text.

Null and empty texts have measures of 0 and a score like any other. Labels other than 0 and 1, and labels without a document, are ignored; of
repeated labels of a doc_id the smallest counts. With no label or one label only, every text scores the share of label 1 (0.5 without any).
Rows without doc_id or with a repeated one are scored each by its text. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import ready
from editwarden.llm.languages import held_out
from editwarden.llm.texts import U64, batch_bytes, lowered, mix, sequence_hashes, span_hashes, word_bounds

PER_LABEL = 6000
BINS = 32
COARSE = 8  # bins of a feature in a pair
PAIRS = 10
ROUNDS = 200
PATIENCE = 20
RATE = 0.1
CAREFUL = 1.0  # added to the curvature of a leaf
LEAST_ROWS = 5  # of a leaf
AT_ONCE = 1 << 21  # bytes of text measured at once
FEATURES = (
    "log_words", "word_bytes", "upper_share", "symbols_per_word", "cries_per_word", "marks_per_word", "digit_share", "bars_per_word", "wide_share",
    "space_share", "same_as_last", "distinct_share", "top_word_share", "repeated_windows", "repeated_lines", "words_per_line", "short_words", "long_words")


def _flags(chars: bytes):
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_KINDS = {
    "upper": _flags(bytes(range(65, 91))), "letter": _flags(bytes(range(65, 91)) + bytes(range(97, 123))), "symbol": _flags(b"#*$%&|<>"), "cry": _flags(b"!?"),
    "mark": _flags(b".,;:"), "digit": _flags(b"0123456789"), "bar": _flags(b"|"), "wide": _flags(bytes(range(128, 256))), "space": _flags(b" \t\n\v\f\r")}
_LINE_END = _flags(b"\n").astype(bool)


def _sums(values, ends, starts):
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[ends] - total[starts]).astype(float)


def _repeats(doc, hashes):
    """For each hash how often its document holds it, and whether it is the first one."""
    keys = mix(hashes ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15)), 5)
    _, first, place, many = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(keys), dtype=bool)
    new[first] = True
    return many[place], new


def measures(data, offsets) -> np.ndarray:
    """FEATURES of each text, one row a text."""
    docs = len(offsets) - 1
    begin, end = offsets[:-1], offsets[1:]
    size = np.maximum(end - begin, 1)
    kinds = {name: _sums(flags[data], end, begin) for name, flags in _KINDS.items()}
    starts, ends, words = word_bounds(data, offsets)
    last = np.cumsum(words)
    first = last - words
    each = np.maximum(words, 1)
    doc = np.repeat(np.arange(docs), words)
    sizes = ends - starts
    hashes = span_hashes(lowered(data), starts, ends)
    many, new = _repeats(doc, hashes)
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(docs)
    full = np.flatnonzero(words)
    if len(full):
        top[full] = np.maximum.reduceat(many, first[full])
    covered = np.zeros(len(doc) + 1, dtype=np.int64)
    if len(doc) >= 5:
        at = np.flatnonzero(doc[:-4] == doc[4:])
        twice = at[_repeats(doc[at], sequence_hashes(hashes, 5)[at])[0] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    covered = np.cumsum(covered)[:-1] > 0
    line_start, line_end, lines = word_bounds(data, offsets, _LINE_END)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_doc = np.repeat(np.arange(docs), lines)[worded]
    again = ~_repeats(line_doc, span_hashes(data, line_start[worded], line_end[worded]))[1]
    lines = np.maximum(np.bincount(line_doc, minlength=docs), 1)
    return np.column_stack([
        np.log1p(words), _sums(sizes, last, first) / each, kinds["upper"] / np.maximum(kinds["letter"], 1), kinds["symbol"] / each, kinds["cry"] / each,
        kinds["mark"] / each, kinds["digit"] / size, kinds["bar"] / each, kinds["wide"] / size, kinds["space"] / size, _sums(same, last, first) / each,
        _sums(new, last, first) / each, top / each, _sums(covered, last, first) / each, np.bincount(line_doc[again], minlength=docs) / lines, words / lines,
        _sums(sizes <= 2, last, first) / each, _sums(sizes >= 12, last, first) / each]).reshape(docs, len(FEATURES))


def _measured(batch):
    """The measures of a batch, some bytes at a time."""
    data, offsets = batch_bytes(batch.column("text"))
    cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] // AT_ONCE)) + 1).tolist(), batch.num_rows]
    rows = [measures(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in zip(cuts, cuts[1:]) if b > a]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    start: float
    edges: list = field(default_factory=list)  # of each feature, its cuts between bins
    coarse: list = field(default_factory=list)  # of each feature, the coarse bin of each bin
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    grids: list = field(default_factory=list)

    def bins(self, x):
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def logits(self, x):
        bins = self.bins(x)
        out = np.full(len(x), self.start)
        for place, table in zip(bins, self.tables):
            out += table[place]
        for (a, b), grid in zip(self.pairs, self.grids):
            out += grid[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return out

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _cut(g, h, n):
    """(gain, bins left of the cut) of the best cut of ordered bins with sums of gradients, curvatures and rows."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl ** 2 / (hl + CAREFUL) + gr ** 2 / (hr + CAREFUL) - g.sum() ** 2 / (h.sum() + CAREFUL)
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain, -1.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, None
    return float(gain.max()), int(gain.argmax()) + 1


def _leaf(g, h):
    return -g.sum() / (h.sum() + CAREFUL)


def _tree(g, h, n):
    """The step of each bin: a tree of two levels over ordered bins."""
    out = np.zeros(len(g))
    _, cut = _cut(g, h, n)
    for part in [slice(0, len(g))] if cut is None else [slice(0, cut), slice(cut, len(g))]:
        _, second = _cut(g[part], h[part], n[part])
        a, b = part.start, part.stop
        for low, high in [(a, b)] if second is None else [(a, a + second), (a + second, b)]:
            out[low:high] = _leaf(g[low:high], h[low:high])
    return out


def _grid_tree(g, h, n):
    """(gain, step of each cell): one feature is cut, then the other on each side; the better order of the two."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        gg, hh, nn = (v.T if turned else v for v in (g, h, n))
        gain, cut = _cut(gg.sum(axis=1), hh.sum(axis=1), nn.sum(axis=1))
        # a pure interaction shows no gain along one feature: try the middle as well
        for c in {cut or 0, int(np.searchsorted(np.cumsum(nn.sum(axis=1)), nn.sum() / 2)) + 1}:
            if not 0 < c < len(gg):
                continue
            step, total = np.zeros(gg.shape), -(gg.sum() ** 2) / (hh.sum() + CAREFUL)
            for part in (slice(0, c), slice(c, len(gg))):
                cols = [v[part].sum(axis=0) for v in (gg, hh, nn)]
                _, second = _cut(*cols)
                for low, high in [(0, gg.shape[1])] if second is None else [(0, second), (second, gg.shape[1])]:
                    sg, sh = cols[0][low:high], cols[1][low:high]
                    step[part, low:high] = _leaf(sg, sh)
                    total += sg.sum() ** 2 / (sh.sum() + CAREFUL)
            if total > best[0]:
                best = (float(total), step.T if turned else step)
    return best


def fit(x, y, weight, checks) -> AdditiveModel:
    """Train on rows of measures; the rows that check only tell when to stop."""
    share = float((weight * y).sum() / weight.sum())
    model = AdditiveModel(float(np.log(share / (1 - share))))
    learn = ~checks if (~checks).any() and len(np.unique(y[~checks])) == 2 else np.ones(len(y), dtype=bool)
    for k in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[learn, k], np.arange(1, BINS) / BINS, method="lower")))
        wide = np.searchsorted(np.unique(np.quantile(x[learn, k], np.arange(1, COARSE) / COARSE, method="lower")), model.edges[k], side="left")
        model.coarse.append(np.concatenate([[0], wide + 1]).astype(np.int64))
        model.tables.append(np.zeros(len(model.edges[k]) + 1))
    bins = model.bins(x)
    out = np.full(len(y), model.start)
    weight = weight / weight.mean()

    def slopes():
        p = 1 / (1 + np.exp(-out[learn]))
        return (p - y[learn]) * weight[learn], p * (1 - p) * weight[learn]

    def loss():
        some = checks if checks.any() else learn
        return float((weight[some] * np.logaddexp(0, np.where(y[some] == 1, -out[some], out[some]))).sum())

    def boost(places, tables, shapes, grow):
        """Rounds over all tables in turn until the checked loss no longer falls; the tables of the best round stay."""
        nonlocal out
        best, since = (loss(), [t.copy() for t in tables], out.copy()), 0
        sizes = [np.bincount(p[learn], minlength=int(np.prod(s))).reshape(s) for p, s in zip(places, shapes)]
        for _ in range(ROUNDS):
            for place, table, shape, rows in zip(places, tables, shapes, sizes):
                g, h = (np.bincount(place[learn], weights=v, minlength=int(np.prod(shape))).reshape(shape) for v in slopes())
                step = RATE * grow(g, h, rows)
                table += step
                out += step.reshape(-1)[place]
            now = loss()
            if now < best[0] - 1e-6:
                best, since = (now, [t.copy() for t in tables], out.copy()), 0
            else:
                since += 1
                if since >= PATIENCE:
                    break
        out = best[2]
        return best[1]

    model.tables = boost(bins, model.tables, [t.shape for t in model.tables], _tree)
    coarse = [c[b] for c, b in zip(model.coarse, bins)]
    widths = [int(c.max()) + 1 for c in model.coarse]
    g, h = slopes()
    ranked = []
    for a, b in combinations(range(x.shape[1]), 2):
        shape = (widths[a], widths[b])
        place = coarse[a] * widths[b] + coarse[b]
        sums = [np.bincount(place[learn], weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(g)))]
        ranked.append((-_grid_tree(*sums)[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(ranked)[:PAIRS] if gain < 0]
    shapes = [(widths[a], widths[b]) for a, b in model.pairs]
    places = [coarse[a] * widths[b] + coarse[b] for a, b in model.pairs]
    model.grids = boost(places, [np.zeros(s) for s in shapes], shapes, lambda g, h, n: _grid_tree(g, h, n)[1])
    return model


def train(docs: DataFrame, labels: DataFrame, seed: int = 11) -> AdditiveModel:
    """Learn ``quality`` of the labelled documents that are not held out."""
    spark = ready(docs.sparkSession)
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label"))
    known = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(known) < 2:
        return AdditiveModel(35.0 if 1 in known else -35.0 if 0 in known else 0.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1e6
    wanted = F.when(F.col("label") == 1, min(1.0, PER_LABEL / known[1])).otherwise(min(1.0, PER_LABEL / known[0]))
    # some PER_LABEL rows of each label, whatever the size of the tables
    some = docs.select("doc_id", "text").join(F.broadcast(usable.where(draw < wanted)), "doc_id")

    def work(batches):
        for batch in batches:
            rows = _measured(batch)
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "x"])

    got = some.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.array([np.frombuffer(v.as_py()) for v in got.column("x")]).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy()
    many = np.bincount(y, minlength=2)
    if not many.all():
        return AdditiveModel(35.0 if many[1] else -35.0 if many[0] else 0.0)
    weight = np.array([known[0] / many[0], known[1] / many[1]])[y]
    checks = mix(got.column("doc_id").to_numpy().view(U64), seed) % U64(5) == 0
    return fit(x, y, weight, checks)


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    ready(docs.sparkSession)

    def work(batches):
        for batch in batches:
            x = _measured(batch)
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    return scored(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
