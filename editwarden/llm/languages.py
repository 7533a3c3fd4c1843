"""Language of a text from averaged hashed subword embeddings and a linear softmax (operator 6).

Subwords are byte n-grams of 2, 3 and 4 (A-Z lowered, white space as one kind of byte), hashed into BUCKETS. Their
embeddings are averaged over the text and meet a linear softmax; both are trained by stochastic gradient descent
in numpy on about PER_LANGUAGE documents of each language (a bound on what the driver holds: at most BUCKETS
counts a document, whatever its length). A fifth of these is held back to fit a temperature, which calibrates the score,
and the rejection threshold: at most 0.5, and so low that 999 of 1,000 right answers are accepted. Prediction
reads every byte of every text.

Null texts and texts without a letter are ``und`` with score 0 and are rejected. Without any labelled document all are ``und``
and only texts without a letter are rejected. Ties go to the language first in order. Other columns are passed through or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwarden.llm.frames import ready
from editwarden.llm.texts import batch_bytes, lowered

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
PER_LANGUAGE = 400
EPOCHS = 12
BATCH = 32
RATE = 2.0
SLICE = 1 << 20
GRAMS = (2, 3, 4)
UNKNOWN = "und"


def subword_slices(data, offsets):
    """(ids, documents) of the subwords of a batch, in slices of bounded size; documents are numbers in the batch."""
    data = lowered(data)
    data = np.where((data <= 0x20) & (data >= 9), np.uint8(0x20), data)
    for low in range(0, len(data), SLICE):
        part = data[low:low + SLICE + 3].astype(np.uint32)
        part = np.concatenate([part, np.zeros(3, np.uint32)])
        many = min(SLICE, len(data) - low)
        document = np.searchsorted(offsets, np.arange(low, low + many), side="right") - 1
        room = offsets[document + 1] - np.arange(low, low + many)
        gram = part[:many].copy()
        for k in range(1, max(GRAMS)):
            gram = (gram << np.uint32(8)) | part[k:k + many]
            if k + 1 in GRAMS:
                fits = room >= k + 1
                ids = ((gram ^ np.uint32(k * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
                yield ids[fits], document[fits]


def _counts(batches):
    for batch in batches:
        data, offsets = batch_bytes(batch.column("text"))
        ids = list(subword_slices(data, offsets))
        every = np.concatenate([i.astype(np.int64) + d * BUCKETS for i, d in ids]) if ids else np.zeros(0, np.int64)
        keys, counts = np.unique(every, return_counts=True)
        ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * BUCKETS)
        yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), batch.column("calibrates"), pa.array([
            np.stack([keys[a:b] % BUCKETS, counts[a:b]]).astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
            names=["doc_id", "lang", "calibrates", "counts"])


@dataclass
class LanguageModel:
    languages: list
    weights: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def probabilities(self, sums, counts):
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        out = np.exp(logits)
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, data, offsets):
        """(number of the language, score) for each text of a batch."""
        docs = len(offsets) - 1
        sums, counts = np.zeros((docs, len(self.languages))), np.zeros(docs)
        for ids, document in subword_slices(data, offsets):
            if len(ids):
                at = np.flatnonzero(np.diff(document, prepend=-1))
                sums[document[at]] += np.add.reduceat(self.weights[ids], at, axis=0)
                counts[document[at]] += np.diff(np.append(at, len(ids)))
        p = self.probabilities(sums, counts)
        best = p.argmax(axis=1)
        return best, p[np.arange(docs), best]


def _dense(rows):
    out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for k, (ids, counts) in enumerate(rows):
        out[k, ids] = counts / max(1, counts.sum())
    return out


def fit(rows, labels, calibrates, languages, seed: int = 6) -> LanguageModel:
    """Train on sparse count rows; those that calibrate only set temperature and threshold."""
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = random.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    learn = np.flatnonzero(~calibrates)
    learn = learn if len(learn) else np.arange(len(rows))
    share = np.bincount(labels[learn], minlength=len(languages))
    weight = (share.sum() / np.maximum(1, share) / len(languages)).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(random.permutation(learn), max(1, -(-len(learn) // BATCH))):
            x, y = _dense([rows[i] for i in some]), labels[some]
            hidden = x @ embed
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None]
            into = p @ soft.T
            soft -= rate * (hidden.T @ p)
            bias -= np.float32(0.1 * rate) * p.sum(axis=0)
            # the average makes single gradients small; embeddings move by the same rate times the text's subwords
            embed -= np.float32(rate * 50) * (x.T @ into)
    model = LanguageModel(list(languages), (embed @ soft).astype(np.float32), bias)
    test = np.flatnonzero(calibrates)
    if len(test):
        sums = np.concatenate([_dense([rows[i] for i in test[k:k + BATCH]]) @ model.weights for k in range(0, len(test), BATCH)])
        ones = np.ones(len(test))

        def loss(t):
            model.temperature = t
            return -np.log(model.probabilities(sums, ones)[np.arange(len(test)), labels[test]] + 1e-12).mean()

        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = model.probabilities(sums, ones)
        right = p.argmax(axis=1) == labels[test]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], 0.001)))
    return model


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def has_letter(column="text"):
    return F.coalesce(F.col(column).rlike("\\p{L}"), F.lit(False))


def train(docs: DataFrame, seed: int = 6) -> LanguageModel | None:
    """Learn from ``text`` and ``lang`` of the documents that are not held out."""
    ready(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1e6
    shares = docs.sparkSession.createDataFrame([(v, min(1.0, PER_LANGUAGE / n)) for v, n in known.items()], "lang string, share double")
    # the driver holds one row per language already, so this side is as small as that
    some = usable.join(F.broadcast(shares), "lang").where(draw < F.col("share")).where(has_letter()).select(
        "doc_id", "text", "lang", (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0).alias("calibrates"))
    got = some.mapInArrow(_counts, "doc_id long, lang string, calibrates boolean, counts binary").toArrow().sort_by("doc_id")
    rows = []
    for value in got.column("counts"):
        ids, counts = np.frombuffer(value.as_py(), dtype=np.int32).reshape(2, -1)
        rows.append((ids, counts))
    langs = got.column("lang").to_pylist()
    if not rows:
        return None
    languages = sorted(set(langs))
    place = {v: k for k, v in enumerate(languages)}
    return fit(rows, np.array([place[v] for v in langs]), np.array(got.column("calibrates").to_pylist()), languages, seed)


def identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with __lang_pred, __score, __rejected."""
    ready(docs.sparkSession)
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [
        T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__rejected", T.BooleanType())])
    place = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            if model is None:
                names, score, rejected = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), ~letters
            else:
                best, score = model.predict(*batch_bytes(batch.column(place)))
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                score = np.where(letters, np.minimum(score, 1.0), 0.0)
                rejected = ~letters | (score < model.threshold)
            yield pa.record_batch(list(batch.columns[:-1]) + [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=kinds.names)

    return docs.withColumn("__letters", has_letter()).mapInArrow(work, kinds)


def with_language(docs: DataFrame) -> DataFrame:
    """Stage form: the documents whose language is recognised, with their columns."""
    return identified(docs, train(docs)).where("NOT __rejected").select(*docs.columns)
