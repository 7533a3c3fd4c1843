"""Operators 11 to 13: brute force, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from editwarden.llm import additive
from editwarden.llm import collocations as phrases
from editwarden.llm.additive import FEATURES, fit, measures, quality, scored, train
from editwarden.llm.collocations import BiIndex, collocations
from editwarden.llm.resampling import BUCKETS, Spans, features, gains, interned, resampled
from editwarden.llm.texts import batch_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n int, bucket string"


def documents(spark, rows, langs=None):
    return spark.createDataFrame(
        [(d, t, langs[k] if langs else "en", "s", 1, "x", 1, "y") for k, (d, t) in enumerate(rows)], DOCS).repartition(3)


# --- importance resampling

def plain_features(text, grams):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)], len(words)


def plain_resampled(rows, target, grams, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % BUCKETS
    s, t = [0] * BUCKETS, [0] * BUCKETS
    for counts, texts in ((s, [t for _, t in rows]), (t, target)):
        for text in texts:
            for f in plain_features(text, grams)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + BUCKETS) / ((s[b] + 1) * (sum(t) + BUCKETS)))) for b in range(BUCKETS)]
    out, enough = [], []
    for doc, text in rows:
        found, words = plain_features(text, grams)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        if doc is None:
            out.append([doc, len(found), weight, None, None])
            continue
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= least:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = k + 1
    return out


def sample_rows(count, seed=1):
    random.seed(seed)
    words = ["Ärger", "the", "THE", "a1", "x" * 31, "y" * 32, "z" * 300, "né", "日本語", "tab\tbed", "dash-ed", "nul\x00byte", "w7"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.choices(words, k=random.choice([0, 3, 19, 20, 60])))) for i in range(count)]
    return rows + [(count, None), (count + 1, ""), (None, "the the " * 30), (3, "the " * 25), (3, "the " * 25), (count + 2, "w1 w2 " * 30_000)]


def test_resampling_equals_brute_force(spark):
    rows = sample_rows(150)
    target = ["the né w1 w2 w3", None, "", "W1 w9 " * 40]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(target)], "item_id long, text string, score string")
    for grams, percent, least in ((1, 10, 20), (3, 37, 5), (1, 100, 1), (1, 0, 1)):
        got = resampled(documents(spark, rows), bench, grams=grams, percent=percent, least_words=least).collect()
        expected = plain_resampled(rows, target, grams, percent, least)
        assert sorted((tuple(r) for r in got), key=str) == sorted((tuple(r) for r in expected), key=str)


def test_resampling_of_empty_tables(spark):
    rows = sample_rows(10)
    bench = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert resampled(documents(spark, rows).limit(0), bench).count() == 0
    assert resampled(documents(spark, rows), bench.limit(0)).count() == len(rows)


def test_span_hashes_equal_the_libraries():
    random.seed(2)
    raw = [bytes(random.randrange(256) for _ in range(n)) for n in [*range(0, 70), 255, 256, 257, 900]]
    ends = np.cumsum([len(r) for r in raw])
    spans = Spans(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(r) for r in raw], ends)
    assert spans.xxhash64().tolist() == [xxhash.xxh64_intdigest(r) for r in raw]
    assert spans.crc32(np.arange(len(raw))[::-1]).tolist() == [zlib.crc32(r) for r in raw[::-1]]


def test_equal_keys_are_told_apart_by_their_bytes(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(Spans, "xxhash64", lambda self: self.sizes.astype(np.uint64) % np.uint64(2))
    texts = ["aa ab aa abcdefgh abcdefgi abcdefgh a " + "q" * 300 + " " + "q" * 299 + "r " + "q" * 300]
    spans, many, words = features(*batch_bytes(pa.array(texts)), 1)
    slots, held = interned(spans)
    names = [spans.raw(i) for i in range(len(spans))]
    assert len(set(slots.tolist())) == len(set(names)) == (held >= 0).sum()
    assert len({(s, n) for s, n in zip(slots.tolist(), names)}) == len(set(names))


def test_resampling_prefers_texts_like_the_target(spark):
    rows = [(i, ("target words here " if i % 4 == 0 else "other things there ") * 20) for i in range(400)]
    bench = spark.createDataFrame([(1, "target words here " * 50)], "item_id long, text string")
    drawn = [r.doc_id for r in resampled(documents(spark, rows), bench).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(d % 4 == 0 for d in drawn) >= 38


def test_gains_without_features():
    assert gains(np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)).tolist() == [0] * BUCKETS


# --- quality by an additive model

def plain_measures(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [w.lower() for w in words]
    each, size = max(len(words), 1), max(len(raw), 1)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    letters = count(range(65, 91)) + count(range(97, 123))
    windows = [tuple(low[i:i + 5]) for i in range(len(low) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\v\f\r")]
    return [
        math.log1p(len(words)), sum(map(len, words)) / each, count(range(65, 91)) / max(letters, 1), count(b"#*$%&|<>") / each, count(b"!?") / each,
        count(b".,;:") / each, count(b"0123456789") / size, count(b"|") / each, count(range(128, 256)) / size, count(b" \t\n\v\f\r") / size,
        sum(a == b for a, b in zip(low, low[1:])) / each, len(set(low)) / each, max(map(low.count, low), default=0) / each, len(covered) / each,
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(words) / max(len(lines), 1),
        sum(len(w) <= 2 for w in words) / each, sum(len(w) >= 12 for w in words) / each]


def test_measures_equal_a_plain_count():
    import pyarrow as pa
    texts = ["", None, "One two, TWO one! two two\n\n  \nOne two\nOne two", "ünï ça | 12 3 | # *", " ".join(["a b c d e"] * 7), "x", "\n", "same same " * 30 + "averyveryverylongword"]
    got = measures(*batch_bytes(pa.array(texts, pa.string())))
    assert got.shape == (len(texts), len(FEATURES))
    assert np.allclose(got, [plain_measures(t) for t in texts])


def test_additive_model_is_a_sum_of_tables():
    random = np.random.default_rng(3)
    x = random.integers(0, 6, (3000, 3)).astype(float)
    y = ((x[:, 0] >= 3) ^ (x[:, 1] >= 3)).astype(int)  # an interaction alone
    model = fit(x, y, np.ones(len(y)), np.arange(len(y)) % 5 == 0)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.98 and (0, 1) in model.pairs
    for row in x[:50]:
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.start + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(g[model.coarse[a][bins[a]], model.coarse[b][bins[b]]] for (a, b), g in zip(model.pairs, model.grids))
        assert abs(1 / (1 + math.exp(-total)) - model.score(row[None])[0]) < 1e-12


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(sf + "documents.parquet"), spark.read.parquet(sf + "labels.parquet")
    rows = quality(docs.repartition(5), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.99 * sum(r.quality for r in rows)
    again = {r.doc_id: r.score for r in quality(docs, labels.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)
    # labels of held-out rows are not looked at
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r.doc_id: r.score for r in quality(docs, turned).collect()}
    assert other == again


def test_quality_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(additive, "AT_ONCE", 300)
    random.seed(8)
    good = [(i, " ".join(random.choices(["plain", "words", "in", "a", "row"], k=random.randrange(1, 60)))) for i in range(200)]
    junk = [(i + 200, " ".join(random.choices(["$$$", "###x", "|"], k=random.randrange(1, 60)))) for i in range(100)]
    extra = [(300, None), (301, ""), (None, "plain words"), (None, "$$$ |"), (7, "plain words"), (302, "|" * 20_000), (303, "w " * 20_000)]
    docs = documents(spark, good + junk + extra)
    rows = [(d, int(d < 200), 0) for d, _ in good + junk] + [(5, None, 0), (6, 1, 1), (6, 1, 0), (None, 0, 0), (9999, 0, 0), (8, 7, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = quality(docs, labels).collect()
    assert len(out) == len(good + junk + extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(r.predicted == (r.doc_id < 200) for r in out if r.doc_id is not None and r.doc_id < 300) >= 295
    assert quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert min(r.score for r in quality(docs, labels.where("quality = 1")).collect()) > 0.99
    assert max(r.score for r in scored(docs, train(docs, labels.where("quality = 0"))).collect()) < 0.01


# --- collocations

def plain_phrases(rows, longest):
    counts = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i:i + n])] += 1
    return counts


def plain_collocations(rows, longest, least, first):
    f = plain_phrases(rows, longest)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in candidates.items():
        if any(100 * b >= 80 * a and len(v) > len(w) and other == lang and any(v[i:i + len(w)] == w for i in range(len(v))) for (other, v), b in candidates.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, many in found.items():
        n = sum(a for (other, w), a in f.items() if other == lang and len(w) == 1)
        out += [(lang, rank + 1, p.decode(), -a, x, y, n, -s) for rank, (s, a, p, x, y) in enumerate(sorted(many)[:first])]
    return sorted(out)


def phrase_rows(seed=5):
    random.seed(seed)
    words = ["a", "A", "b", "c", "d", "é", "ß", "日本", "x-y", "n" * 40] + [f"r{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        pieces = [" ".join(random.choices(words, weights=[9] * 10 + [0.2] * 200, k=random.randrange(0, 30))) + random.choice([".", ", ", "\n", " \t", "!?", ""]) for _ in range(6)]
        texts.append("".join(pieces) + random.choice(["", " new york city hall", " New\tYork  city"]))
    texts += ["same words again and again " * 40] * 3 + [None, "", " \t ", ".;", "one", "a" * 5000 + " b"]
    return texts, [random.choice(["en", "de", None, "und"]) for _ in texts]


def test_bidirectional_extension_counts_all_ngrams():
    random.seed(4)
    sequence = [0]
    for _ in range(60):
        sequence += random.choices([1, 2, 3, 4, 7], k=random.randrange(0, 9)) + [0]
    index = BiIndex(np.array(sequence), 4)
    for n, grams in enumerate(index.enumerate(4), 2):
        expected = Counter(tuple(sequence[i:i + n]) for i in range(len(sequence) - n + 1) if 0 not in sequence[i:i + n])
        assert {tuple(w): s for w, s in zip(grams.words.tolist(), grams.sizes.tolist())} == expected and len(grams.sizes) == len(expected)
        # intervals of one length are disjoint in both directions
        for starts in (grams.ahead, grams.back):
            order = np.argsort(starts)
            assert (starts[order][1:] >= (starts + grams.sizes)[order][:-1]).all()
    # right first gives the same as left first
    other = index.left(index.right(index.left(index.single)))
    assert {tuple(w): s for w, s in zip(other.words.tolist(), other.sizes.tolist())} == {tuple(w): s for w, s in zip(grams.words.tolist(), grams.sizes.tolist())}


def test_collocations_equal_brute_force(spark, monkeypatch):
    texts, langs = phrase_rows()
    docs = documents(spark, [(None if i % 17 == 0 else i, t) for i, t in enumerate(texts)], langs)
    for shard, longest, least, first in ((2000, 4, 5, 2000), (8 << 20, 4, 3, 7), (500, 3, 1, 50), (3000, 2, 10, 2000)):
        monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
        got = sorted(tuple(r) for r in collocations(docs, longest, least, first).collect())
        assert got == plain_collocations(list(zip(texts, langs)), longest, least, first)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs.where("text IS NULL")).count() == 0


def test_collisions_of_hashes_change_nothing(spark, monkeypatch):
    texts, langs = phrase_rows(6)
    monkeypatch.setattr(phrases.Shard, "pair_keys", lambda self, a, b: self.keys[a - 1] % np.uint64(5))
    got = sorted(tuple(r) for r in collocations(documents(spark, list(enumerate(texts)), langs), 4, 8, 100).collect())
    assert got == plain_collocations(list(zip(texts, langs)), 4, 8, 100)
