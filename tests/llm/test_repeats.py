"""Operators 1, 4, 7 and 8 against brute force, on fixtures with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from editwarden.llm.lines import line_dedup, without_repeated_runs
from editwarden.llm.near import near_duplicates, without_near_duplicates
from editwarden.llm.substrings import COVER, PERIOD, without_repeated_passages
from editwarden.llm.suffixes import equal_runs, leading_words, without_repeated_strings

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, fp string, start long, component_id long"


def corpus(seed, many=60, words=400):
    """Texts that share passages, copies and near copies, and the odd cases."""
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeéß", k=random.randint(1, 7))) for _ in range(300)]
    passages = [[random.choice(vocabulary) for _ in range(random.choice([49, 50, 51, 80, 130]))] for _ in range(8)]
    texts = []
    for _ in range(many):
        w = [random.choice(vocabulary) for _ in range(random.randint(1, words))]
        for p in random.sample(passages, random.randint(0, 3)):
            at = random.randint(0, len(w))
            w[at:at] = p
        texts.append("".join(x + random.choice([" ", " ", " ", "\n", "  "]) for x in w))
    texts += random.choices(texts, k=10)
    for t in random.choices(texts, k=10):
        w = t.split(" ")
        w[random.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "a" * 5000, "a" * 300, "one", "one", "ONE", "ab " * 4000, "ab " * 200, "ü" * 80, "x" * 49, "x" * 50, "x" * 50]
    random.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 7, "f", 1, 2) for d, t in rows], SCHEMA)


def removed_bytes(rows, length=50):
    first, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            k = b[i:i + length]
            if k in first:
                gone[i:i + length] = b"\1" * length
            else:
                mine.add(k)
        first |= mine
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rows = corpus(seed)
    got = without_repeated_strings(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == removed_bytes(rows)
    for r in got:
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_removed


def test_repeated_strings_over_many_buckets(spark):
    # one passage in all documents: its leading tokens lie across bucket boundaries
    random.seed(5)
    common = "the passage that all of the documents hold, and which is long enough to count as one"
    rows = [(i, "".join(random.choices("abc", k=random.randint(0, 60))) + common[random.randint(0, 9):] + "".join(random.choices("abc", k=30))) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = without_repeated_strings(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == removed_bytes(rows)


def test_multikey_quicksort_finds_equal_runs():
    import numpy as np
    random.seed(3)
    data = np.frombuffer(bytes(random.choices(b"ab", k=400)), dtype=np.uint8)
    starts = np.arange(390)
    for length in (8, 9, 10):
        members, first = equal_runs(leading_words(data), starts, length)
        runs = {frozenset(members[a:b].tolist()) for a, b in zip(first, [*first[1:], len(members)])}
        groups = {}
        for s in starts:
            groups.setdefault(bytes(data[s:s + length]), set()).add(int(s))
        assert runs == {frozenset(g) for g in groups.values() if len(g) > 1}


def removed_words(rows, window=50):
    first, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone, mine = [False] * len(w), set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if k in first:
                gone[i:i + window] = [True] * window
            else:
                mine.add(k)
        first |= mine
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(spark, seed):
    rows = corpus(seed)
    got = without_repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == removed_words(rows)
    for r in got:
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_removed


def test_cover_brings_any_two_positions_together():
    for i, j in itertools.product(range(PERIOD), repeat=2):
        assert any((i + s) % PERIOD in COVER and (j + s) % PERIOD in COVER for s in range(PERIOD))


def shingles(text, size):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def classes(rows, size, percent=80):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = corpus(3, words=120)
    got = near_duplicates(frame(spark, rows), shingle=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == classes(rows, size)


def test_near_duplicates_of_one_large_group(spark):
    # more near copies than a node may hold: stars, branches, and a chain of links that only its neighbours share
    random.seed(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = f"c{random.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    for i in range(12):
        rows.append((1000 + i, " ".join(base[9 * i // 2:] + [f"t{k}" for k in range(9 * i // 2)])))
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == classes(rows, 4)


def test_near_duplicates_in_crowded_nodes(spark):
    """A passage that hundreds of otherwise different texts share makes nodes large: they branch, and links near the threshold are still found."""
    random.seed(12)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for d in range(0, 300, 2):
        own = [f"o{d}x{i}" for i in range(70)]
        other = list(own)
        for _ in range(random.randint(2, 5)):
            other[random.randrange(70)] = f"c{random.randrange(10 ** 6)}"
        rows += [(d, " ".join(passage + own)), (d + 1, " ".join(passage + other))]
    expected = classes(rows, 4)
    assert 100 < sum(not kept for _, _, kept in expected.values()) < 150
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected


def test_near_duplicates_of_a_crowd_without_links(spark, monkeypatch):
    """Nodes that stay large to the end are compared in blocks."""
    from editwarden.llm import near
    monkeypatch.setattr(near, "SMALL", 3)
    random.seed(13)
    passage = [f"p{i}" for i in range(200)]
    rows = [(d, " ".join(passage + [f"o{d}x{i}" for i in range(random.choice([24, 27, 60]))])) for d in range(60)]
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == classes(rows, 4)


def test_forest_connects_what_links_connect():
    from editwarden.llm.near import _forest
    random.seed(14)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    member, root = _forest(*np.array(links).T)
    parent = dict(zip(member.tolist(), root.tolist()))
    groups = {}
    for x, y in links:
        a, b = groups.setdefault(x, {x}), groups.setdefault(y, {y})
        if a is not b:
            a |= b
            for z in b:
                groups[z] = a
    for x, group in groups.items():
        assert parent.get(x, x) == min(group)


def test_components_of_few_links_take_no_shuffle(spark, monkeypatch):
    """One written table for few links; steps of joins for more than one task may hold give the same."""
    from editwarden.llm import near
    random.seed(15)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(k + 1, k) for k in range(400, 440)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    least = {x: x for pair in links for x in pair}
    for _ in links:
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    written = []
    stored = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: written.append((name, df)) or stored(df, name))
    found = lambda: {r.doc_id: r.component_id for r in near.components(stored(frame, "links")).collect()}
    assert found() == least and [name for name, _ in written] == ["labels"]
    assert "Exchange" not in written[0][1]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(near, "LINKS_AT_ONCE", 0)
    assert found() == least and "edges" in [name for name, _ in written]
    assert near.components(frame.where("a < 0")).isEmpty()


def test_steps_of_few_rows_are_written_by_few_tasks(spark, monkeypatch):
    from editwarden.llm import near

    chance = random.Random(5)
    passage = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(passage[:chance.randint(20, 60)] + [f"x{i}y{k}" for k in range(20)]), None) for i in range(300)]
    files, stored = {}, near.stored

    def counted(df, name):
        out = stored(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near, "stored", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=4).collect()}
        cores = spark.sparkContext.defaultParallelism
        assert all(max(files[name]) <= cores for name in ("classes", "nodes", "pairs", "members"))
        assert near._tasks(spark.range(0, 100, 1, 50), near.ROWS_A_TASK * (cores + 3)).rdd.getNumPartitions() == min(50, cores + 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=4).collect()} and len(got) == 300


def test_few_rows_are_grouped_without_a_shuffle(spark, monkeypatch):
    """Each shuffle costs a task for each of its partitions, however few rows it has; with more rows than a task may hold the result is the same."""
    from editwarden.llm import near

    monkeypatch.setattr(near, "SMALL", 3)
    monkeypatch.setattr(near, "LEVELS", 1)
    chance = random.Random(6)
    passage, other = [f"p{i}" for i in range(200)], [f"q{i}" for i in range(70)]
    rows = [(d, " ".join(passage + [f"o{d}x{i}" for i in range(chance.choice([24, 27, 60]))])) for d in range(60)]  # a crowd
    rows += [(d, " ".join(other + [f"o{d // 2}x{i}" for i in range(60)] + [f"o{d}y"])) for d in range(60, 160)]  # pairs in nodes that branch
    docs = frame(spark, rows)
    shuffles, stored = {}, near.stored

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.setdefault(name, []).append(plan.count("Exchange hashpartitioning"))
        return stored(df, name)

    monkeypatch.setattr(near, "stored", counted)
    found = lambda docs: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=4).collect()}
    got = found(docs)
    assert got == classes(rows, 4)
    assert {"pairs", "sets", "members", "crowds", "sizes"} <= set(shuffles) and len(shuffles["nodes"]) > 1
    assert all(not any(shuffles[name]) for name in ("pairs", "sets", "crowds", "sizes"))
    assert max(shuffles["members"]) <= 2 and max(shuffles["links"]) <= 3
    # texts are shuffled where a doc_id is repeated
    shuffles.clear()
    assert found(docs.union(docs.where("doc_id = 7"))) == got and any(shuffles["sets"])
    for name in ("ROWS_A_TASK", "BROADCAST_ROWS", "BROADCAST_IDS"):
        monkeypatch.setattr(near, name, 50)
    shuffles.clear()
    assert found(docs) == got and min(shuffles["pairs"] + shuffles["crowds"]) > 0


def test_one_of_each_group_stays_with_its_columns(spark):
    docs = frame(spark, corpus(3, words=120))
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {d for d, (_, _, kept) in classes(corpus(3, words=120), 5).items() if kept}


def kept_lines(rows, run=3):
    seen, out = set(), {}
    for d, t in sorted(rows):
        if t is None:
            out[d] = None
            continue
        lines = t.split("\n")
        worded = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i in range(len(worded) - run + 1):
            key = tuple(lines[k] for k in worded[i:i + run])
            if key in seen:
                gone.update(worded[i:i + run])
            seen.add(key)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_repeated_runs_of_lines(spark):
    random.seed(4)
    pool = ["line %d" % i for i in range(12)] + ["", " ", "ünï"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(1, 25)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "same\n" * 500), (204, "same\n" * 3), (205, rows[0][1]), (206, rows[0][1])]
    docs = frame(spark, rows)
    got = without_repeated_runs(docs)
    expected = kept_lines(rows)
    assert {r.doc_id: r.text for r in got.collect()} == expected
    stage = line_dedup(docs)
    assert stage.columns == docs.columns
    before = dict(rows)
    left = {d for d, t in expected.items() if t is None or t == before[d] or WORD.search(t)}
    rows = {r.doc_id: r for r in stage.collect()}
    assert set(rows) == left
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)


def test_long_runs_of_few_lines(spark):
    """One or two lines repeat if they hold 20 words, whatever stands around them; with fewer words they stay."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    one, short, a, b = words("one", 20), words("short", 19), words("a", 12), "b  b\tb b b b b b "
    tail = "\n".join(["x y"] * 2)
    rows = [(1, f"{one}\nhead 1\n{a}\n \n{b}\nfoot 1\n{short}"), (2, one), (3, short), (4, f"head 4\n{one}\nfoot 4"), (5, f"{a}\n{b}"), (6, b), (7, f"new 7\n{a}\nnew 8\n{b}"),
            (8, f"{tail}\n{one}\n{tail}"), (9, f"{one}\n{one}"), (10, "o" * 500), (11, "o" * 500), (12, "\u00fc " * 19 + "\u00fc"), (13, "\u00fc " * 19 + "\u00fc"), (14, " " * 60 + short)]
    got = {r.doc_id: r.text for r in without_repeated_runs(frame(spark, rows)).collect()}
    expected = {**dict(rows), 2: "", 4: "head 4\nfoot 4", 5: "", 8: f"{tail}\n{tail}", 9: "", 13: ""}
    assert got == expected
    assert {r.doc_id for r in line_dedup(frame(spark, rows)).collect()} == set(expected) - {2, 5, 9, 13}


def test_empty_tables(spark):
    docs = frame(spark, [])
    for out in (without_repeated_strings(docs), without_repeated_passages(docs), near_duplicates(docs), without_repeated_runs(docs), line_dedup(docs), without_near_duplicates(docs)):
        assert out.count() == 0


def test_rows_repeated_and_without_id(spark):
    text = " ".join(f"word{i}" for i in range(70))
    docs = frame(spark, [(5, text), (5, text), (9, text), (None, text), (None, None)])
    for out in (without_repeated_strings(docs), without_repeated_passages(docs)):
        rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_removed > 0) for r in out.collect()))
        assert rows == [(-1, False), (-1, False), (5, False), (5, False), (9, True)]
    assert sorted((r.n_bytes, len(r.kept)) for r in without_repeated_strings(docs).where("doc_id IS NULL").collect()) == [(0, 0), (len(text), len(text))]
    assert sorted((r.n_words, r.text) for r in without_repeated_passages(docs).where("doc_id IS NULL").collect()) == [(0, ""), (70, text)]
    near = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near) == [
        ("5", "5", True), ("5", "5", True), ("9", "5", False), ("None", "None", True), ("None", "None", True)]
    stays = without_near_duplicates(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("d")).collect()
    assert sorted(r.d for r in stays) == [-1, -1, 5, 5]
    # a line of 70 words is a run of its own: the later document loses it and goes; rows without a doc_id stay
    assert line_dedup(docs.where("text IS NOT NULL")).count() == 3
