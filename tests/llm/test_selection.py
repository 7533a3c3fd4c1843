"""Operators 2, 3, 5, 6, 9 and 10: round trips, brute force, held-out accuracy."""

import hashlib
import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from editwarden.llm import archives
from editwarden.llm.archives import ArchiveReader, ArchiveWriter, archived, parse_record, record_bytes
from editwarden.llm.languages import held_out, identified, train, with_language
from editwarden.llm.leaks import budget, leaked, least_distance, letter_masks, normal, pieces, without_leaks
from editwarden.llm.licenses import RULES, SENTENCES, licences
from editwarden.llm.mixing import fit_lengths, mix_sources, mixed
from editwarden.llm.quality import judged

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies string, size string, number int"


def documents(spark, rows, lang="en", source="s"):
    return spark.createDataFrame([(d, t, lang, source, None if t is None else len(t), "x", "y", 1) for d, t in rows], DOCS)


# --- archives

def test_archive_round_trip(spark):
    same = "<p>" + "equal payload " * 20 + "</p>"
    rows = [(1, "http://a/ b\n", same), (2, None, "short"), (3, "http://c", same), (4, "http://d", None), (5, "http://e", "short"), (6, "http://f", "ü" * 5000), (0, "http://g", same), (6, "http://f", "ü" * 5000), (None, "http://n", same)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived(pages).collect()), key=str)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = 0 if html == same and page else None
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    assert got == sorted(expected, key=str)
    assert archived(pages.limit(0)).count() == 0


def archive(records, **settings):
    stream = io.BytesIO()
    writer = ArchiveWriter(stream, **settings)
    for k, data in enumerate(records):
        writer.add(k, data)
    writer.close()
    return stream


def test_reader_finds_members_and_records():
    records = [record_bytes(k, f"http://x/{k}", b"p" * k, hashlib.sha256(b"p" * k).hexdigest(), None) for k in range(200)]
    stream = archive(records, member_bytes=2000)
    reader = ArchiveReader(stream, len(stream.getvalue()))
    assert [reader.read(*place) for place in reader.records()] == records
    assert [parse_record(r)[2] for r in records] == list(range(200))
    with zipfile.ZipFile(stream) as other:
        assert sorted(other.namelist()) == sorted(reader.members)
        for name in reader.members:
            assert reader.read(*reader.place(name)) == other.read(name)


def test_reader_of_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as out:
        for k in range(5):
            out.writestr(zipfile.ZipInfo(f"archive/{k}"), bytes([k]) * 300)
        out.comment = b"a comment with PK\x05\x06 in it"
    data = stream.getvalue()
    assert archives.END_64 in data and archives.LOCATOR in data
    reader = ArchiveReader(io.BytesIO(data), len(data))
    assert [reader.read(*reader.place(f"archive/{k}")) for k in range(5)] == [bytes([k]) * 300 for k in range(5)]


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        ArchiveReader(io.BytesIO(b"nothing"), 7)
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("squeezed", "a" * 1000)
    with pytest.raises(ValueError):
        ArchiveReader(stream, len(stream.getvalue())).place("squeezed")


# --- quality

def test_quality_counts_and_verdict(spark):
    random.seed(1)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(3, 8))) for _ in range(500)]
    rows = [(i, " ".join(random.choices(vocabulary, k=80))) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "#$" for w in random.choices(vocabulary, k=80))) for i in range(15)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "a b c d e " * 40), (2004, "line one\nline one\nline one\n\nother"), (2005, "#" * 3000), (2006, "x " * 5)]
    got = {r.doc_id: r for r in judged(documents(spark, rows)).collect()}
    for d, t in rows:
        w = (t or "").split()
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept for i in range(15))
    assert judged(documents(spark, [])).count() == 0


def test_one_bad_vote_is_outvoted(spark):
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(4, 8))) for _ in range(800)]
    text = lambda n, symbols=0: " ".join(w + ("#" if i < symbols else "") for i, w in enumerate(random.choices(vocabulary, k=n)))
    rows = [(i, text(80)) for i in range(300)] + [(1000 + i, text(12)) for i in range(15)] + [(2000 + i, text(80, 60)) for i in range(40)]
    got = {r.doc_id: r for r in judged(documents(spark, rows)).collect()}
    bad = {d: sum(v == -1 for k, v in r.asDict().items() if k.startswith("vote_")) for d, r in got.items()}
    assert all(bad[i] == 0 and got[i].kept for i in range(300))
    assert all(bad[1000 + i] == 1 and got[1000 + i].kept for i in range(15))
    assert all(bad[2000 + i] == 2 and not got[2000 + i].kept for i in range(40))


# --- licences

def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
           "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
           "fitness for a particular purpose and noninfringement.")
    cases = [
        (0, None, 0, 0, None), (1, "", 0, 0, None), (2, "Nothing of the kind. " * 5000, 0, 0, None),
        (3, "Text.\nReleased under the MIT License.\nMore.", 1, 1, "MIT"),
        (4, "Licensed under the Apache License, Version 2.0.", 1, 1, "Apache-2.0"),
        (5, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", 2, 2, "GPL-3.0-only,CC-BY-NC-4.0"),
        (6, mit, 3, 3, "MIT"), (7, "A licence of our own.", 1, 0, None),
        (8, "LICENSED UNDER THE APACHE LICENCE V2.0", 1, 1, "Apache-2.0"),
        (9, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 1, 1, None),
    ]
    got = {r.doc_id: (r.n_sentences, r.n_known, r.licences) for r in licences(documents(spark, [c[:2] for c in cases])).collect()}
    assert got == {c[0]: c[2:] for c in cases}
    assert licences(documents(spark, [])).count() == 0


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-3-Clause": """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the\npublic domain.",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_licence_texts(spark, mark):
    rows = []
    for i, text in enumerate(WRAPPED.values()):
        lines = "\n".join((mark + line).rstrip() for line in text.split("\n"))
        rows += [(2 * i, lines), (2 * i + 1, "code()\n\n" + lines.replace("\n", "\r\n") + "\n\nmore code")]
    rows += [(100, None), (None, rows[0][1]), (101, rows[0][1]), (101, rows[2][1])]
    got = [(r.doc_id, r.licences) for r in licences(documents(spark, rows)).collect()]
    expected = [(2 * i + k, name) for i, name in enumerate(WRAPPED) for k in (0, 1)]
    assert sorted(got, key=str) == sorted([*expected, (100, None), (None, "MIT"), (101, "MIT"), (101, "Apache-2.0")], key=str)


def test_rules_and_sentences_fit_together(spark):
    import re

    from editwarden.llm.licenses import KEYWORDS, normal as clean
    assert {p for _, parts in RULES for p in parts} <= set(SENTENCES)
    known = [s for many in SENTENCES.values() for s in many]
    assert len(known) == len(set(known)) and all(re.search(KEYWORDS, s) for s in known)
    frame = spark.createDataFrame([(s,) for s in known], "s string")
    assert [r for r in frame.withColumn("c", clean(F.col("s"))).collect() if r.s != r.c] == []


# --- language

def speech(language, words, seed):
    parts = {"en": ["th", "er", "ing", "on", "the"], "de": ["sch", "ung", "ei", "ß", "der"], "fr": ["eau", "é", "oi", "ment", "le"]}[language]
    r = random.Random(seed)
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(words))


def test_language_accuracy_and_rejection(spark):
    rows = [(i, speech(lang, random.Random(i).randint(3, 80), i), lang, "s", 0, "x", "y", 1) for i in range(450) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(1000, None, "en", "s", 0, "x", "y", 1), (1001, "", "en", "s", 0, "x", "y", 1), (1002, "123 !!", "en", "s", 0, "x", "y", 1), (1003, speech("de", 300_000, 7), None, "s", 0, "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = train(docs)
    assert model.languages == ["de", "en", "fr"]
    out = identified(docs, model).withColumn("held", held_out()).collect()
    test = [r for r in out if r.held and r.doc_id < 1000]
    assert len(test) > 100 and sum(r["__lang_pred"] == r.lang for r in test) >= 0.97 * len(test)
    odd = {r.doc_id: (r["__lang_pred"], r["__score"], r["__rejected"]) for r in out if r.doc_id >= 1000}
    assert odd[1000] == odd[1001] == odd[1002] == ("und", 0.0, True)
    assert odd[1003][0] == "de" and not odd[1003][2]
    assert all(0 <= r["__score"] <= 1 for r in out)
    again = identified(docs, train(docs)).collect()
    assert {(r.doc_id, r["__score"]) for r in again} == {(r.doc_id, r["__score"]) for r in out}
    stage = with_language(docs)
    assert stage.columns == docs.columns and stage.count() >= 440


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "some text"), (2, None)], lang=None)
    assert train(docs) is None
    assert [r.doc_id for r in with_language(docs).collect()] == [1]
    assert with_language(documents(spark, [])).count() == 0


# --- mixing

def targets_by_rounds(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in open_}}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark):
    random.seed(2)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 7, 30, random.randint(1, 900)])), random.choice(["a", "b", "c", "d", None])) for i in range(800)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (9002, "w " * 50_000, "b")] + [(9100 + i, "w w w", "c") for i in range(500)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, "x", "y", 1) for d, t, s in rows], DOCS)
    got = mix_sources(docs).collect()
    source = {d: s for d, _, s in rows}
    sizes, taken = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    wanted = targets_by_rounds(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    key = lambda r: (r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken)
    assert sorted(map(key, mix_sources(docs.repartition(7)).collect())) == sorted(map(key, got))
    stage = mixed(docs)
    assert [c for c in stage.columns if c not in ("copies", "taken")] == [c for c in docs.columns if c != "copies"]
    assert {(r.doc_id, r.taken) for r in stage.collect()} == {(r.doc_id, r.taken) for r in got if r.copies}
    assert mix_sources(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0


def test_mix_of_repeated_and_unnamed_rows(spark):
    rows = [(None, "w " * 9, "a")] * 40 + [(5, "w " * 7, "a")] * 40 + [(5, "v " * 7, "a")] * 30 + [(i, "w w w", "b") for i in range(100, 300)] + [(None, None, None)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, "x", "y", 1) for d, t, s in rows], DOCS).withColumnRenamed("number", "SUB")
    all_rows = mix_sources(docs).collect()
    assert len(all_rows) == len(rows)
    taken = Counter()
    stage = mixed(docs)
    assert [c for c in stage.columns if c not in ("copies", "taken")] == [c for c in docs.columns if c != "copies"]
    got = stage.collect()
    for r in got:
        assert r.copies in (1, 2) and r.taken == r.copies * len((r.text or "").split())
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in all_rows if r.copies)
    wanted = {r.source_size: r.target for r in all_rows}
    assert abs(taken["a"] - wanted[850]) <= 7 and abs(taken["b"] - wanted[600]) <= 2
    assert Counter((r.doc_id, r.text, r.taken) for r in mixed(docs.repartition(5)).collect()) == Counter((r.doc_id, r.text, r.taken) for r in got)


def test_length_counts_meet_the_budget():
    random.seed(6)
    for _ in range(200):
        lengths = sorted(random.sample(range(1, 60), random.randint(1, 6)))
        counts = [random.randint(1, 4) for _ in lengths]
        total = sum(a * c for a, c in zip(lengths, counts))
        wanted = random.randint(0, total)
        taken = fit_lengths(lengths, counts, wanted)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        # best sum that adds to the even share of each length
        base = [c * wanted // total for c in counts]
        reach = {sum(a * b for a, b in zip(lengths, base))}
        for a, c, b in zip(lengths, counts, base):
            reach |= {r + a * k for r in reach for k in range(c - b + 1)}
        assert sum(a * t for a, t in zip(lengths, taken)) == max(r for r in reach if r <= wanted)


# --- leaks

def least_by_table(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    random.seed(9)
    for _ in range(300):
        item = "".join(random.choices("abc", k=random.randint(1, 80)))
        text = "".join(random.choices("abc", k=random.randint(0, 100)))
        assert least_distance(letter_masks(item), len(item), text) == least_by_table(item, text)


def test_leaks_against_brute_force(spark):
    random.seed(10)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(2, 6))) for _ in range(200)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(8, 40)))) for k in range(12)]
    items += [(12, None), (13, ""), (14, "too short"), (0, items[0][1])]
    rows = []
    for i in range(60):
        w = random.choices(vocabulary, k=random.randint(0, 150))
        if i % 2:
            passage = list(random.choice(items[:12])[1])
            for _ in range(random.randint(0, 14)):
                passage[random.randrange(len(passage))] = random.choice("abc ")
            w.insert(random.randint(0, len(w)), "".join(passage).upper() if i % 4 == 1 else "\n".join("".join(passage).split()))
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "x" * 100_000), (103, items[3][1]), (104, items[3][1])]
    expected = {}
    for d, t in rows:
        found = {k for k, x in items if len(normal(x)) >= 24 and least_by_table(normal(x), normal(t)) <= budget(normal(x))}
        found |= {14} if "too short" in normal(t) else set()
        expected[d] = (bool(found), len(found), sorted(found))
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    assert {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in leaked(docs, bench).collect()} == expected
    stage = without_leaks(docs, bench)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == {d for d, (hit, _, _) in expected.items() if not hit}
    assert leaked(docs, bench.limit(0)).where("contaminated").count() == 0 and leaked(docs.limit(0), bench).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_short_and_unnamed_items_and_rows(spark):
    items = [(1, "What is 2 + 2?"), (2, "né"), (None, "an item of no name, but long enough"), (3, " \n ")]
    long = "an item of no name, but long enough"
    rows = [(1, "so WHAT is\n2 + 2? Four"), (2, "somewhat is 2 + 2?"), (3, "what is 2 + 22"), (4, "(né)"), (5, "néé né1 1né"), (None, f"x {long} y"), (None, "clean"),
            (6, long), (6, "clean"), (7, f"né, {long}")]
    expected = [(1, True, 1, [1]), (2, False, 0, []), (3, False, 0, []), (4, True, 1, [2]), (5, False, 0, []), (None, True, 1, []), (None, False, 0, []),
                (6, True, 1, []), (6, False, 0, []), (7, True, 2, [2])]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(str, map(tuple, leaked(docs, bench).collect()))) == sorted(map(str, expected))
    kept = [t for (_, t), e in zip(rows, expected) if not e[1]]
    assert sorted(r.text for r in without_leaks(docs, bench).collect()) == sorted(kept)


def test_pieces_cover_the_item():
    for many in range(24, 300):
        item = "x" * many
        cut = pieces(item)
        assert len(cut) == budget(item) + 1 and "".join(p for _, p in cut) == item and min(len(p) for _, p in cut) >= 10
