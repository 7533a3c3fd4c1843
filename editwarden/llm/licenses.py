"""Licences by recognised sentences and ordered rules (operator 5). DataFrame functions only.

Comment marks at the beginning of lines are taken off. A text is cut into sentences at blank lines and at sentence marks before white
space, so a sentence may be wrapped over lines. Those with a keyword of licences are normalised and looked up among the known licence
sentences; of one that is not known, each line is looked up (notices and titles often stand on a line without a mark). The identifiers
of a document, in order, are matched against the rules, first rule first. What a rule matches is used up, what remains goes to the
next. A document can have several licences.

Each row is judged by its own text, within the scan: nothing is joined or shuffled. A null or empty text has no licence; rows without a
doc_id and repeated rows get their result like all others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import ready

# Known licence sentences (as normalised below) and their identifiers.
SENTENCES = {
    "apache2-notice": ["licensed under the apache license version 2", "this work is licensed under the apache license version 2",
                       "licensed under the apache license version 2 the license"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2", "you may obtain a copy of the license at https www apache org licenses license 2",
                     "you may obtain a copy of the license at"],
    "apache2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "mit license", "the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-include": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl2-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl2-only-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
                        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "either-2": ["either version 2 of the license or at your option any later version"],
    "either-21": ["either version 2 1 of the license or at your option any later version"],
    "either-3": ["either version 3 of the license or at your option any later version"],
    "gpl-or-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-or-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl3-or-later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl21-or-later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "agpl3-or-later": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license version 2"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense-notice": ["this is free and unencumbered software released into the public domain"],
    "cc0-notice": ["licensed under cc0 1", "this work is licensed under cc0 1", "cc0 1 universal"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["licensed under the bsd license", "released under the bsd license"],
    "cc-by-nc4-notice": ["licensed under cc by nc 4", "this work is licensed under cc by nc 4", "this work is licensed under a creative commons attribution noncommercial 4 international license"],
    "cc-by-sa4-notice": ["licensed under cc by sa 4", "this work is licensed under cc by sa 4", "this work is licensed under a creative commons attribution sharealike 4 international license"],
    "cc-by4-notice": ["licensed under cc by 4", "this work is licensed under cc by 4", "this work is licensed under a creative commons attribution 4 international license"],
    "all-rights": ["all rights reserved"],
}
# Licence and the sentence identifiers it takes, longest first.
RULES = [
    ("BSD-3-Clause", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-include", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-include", "mit-as-is"]),
    ("GPL-3.0-or-later", ["gpl-or-later"]),
    ("GPL-3.0-or-later", ["gpl2-terms", "either-3"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-terms", "either-2"]),
    ("GPL-2.0-only", ["gpl2-only-terms"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "either-3"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "either-21"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("BSD", ["bsd-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("Proprietary", ["all-rights"]),
]
# every known sentence holds one of these words
KEYWORDS = "(?i)licen[cs]e|permi|redistribut|copyright|warrant|rights reserved|public domain|cc0"
# each step of the normalisation: (pattern, replacement), in this order, on lower case
STEPS = [("licence", "license"), ("[^a-z0-9]+", " "), ("\\bv(er|ersion)? ?([0-9])", "version $2"), ("([0-9]) 0\\b", "$1"), ("^ | $", "")]
# the beginning of a line with its comment marks; the text is given one line break in front
MARKS = "\n[ \\t\\r]*(?://+|/\\*+|\\*+/?|#+|;+|--+|<!--+|%+)?[ \\t\\r]*"
# white space ends a sentence after these marks
ENDING = "([.;:!?])[ \\t\\r\\n\\x0b\\x0c]+"
BLANK = "\n\n+"


def sentences(text: Column) -> Column:
    """The sentences of a text that hold a keyword, in order; they may hold line breaks."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), MARKS, "\n")
    return F.filter(F.split(F.regexp_replace(lines, ENDING, "$1\n\n"), BLANK), lambda x: x.rlike(KEYWORDS))


def normal(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def _identifier(sentence: Column) -> Column:
    """The identifier of a known sentence, else null; the catalogue is a constant of the plan."""
    known = F.create_map(*[F.lit(x) for name, many in SENTENCES.items() for s in many for x in (s, name)])
    return F.try_element_at(known, normal(sentence))


def _by_lines(sentence: Column) -> Column:
    lines = F.transform(F.filter(F.split(sentence, "\n"), lambda x: x.rlike(KEYWORDS)), _identifier)
    return F.filter(lines, lambda x: x.isNotNull())


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, found): for each sentence with a keyword the sentence and its identifiers, in order; null for a text without a keyword."""
    ready(docs.sparkSession)
    named = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), _identifier(s).alias("whole")))
    # a text without any keyword is never cut
    rows = docs.select("doc_id", F.when(F.col("text").rlike(KEYWORDS), named).alias("named"))
    identifiers = lambda x: F.when(x["whole"].isNotNull(), F.array(x["whole"])).otherwise(
        F.when(F.contains(x["sentence"], F.lit("\n")), _by_lines(x["sentence"])).otherwise(F.array().cast("array<string>")))
    return rows.select("doc_id", F.transform("named", lambda x: F.struct(x["sentence"].alias("sentence"), identifiers(x).alias("identifiers"))).alias("found"))


def licence_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, place, sentence, identifiers): the sentences with a keyword; identifiers is empty for unknown ones."""
    rows = _found(docs).select("doc_id", F.posexplode("found").alias("place", "found"))
    return rows.select("doc_id", "place", "found.sentence", "found.identifiers")


def matched(identifiers: Column) -> Column:
    """The text <identifier>... with what the rules matched written as {licence}."""
    for licence, parts in RULES:
        identifiers = F.replace(identifiers, F.lit("".join(f"<{p}>" for p in parts)), F.lit("{" + licence + "}"))
    return identifiers


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, licences): one row for each row of ``docs``; licences in order of the text, joined by commas, null if none."""
    rows = _found(docs).select("doc_id", F.size(F.coalesce("found", F.array())).cast("long").alias("n_sentences"),
                               F.flatten(F.transform("found", lambda x: x["identifiers"])).alias("ids"))
    line = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    # most documents have no identifier: the rules are not tried on them
    names = F.when(F.size("ids") > 0, F.array_join(F.regexp_extract_all(matched(line), F.lit("\\{([^}]*)\\}"), F.lit(1)), ","))
    return rows.select("doc_id", "n_sentences", F.size(F.coalesce("ids", F.array().cast("array<string>"))).cast("long").alias("n_known"),
                       F.nullif(names, F.lit("")).alias("licences"))


def licences_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(name)})" for name, many in SENTENCES.items() for s in many)
    clean = "lower(s)"
    for pattern, by in STEPS:
        clean = f"regexp_replace({clean}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    line = "line"
    for licence, parts in RULES:
        line = f"replace({line}, {quote(''.join(f'<{p}>' for p in parts))}, {quote('{' + licence + '}')})"
    lines = f"regexp_replace(chr(10) || coalesce(text, ''), {quote(MARKS)}, chr(10), 'g')"
    has = f"lambda x: regexp_matches(x, {quote(KEYWORDS)})"
    return f"""WITH known(known, identifier) AS (VALUES {known}),
cut AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace({lines}, {quote(ENDING)}, {quote(chr(92) + '1' + chr(10) * 2)}, 'g'), {quote(BLANK)}), {has}) AS l FROM documents),
picked AS (SELECT doc_id, i AS place, l[i] AS s FROM cut, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
wholes AS (SELECT doc_id, place, s, identifier FROM (SELECT *, {clean} AS clean FROM picked) LEFT JOIN known ON known = clean),
lines AS (SELECT doc_id, place, i AS line, l[i] AS s FROM (SELECT doc_id, place, list_filter(string_split(s, chr(10)), {has}) AS l FROM wholes WHERE identifier IS NULL AND contains(s, chr(10))),
  LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
named AS (SELECT doc_id, place, 0 AS line, identifier FROM wholes WHERE identifier IS NOT NULL
  UNION ALL SELECT doc_id, place, line, identifier FROM (SELECT *, {clean} AS clean FROM lines) JOIN known ON known = clean),
docs AS (SELECT doc_id, count(*) AS n_known, string_agg('<' || identifier || '>', '' ORDER BY place, line) AS line FROM named GROUP BY doc_id),
ruled AS (SELECT *, {line} AS done FROM docs)
SELECT c.doc_id, len(l)::BIGINT AS n_sentences, coalesce(n_known, 0)::BIGINT AS n_known,
  nullif(array_to_string(regexp_extract_all(done, '\\{{([^}}]*)\\}}', 1), ','), '') AS licences
FROM cut c LEFT JOIN ruled USING (doc_id)"""
