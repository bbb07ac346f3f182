"""Licence recognition by sentence rules.

Normalised sentences are looked up among known licence sentences; what is left of a document is a short sequence of
sentence identifiers, in which ordered licence rules are matched.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (identifier, sentence): known sentences of licence notices and texts.
SENTENCES = (
    ("mit.released", "Released under the MIT License."),
    ("mit.licensed", "Licensed under the MIT License."),
    ("mit.grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit.notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit.warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("apache.licensed", "Licensed under the Apache License, Version 2.0."),
    ("apache.header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache.obtain", "You may obtain a copy of the License at"),
    ("apache.warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("gpl.work", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl.free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl.hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc.by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc.by", "Licensed under CC BY 4.0."),
    ("cc.by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd.redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd.source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd.binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd.endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd.warranty", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc.warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("zlib.warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib.liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib.grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("mpl.header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl.obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense.release", "This is free and unencumbered software released into the public domain."),
    ("unlicense.grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0.waive", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("cc0.warranty", "This software is distributed without any warranty."),
    ("rights.reserved", "All rights reserved."),
)

#: (rule, licence, sentence identifiers in their order)
RULES = (
    ("mit-released", "MIT", ("mit.released",)),
    ("mit-licensed", "MIT", ("mit.licensed",)),
    ("mit-text", "MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("apache-notice", "Apache-2.0", ("apache.licensed",)),
    ("apache-header", "Apache-2.0", ("apache.header", "apache.obtain", "apache.warranty")),
    ("gpl-work", "GPL-3.0-only", ("gpl.work",)),
    ("gpl-header", "GPL-3.0-or-later", ("gpl.free", "gpl.hope")),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("cc.by-nc",)),
    ("cc-by-notice", "CC-BY-4.0", ("cc.by",)),
    ("cc-by-work", "CC-BY-4.0", ("cc.by-work",)),
    ("bsd-2-text", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("bsd-2-whole", "BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("bsd-3-whole", "BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.warranty")),
    ("isc-text", "ISC", ("isc.grant", "isc.warranty")),
    ("0bsd-text", "0BSD", ("0bsd.grant", "isc.warranty")),
    ("zlib-text", "Zlib", ("zlib.warranty", "zlib.liable", "zlib.grant")),
    ("mpl-header", "MPL-2.0", ("mpl.header", "mpl.obtain")),
    ("unlicense-text", "Unlicense", ("unlicense.release", "unlicense.grant")),
    ("cc0-text", "CC0-1.0", ("cc0.waive", "cc0.warranty")),
    ("proprietary", "LicenseRef-proprietary", ("rights.reserved",)),
)

#: (licence, its names in notices); fixed values. Those of the GNU and the Creative Commons licences follow a rule.
NAMES = (
    ("MIT", ("the MIT License", "the Expat License")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License", "the Modified BSD License")),
    ("ISC", ("the ISC License",)),
    ("0BSD", ("the Zero-Clause BSD License",)),
    ("Zlib", ("the zlib License",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0", "the Boost Software License 1.0")),
    ("EPL-2.0", ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0")),
    ("EUPL-1.2", ("the European Union Public Licence, version 1.2", "the EUPL 1.2")),
    ("Artistic-2.0", ("the Artistic License 2.0",)),
    ("Unlicense", ("the Unlicense",)),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0")),
)
NOTICES = "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}."
GNU = ("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))
COMMONS = ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")

#: A sentence ends after . ! ? : or ; that white space follows, and at the end of a line.
_STOP = re.compile(rb"(?<=[.!?:;])[ \t]+")
_LINE = re.compile(rb"\r\n|\r|\n")
_OTHER = re.compile(rb"[^a-z0-9]+")


def normalise(sentence: bytes) -> bytes:
    """A-Z in lower case, and one space for each run of other characters than a-z and 0-9."""
    return _OTHER.sub(b" ", sentence.lower()).strip()


def pieces(text: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(number, sentence number, what is before it, normalised words) of all that a text is cut into.

    A line's end that joins is before a piece as a space, any other cut as a line end. It joins within a paragraph unless
    . ! ? : or ; ends the line. Paragraphs are bounded by lines without letters and digits (those of comment marks too); one
    whose lines all have a single word is a list. The sentence number counts pieces that join as one.
    """
    out, at, sentence, paragraph = [], -1, -1, []

    def flush():
        nonlocal at, sentence
        wrapped = any(sum(bool(normalise(w)) for w in line.split()) > 1 for line in paragraph) if len(paragraph) > 1 else False
        joins = False
        for line in paragraph:
            for k, part in enumerate(p for p in _STOP.split(line) if p):
                soft = joins and not k
                at += 1
                sentence += not soft
                out.append((at, sentence, b" " if soft else b"\n", normalise(part)))
            joins = wrapped and line[-1:] not in b".!?:;"
        paragraph.clear()

    for line in _LINE.split(text):
        line = line.strip(b" \t")
        if not line:
            flush()
        elif _OTHER.fullmatch(line.lower()):
            flush()
            parts = sum(p != b"" for p in _STOP.split(line))
            at, sentence = at + parts, sentence + parts
        else:
            paragraph.append(line)
    flush()
    return [x for x in out if x[3]]


def known_text(sentence: str) -> str:
    """A known sentence as a scan cuts it: its parts, normalised, with line ends between."""
    return b"".join(sep + words for _, _, sep, words in pieces(sentence.encode()))[1:].decode()


def _families() -> tuple[tuple, tuple]:
    """Sentences and rules of the notices of all names, the SPDX lines and the headers of the GNU licences.

    A sentence that SENTENCES has already, as a scan cuts it, keeps the identifier and the rule that it has there.
    """
    names = list(NAMES)
    texts, rules = [], []
    for short, name, versions in GNU:
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            names.append((f"{spdx}-only", (f"the {name}, version {v}", f"the {name} v{v}", f"the {short}v{v}")))
            names.append((f"{spdx}-or-later", (f"the {name}, version {v} or later", f"the {short}v{v} or later")))
            for thing in ("program", "library"):
                free, hope = f"{spdx}.{thing}", f"gnu.{short}.{thing}"
                texts.append((free, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."))
                texts.append((hope, f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."))
                rules.append((f"{spdx}-{thing}", f"{spdx}-or-later", (free, hope)))
    for short, name in COMMONS:
        for v, kind in (("4.0", "International"), ("3.0", "Unported")):
            names.append((f"CC-{short}-{v}", (f"CC {short} {v}", f"a Creative Commons {name} {v} {kind} License", f"the Creative Commons {name} {v} {kind} License")))
    for spdx, said in names:
        texts.append((f"spdx.{spdx}", f"SPDX-License-Identifier: {spdx}"))
        rules.append((f"spdx-{spdx}", spdx, (f"spdx.{spdx}",)))
        texts += [(f"notice.{spdx}", notice.format(name)) for name in said for notice in NOTICES]
        rules.append((f"notice-{spdx}", spdx, (f"notice.{spdx}",)))
    seen = {known_text(s): i for i, s in SENTENCES}
    more, same = [], {}
    for i, s in texts:
        if (cut := known_text(s)) in seen:
            same[i] = seen[cut]
        else:
            seen[cut] = i
            more.append((i, s))
    have, ruled = {i for i, _ in more}, {ids for _, _, ids in RULES}
    named = [(r, lic, tuple(i if i in have else same[i] for i in ids)) for r, lic, ids in rules]
    return tuple(more), tuple(r for r in named if r[2] not in ruled)


#: SENTENCES and RULES with those that follow a rule.
ALL_SENTENCES, ALL_RULES = (a + b for a, b in zip((SENTENCES, RULES), _families(), strict=True))


def sentence_table(spark: SparkSession, sentences=ALL_SENTENCES) -> DataFrame:
    """(sentence, sentence_id): known sentences as a scan cuts them; a long one may take several parts, a line each."""
    rows = [(known_text(text), sentence_id) for sentence_id, text in sentences]
    return spark.createDataFrame(rows, "sentence string, sentence_id string").filter("sentence <> ''").dropDuplicates(["sentence"])


def rule_table(spark: SparkSession, rules=ALL_RULES) -> DataFrame:
    return spark.createDataFrame([(r, lic, list(ids)) for r, lic, ids in rules], "rule string, license string, ids array<string>").filter("size(ids) > 0")


def _find_known(cut: list, known: dict[bytes, list[str]], order: list[bytes]) -> list[tuple[int, int, str]]:
    """(first, last, sentence_id) of the longest known sentence that starts at each piece, by first and last piece."""
    out = []
    for i in range(len(cut)):
        text, j, longest = cut[i][3], i, []
        while (k := bisect.bisect_left(order, text)) < len(order) and order[k].startswith(text):
            longest = [(i, j, s) for s in known.get(text, ())] or longest
            j += 1
            if j == len(cut):
                break
            text += cut[j][2] + cut[j][3]
        out += longest
    return out


def _match_rules(cut: list, found: list[tuple[int, int, str]], rules: dict[str, list], gap: int) -> Iterator[tuple[str, str, int, int]]:
    """(license, rule, first, last): the longest rules at each first sentence."""
    starts = [f[0] for f in found]
    least_end = [0] * len(found) + [1 << 60]  # of all that start here or later
    for k in reversed(range(len(found))):
        least_end[k] = min(least_end[k + 1], found[k][1])

    def ends(k: int, ids: tuple, n: int) -> int | None:
        if n == len(ids):
            return found[k][1]
        # What follows starts behind this one, and no other known sentence lies wholly between the two.
        behind = bisect.bisect_right(starts, found[k][1])
        for m in range(behind, len(found)):
            if starts[m] > least_end[behind] or cut[starts[m]][1] - cut[found[k][1]][1] > gap + 1:
                return None
            if found[m][2] == ids[n] and (last := ends(m, ids, n + 1)) is not None:
                return last
        return None

    best: dict[int, list] = {}
    for k, (i, _, sentence) in enumerate(found):
        for rule, license, ids in rules.get(sentence, ()):
            if (last := ends(k, ids, 1)) is not None:
                best.setdefault(i, []).append((len(ids), license, rule, last))
    for i, matches in best.items():
        longest = max(m[0] for m in matches)
        for n, license, rule, last in matches:
            if n == longest:
                yield license, rule, cut[i][0], cut[last][0]


def _scan(known: dict[bytes, list[str]], rules: dict[str, list], gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sorted(known)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py()
                if text and (found := _find_known(cut := pieces(text), known, order)):
                    rows += [(doc_id.as_py(), *match) for match in _match_rules(cut, found, rules, gap)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "rule", "first_sentence", "last_sentence"])

    return run


def scan_licenses(documents: DataFrame, sentences: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, most_known: int = 200_000) -> DataFrame:
    """(doc_id, license, rule, first_sentence, last_sentence), one row per match, for documents that have any.

    What a text is cut into (at sentence and line ends) is numbered from 0, empty parts left out. A known sentence stands
    where its parts follow one another, each of them whole, on one line or wrapped over several (see pieces()); of those
    that start at the same place the longest one counts. A rule
    matches where its sentence identifiers follow one another in the document's sequence of known sentences, with at most
    `gap` unknown ones between two; a wrapped one counts once. Of rules that match at the same first sentence the longest
    ones count (several of equal length give a row each). Null and empty texts have no match; each row of documents stands
    for itself; other columns aren't read. Both tables go to every task, at most most_known rows each (an error otherwise).
    """
    for table in (sentences, rules):
        if (n := table.limit(most_known + 1).count()) > most_known:
            raise ValueError(f"{n} known sentences or rules; made for {most_known} at most")
    known, by_first = {}, {}
    for r in sentences.select("sentence", "sentence_id").collect():
        if r["sentence"]:
            known.setdefault(r["sentence"].encode(), []).append(r["sentence_id"])
    for r in rules.select("rule", "license", "ids").collect():
        if r["ids"]:
            by_first.setdefault(r["ids"][0], []).append((r["rule"], r["license"], tuple(r["ids"])))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(known, by_first, gap), "doc_id long, license string, rule string, first_sentence int, last_sentence int")


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """All licence notices of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), sentence_table(spark), rule_table(spark))


def _oracle(gap: int = 2) -> str:
    """The same cutting, looking up and matching in SQL; known sentences are cut by the same steps as the documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {quote(i)}, {quote(s)})" for k, (i, s) in enumerate(ALL_SENTENCES))
    rules = ", ".join(f"({quote(r)}, {quote(lic)}, [{', '.join(map(quote, ids))}])" for r, lic, ids in ALL_RULES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return rf"""
WITH RECURSIVE k(n, sentence_id, text) AS (VALUES {known}), rules(rule, license, ids) AS (VALUES {rules}),
src AS (SELECT doc_id AS id, false AS known, coalesce(text, '') AS text FROM documents UNION ALL SELECT n, true, text FROM k),
cut AS (SELECT id, known, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM src),
line AS (SELECT id, known, n, l, NOT regexp_matches({low("l")}, '[a-z0-9]') AS bare FROM (SELECT id, known, trim(unnest(ls), ' ' || chr(9)) AS l, generate_subscripts(ls, 1) AS n FROM cut)),
para AS (SELECT *, sum(bare::INTEGER) OVER (PARTITION BY known, id ORDER BY n) AS p FROM line),
wrap AS (SELECT *, count(*) OVER w > 1 AND bool_or(len(list_filter(regexp_split_to_array({low("l")}, '[ \t\v\f]+'), lambda x: regexp_matches(x, '[a-z0-9]'))) > 1) OVER w AND NOT regexp_matches(l, '[.!?:;]$') AS joins
  FROM para WHERE NOT bare WINDOW w AS (PARTITION BY known, id, p)),
soft AS (SELECT known, id, n, l, coalesce(lag(joins) OVER (PARTITION BY known, id, p ORDER BY n), false) AS soft FROM wrap UNION ALL SELECT known, id, n, l, false FROM line WHERE bare AND l <> ''),
part AS (SELECT known, id, n, soft, unnest(ps) AS part, generate_subscripts(ps, 1) AS m FROM (SELECT *, string_split(regexp_replace(l, '([.!?:;])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS ps FROM soft)),
numbered AS (SELECT known, id, CASE WHEN soft AND m = 1 THEN ' ' ELSE chr(10) END AS sep, trim(regexp_replace({low("part")}, '[^a-z0-9]+', ' ', 'g')) AS words,
  row_number() OVER w - 1 AS place, sum((NOT (soft AND m = 1))::INTEGER) OVER w AS sentence FROM part WINDOW w AS (PARTITION BY known, id ORDER BY n, m)),
piece AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY known, id ORDER BY place) AS i FROM numbered WHERE words <> ''),
t AS MATERIALIZED (SELECT DISTINCT sentence_id, t, regexp_extract(t, '^[a-z0-9]+') AS word FROM (SELECT sentence_id, substr(string_agg(sep || words, '' ORDER BY i), 2) AS t FROM piece JOIN k ON n = id WHERE known GROUP BY n, sentence_id)),
grow AS (SELECT id, i AS a, i AS b, sentence_id, t, words AS so_far FROM piece JOIN t ON split_part(words, ' ', 1) = word AND starts_with(t, words) WHERE NOT known
  UNION ALL SELECT g.id, a, i, sentence_id, t, so_far || sep || words FROM grow g JOIN piece p ON p.id = g.id AND p.i = b + 1 AND NOT known AND starts_with(t, so_far || sep || words)),
found AS MATERIALIZED (SELECT DISTINCT g.id, a, b, sentence_id, x.sentence AS opens, y.sentence AS ends FROM grow g JOIN piece x ON NOT x.known AND x.id = g.id AND x.i = a JOIN piece y ON NOT y.known AND y.id = g.id AND y.i = b WHERE t = so_far QUALIFY b = max(b) OVER (PARTITION BY g.id, a)),
reach AS (SELECT f.id, f.a, f.b, min(g.b) AS most FROM found f JOIN found g ON g.id = f.id AND g.a > f.b GROUP BY ALL),
step AS MATERIALIZED (SELECT DISTINCT f.id, f.a, f.b, g.a AS a2, g.b AS b2, g.sentence_id FROM reach JOIN found f USING (id, a, b) JOIN found g ON g.id = f.id AND g.a > f.b AND g.a <= most AND g.opens - f.ends <= {gap + 1}),
walk AS (SELECT id, a AS a0, b AS b0, a, b, rule, license, ids, 1 AS n, [a, b] AS path FROM found JOIN rules ON sentence_id = ids[1]
  UNION ALL SELECT w.id, a0, b0, a2, b2, rule, license, ids, n + 1, path || [a2, b2] FROM walk w JOIN step s ON s.id = w.id AND s.a = w.a AND s.b = w.b AND s.sentence_id = ids[n + 1]),
fits AS (SELECT id, a0, rule, license, n, min(path)[-1] AS z FROM walk WHERE n = len(ids) GROUP BY id, a0, b0, rule, license, n),
best AS (SELECT * FROM fits QUALIFY n = max(n) OVER (PARTITION BY id, a0))
SELECT b.id AS doc_id, license, rule, x.place::INTEGER AS first_sentence, y.place::INTEGER AS last_sentence
FROM best b JOIN piece x ON NOT x.known AND x.id = b.id AND x.i = a0 JOIN piece y ON NOT y.known AND y.id = b.id AND y.i = z
"""


ORACLE_OP8 = _oracle()
