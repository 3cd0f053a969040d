"""License scans with a positional index over rare template words.

Every licence template is indexed by word and position. A file's licence words are
ranked by inverse document frequency over the whole corpus; the postings of its
rarest ones are intersected by relative position (file position minus template
position), so that only placements of a template that several rare words agree on
are looked at. A placement counts when enough of the template's words stand where
it says and a mandatory key phrase of the template is found there word for word.

Base labels need no placement: they are the fixed phrases below, wherever their
words stand consecutively.

Edge cases: null and wordless texts have no labels, score 0 and null first and last
word; repeated documents are judged row by row; words of equal frequency are ranked
alphabetically; very long texts are scanned whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontaminate import words_of

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> (texts, mandatory key phrases): public licence wording, the first words and whole notices or openings. Fixed values.
TEMPLATES = {
    "mit": (
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ],
        ["any person obtaining a copy of this software"],
    ),
    "apache-2": (
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
            'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
            "See the License for the specific language governing permissions and limitations under the License.",
        ],
        ["apache license version 2"],
    ),
    "bsd": (
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
            "and/or other materials provided with the distribution.",
        ],
        ["redistribution and use in source and binary forms"],
    ),
    "gpl": (
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
            "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            "See the GNU General Public License for more details.",
        ],
        ["gnu general public license"],
    ),
    "lgpl": (
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
            "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, "
            "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            "See the GNU Lesser General Public License for more details.",
        ],
        ["gnu lesser general public license"],
    ),
    "mpl-2": (
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at http://mozilla.org/MPL/2.0/.",
        ],
        ["mozilla public license"],
    ),
    "isc": (
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies."
        ],
        ["for any purpose with or without fee"],
    ),
    "unlicense": (
        [
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
            "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
        ],
        ["free and unencumbered software"],
    ),
    "zlib": (
        [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
            "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
            "subject to the following restrictions:"
        ],
        ["to alter it and redistribute it freely"],
    ),
    "cc-by": (
        ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
        ["creative commons attribution 4", "creative commons attribution international"],
    ),
    "cc-by-sa": (
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
        ["creative commons attribution sharealike"],
    ),
    "cc0": (
        [
            "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under "
            "copyright law, including all related and neighboring rights, to the extent allowed by law."
        ],
        ["dedicated the work to the public domain"],
    ),
    "all-rights-reserved": (["All rights reserved"], ["all rights reserved"]),
}
RARE = 6
COVERAGE = 0.6


def _index():
    """Postings word -> (template, position), and each template's words; a template is (label, number)."""
    postings: dict[bytes, list[tuple[tuple[str, int], int]]] = defaultdict(list)
    words = {}
    for label, (texts, _) in TEMPLATES.items():
        for k, text in enumerate(texts):
            words[label, k] = words_of(text.encode())
            for p, w in enumerate(words[label, k]):
                postings[w].append(((label, k), p))
    return dict(postings), words


def document_frequency(docs: DataFrame) -> dict[bytes, int]:
    """In how many documents each licence word occurs; a bounded vocabulary, counted over all of them."""
    vocabulary = sorted(_index()[0])
    source = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_utf8"))

    def run(batches):
        known, n, total = frozenset(vocabulary), Counter(), 0
        for batch in batches:
            texts = batch.column("_utf8")
            for k in range(batch.num_rows):
                n.update(known.intersection(words_of(texts[k].as_py())))
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *n], pa.binary()), pa.array([total, *n.values()], pa.int64())], ["word", "n"])

    rows = source.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def placements(words: list[bytes], postings: dict, templates: dict, idf: dict[bytes, float]) -> tuple[set[str], float]:
    """Labels whose template stands in the words, and the best coverage."""
    at: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in postings:
            at[w].append(i)
    if not at:
        return set(), 0.0
    votes: dict[tuple, int] = Counter()
    rare: dict[tuple[str, int], list[bytes]] = {}
    for name, text in templates.items():
        rare[name] = sorted({w for w in text if w in at}, key=lambda w: (-idf[w], w))[:RARE]
        for w in rare[name]:
            for own, p in postings[w]:
                if own == name:
                    for i in at[w]:
                        votes[name, i - p] += 1
    labels, best = set(), 0.0
    for (name, shift), n in votes.items():
        text, label = templates[name], name[0]
        if n < 2:
            continue
        same = sum(0 <= shift + p < len(words) and words[shift + p] == w for p, w in enumerate(text))
        coverage = same / len(text)
        if coverage <= best and label in labels or coverage < COVERAGE:
            continue
        near = b" " + b" ".join(words[max(0, shift) : shift + len(text)]) + b" "
        if any(b" " + phrase.encode() + b" " in near for phrase in TEMPLATES[label][1]):
            labels.add(label)
            best = max(best, coverage)
    return labels, best


def scan(docs: DataFrame) -> DataFrame:
    """Base and placed licence labels of every whole text."""
    df = document_frequency(docs)
    total = max(1, df.get(b"", 1))
    postings, templates = _index()
    idf = {w: float(np.log((total + 1) / (df.get(w, 0) + 1))) for w in postings}
    phrases = [(re.compile(rb"(?= " + k.encode() + rb" )"), v) for k, v in BASE.items()]
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_utf8"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            texts, out = batch.column("_utf8"), []
            for k in range(batch.num_rows):
                words = words_of(texts[k].as_py())
                line = b" " + b" ".join(words) + b" "
                places, base = [], set()
                for pattern, label in phrases:
                    found = [m.start() for m in pattern.finditer(line)]
                    if found:
                        places += found
                        base.add(label)
                # A word's number is that of the blanks before it.
                blanks = np.nonzero(np.frombuffer(line, np.uint8) == 32)[0] if places else np.zeros(0, np.int64)
                starts = np.searchsorted(blanks, places).tolist()
                placed, best = placements(words, postings, templates, idf)
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | placed)), 1.0 if base else best))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


#: The base columns; placements of templates have no SQL.
BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p(words, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
f AS (
  SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, words, label, unnest(range(1, len(ws) - len(words) + 2)) AS i FROM w, p WHERE len(ws) >= len(words)) WHERE ws[i:i + len(words) - 1] = words
), g AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM f GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(l, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
