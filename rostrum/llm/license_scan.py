"""License scans by an exact set-similarity join of text blocks with license templates, all in DataFrame operations.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. A template of n words is compared with the blocks
of 2n words that start at every n-th word, so each contiguous copy lies in a block. A block matches if it holds `threshold`
of the template's distinct words or more: that is the one condition, for every template and at every size, and all matches count.
The join's filters drop nothing that could match:

* the templates' words are ordered by how often they stand in all documents, rarest first;
* prefix: a block must hold one of the first |T| - need + 1 words of the template, and likewise of its own;
* length: it must have `need` template words at all;
* position: from the first common word on, both sides must have enough words left to reach `need`.

A text with such words gives one row for each template and block to compare, so a text's work grows with its length, and the
comparisons are plain columns. Base labels come from fixed phrases wherever their words stand consecutively; so do further labels from
short forms, which are too short for a share of their words to mean much.

`best_labels` holds what is told apart further: labels of phrases and short forms, and of those matches that also hold ORDERED of the
template's pairs of adjacent words and aren't beaten by a rival. Templates of different labels that share ALIKE of the smaller one's
words or more are rivals: of their matches in blocks that overlap, those with the largest containment, then with most
words in common, stay. So a notice of the lesser license isn't one of the general license too; equal ones both stay.

The templates are a parameter. Their words, in a table of hash buckets, and the index of prefix words are literals of the
expression, so a word is looked up in one bucket, however many templates there are. Only matches are shuffled.

Null or empty texts have no words: counts of 0, null starts, no labels, score 0. Each repeated row gets its own result. Further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import cut

THRESHOLD = 0.8
ORDERED = 0.6
ALIKE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as their licenses word them.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("ecl", "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is and the author disclaims all warranties"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("artistic", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("mulan", "is licensed under Mulan PSL v2. You can use this software according to the terms and conditions of the Mulan PSL v2."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: Common short forms.
SHORT_FORMS = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("osl", "Licensed under the Open Software License version 3.0"),
    ("afl", "Licensed under the Academic Free License version 3.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("bsl", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
)


def split_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Template:
    label: str
    words: list[str]

    @property
    def distinct(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return sorted(set(zip(self.words, self.words[1:], strict=False)))

    def need(self, threshold: float) -> int:
        """Distinct words that a match holds at least."""
        return max(1, math.ceil(threshold * len(self.distinct) - 1e-9))


def spelled(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    return [Template(label, w) for label, text in templates if (w := split_words(text))]


def rivals(known: list[Template]) -> list[list[int]]:
    """Of each template those of another label that share ALIKE of the smaller one's words."""
    sets = [set(t.words) for t in known]
    alike = lambda a, b: len(sets[a] & sets[b]) >= ALIKE * min(len(sets[a]), len(sets[b]))
    return [[j for j in range(len(known)) if known[j].label != t.label and alike(i, j)] for i, t in enumerate(known)]


def _literal(value: list, kind: str) -> Column:
    """A constant of any size, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _strings(values: list[str]) -> Column:
    return _literal(values, "array<string>")


def token_counts(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of `tokens` (the templates' words) stands in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text")), BETWEEN)).alias("w")).where(F.col("w").isin(tokens))
    return {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def license_scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, short_forms: tuple[tuple[str, str], ...] = SHORT_FORMS,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches, best_labels for each row of `docs` (doc_id, text).

    score: 1 where a phrase or short form stands, else the largest containment of a match, else 0; n_matches: templates and blocks that match.
    """
    known = spelled(templates)
    phrases = [(label, p.split()) for p, label in PHRASES.items()]
    forms = [(t.label, t.words) for t in spelled(short_forms)]
    own = sorted({w for t in known for w in t.words})
    counts = token_counts(docs, own)
    order = sorted(own, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    need = [t.need(threshold) for t in known]
    sets = [sorted(rank[w] for w in t.distinct) for t in known]
    prefix = [s[: len(s) - k + 1] for s, k in zip(sets, need, strict=True)]
    heads = {order[r] for p in prefix for r in p}
    firsts = {p[0] for _, p in (*phrases, *forms)}
    # numbers of all words that matter: template words by rank, then those of the phrases only
    number = rank | {w: len(rank) + i for i, w in enumerate(sorted({w for _, p in (*phrases, *forms) for w in p} - set(rank)))}

    lowered = docs.select("doc_id", "text", F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), BETWEEN), "").alias("words"))
    # lower() also folds letters beyond A-Z, so it finds all texts that may match; those are split again exactly
    may = F.arrays_overlap("words", _strings(sorted(heads | firsts)))
    exact = F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN), "")
    rows = lowered.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(may, numbered(exact, number)).alias("words"))
    rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")))
    begins = _flags([number[w] for w in firsts], len(number))
    rows = rows.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(begins, F.get("words", i))))
    at = {f"at_{i}": _places([number[w] for w in p]) for i, (_, p) in enumerate((*phrases, *forms))}
    rows = rows.select("row", "doc_id", "n_words", "words", *(c.alias(k) for k, c in at.items()))
    base, short = list(at)[: len(phrases)], list(at)[len(phrases) :]
    labels = lambda names, of: F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, (label, _) in zip(names, of, strict=True))))
    starts = F.array_distinct(F.flatten(F.array_compact(F.array(*base))))
    rows = cut(rows.select("row", "doc_id", "n_words", "words", starts.alias("starts"), labels(base, phrases).alias("base"), labels(short, forms).alias("short")), "words")

    found = cut(_matches(rows.where("words is not null").select("row", "words"), known, sets, need, prefix, rank), "matches")
    name = F.get(_strings([t.label for t in known]), "t")
    share = F.col("common") / F.col("size")
    of = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.collect_set(name).alias("more"), F.max(share).alias("share"))
    best = _without_rivals(found.where(F.col("pairs") >= F.ceil(F.lit(ORDERED) * F.col("all_pairs") - 1e-9)), known).groupBy("row").agg(F.collect_set(name).alias("best"))
    # matches grow with the documents, so they aren't broadcast however few they look
    joined = rows.drop("words").join(of.hint("merge"), "row", "left").join(best.hint("merge"), "row", "left")
    none = F.array().cast("array<string>")
    spell = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.coalesce(c, none) for c in of)))), ",")
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        spell("base").alias("base_labels"), spell("base", "short", "more").alias("labels"),
        F.when((F.size("base") > 0) | (F.size("short") > 0), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n", F.lit(0)).alias("n_matches"), spell("base", "short", "best").alias("best_labels"),
    )


def numbered(words: Column, number: dict[str, int]) -> Column:
    """Each word's number, -1 for others: a word is compared with those of its bucket only."""
    size = 1 << max(8, (2 * len(number)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for w, i in number.items():
        buckets[zlib.crc32(w.encode()) % size].append({"w": w, "i": i})
    table = _literal(buckets, "array<array<struct<w: string, i: int>>>")
    found = lambda w: F.filter(F.get(table, F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int")), lambda e: e["w"] == w)
    return F.transform(words, lambda w: F.coalesce(F.get(found(w), F.lit(0))["i"], F.lit(-1)))


def _flags(numbers: list[int], of: int) -> Column:
    have = set(numbers)
    return _literal([i in have for i in range(of)], "array<boolean>")


def _places(phrase: list[int]) -> Column:
    """Where the words of `phrase` stand consecutively, of the places in `begins`."""

    def stands(i: Column) -> Column:
        out = F.lit(True)
        for j, w in enumerate(phrase):
            out = out & (F.coalesce(F.get("words", i + j), F.lit(-1)) == w)
        return out

    return F.filter("begins", stands)


def _matches(texts: DataFrame, known: list[Template], sets: list[list[int]], need: list[int], prefix: list[list[int]], rank: dict[str, int]) -> DataFrame:
    """row, t, k, common, size, pairs, all_pairs: the templates and blocks that match, of (row, words: numbers)."""
    own_of: list[list[int]] = [[] for _ in rank]
    for t, p in enumerate(prefix):
        for r in p:
            own_of[r].append(t)
    owners, size = _literal(own_of, "array<array<int>>"), _literal([len(t.words) for t in known], "array<int>")
    wide, of = len(rank) + 1, len(known)
    pairs_of = [[wide * rank[a] + rank[b] for a, b in t.pairs] for t in known]
    is_template = lambda x: (x >= 0) & (x < len(rank))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.size(F.get(owners, F.get("words", i))) > 0)

    def at(i: Column) -> Column:
        """Templates and blocks of 2n words around a word, each as one number."""
        block = lambda t, back: (F.greatest((i / F.get(size, t)).cast("long") - back, F.lit(0)) * of + t)
        return F.flatten(F.transform(F.get(owners, F.get("words", i)), lambda t: F.array(block(t, 0), block(t, 1))))

    pairs = texts.select("row", "words", F.explode(F.array_distinct(F.flatten(F.transform(places, at)))).alias("at"))
    pairs = pairs.select("row", "words", (F.col("at") % of).cast("int").alias("t"), F.floor(F.col("at") / of).cast("int").alias("k"))
    get = lambda values, kind: F.get(_literal(values, f"array<{kind}>"), "t")
    n = F.get(size, "t")
    blocks = pairs.select("row", "t", "k", F.slice("words", F.col("k") * n + 1, 2 * n).alias("block"), get(need, "int").alias("need"))
    # length
    ranks = F.sort_array(F.array_distinct(F.filter("block", is_template)))
    blocks = blocks.withColumn("r", ranks).where(F.size("r") >= F.col("need"))
    # prefix, position
    first = F.array_min(F.array_intersect(get(prefix, "array<int>"), F.slice("r", 1, F.greatest(F.size("r") - F.col("need") + 1, F.lit(0)))))
    own = get(sets, "array<int>")
    left = lambda a: F.size(a) - F.array_position(a, F.col("first")).cast("int") + 1
    blocks = blocks.withColumn("first", first).where(F.col("first").isNotNull()).where(F.least(left(own), left(F.col("r"))) >= F.col("need"))
    blocks = blocks.withColumn("common", F.size(F.array_intersect(own, F.col("r")))).where("common >= need")
    # a pair of adjacent words as one number
    last = F.concat(F.slice("block", 2, F.size("block")), F.array(F.lit(-1)))
    adjacent = F.zip_with("block", last, lambda a, b: F.when(is_template(a) & is_template(b), a * wide + b).otherwise(-1))
    return blocks.select(
        "row", "t", "k", "common", F.size(own).alias("size"), F.size(F.array_intersect(get(pairs_of, "array<int>"), adjacent)).alias("pairs"), get([len(t.pairs) for t in known], "int").alias("all_pairs"),
    )


def _without_rivals(found: DataFrame, known: list[Template]) -> DataFrame:
    """The matches without those that a rival's match in an overlapping block beats. A match looks for its rivals' blocks by
    their numbers, of which a template's length allows a few."""
    size, against = _literal([len(t.words) for t in known], "array<int>"), _literal(rivals(known), "array<array<int>>")
    n, m = F.get(size, "t"), F.get(size, "u")
    asked = found.select("row", "t", "k", "common", (F.col("common") / F.col("size")).alias("share"), F.explode(F.get(against, "t")).alias("u"))
    begin, end = F.col("k") * n, (F.col("k") + 2) * n
    overlapping = F.sequence(F.greatest(F.floor(begin / m).cast("int") - 1, F.lit(0)), F.floor((end - 1) / m).cast("int"))
    asked = asked.select("row", "t", "k", "common", "share", "u", F.explode(overlapping).alias("v"))
    other = found.select("row", F.col("t").alias("u"), F.col("k").alias("v"), F.col("common").alias("has"), (F.col("common") / F.col("size")).alias("holds"))
    better = (F.col("holds") > F.col("share")) | ((F.col("holds") == F.col("share")) & (F.col("has") > F.col("common")))
    beaten = asked.join(other.hint("merge"), ["row", "u", "v"]).where(better).select("row", "t", "k").distinct()
    return found.join(beaten.hint("merge"), ["row", "t", "k"], "left_anti")
