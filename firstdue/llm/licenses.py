"""Licence scan by sentences: known sentences become identifiers, rules match their order.

A text is cut into sentences, and each is normalised and looked up among the known licence
sentences. What remains of the text is a short sequence of identifiers, with a break where
known sentences are far apart. Ordered rules, the longest first, are matched along it; each
identifier belongs to one match at most.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.llm.text import LOWER, UPPER, ascii_lower, blank_if_null, fenced

# Sentences of public licences, in normalised form.
SENTENCES = {
    "mit-name": "mit license",
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of "
    "this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement",
    "apache-name": "apache license",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-ref-2": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the "
    "terms of the gnu general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular "
    "purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc0-ref": "released under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this "
    "list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may "
    "be used to endorse or promote products derived from this software without specific prior "
    "written permission",
}
#: Licence of each ordered run of sentences.
RULES = (
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-ref-2", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-ref-2", "apache-comply")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-ref-2",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
)
#: Sentences between two known ones that still count as neighbours, plus one.
MAX_GAP = 4
#: What ends a sentence: a mark before white space, or an empty line.
SENTENCE_END = r"[.!?:;][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
NOT_ALNUM = r"[^0-9a-z]+"


def keywords(sentences: Sequence[str]) -> list[str]:
    """Few words such that every sentence has one of them."""
    left, chosen = [set(s.split()) for s in sentences], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (counts[w] * len(w) ** 2, w))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return chosen


def rule_pattern(rules: Sequence[tuple[str, tuple[str, ...]]], number: Mapping[str, int]) -> str:
    """One pattern for all rules over identifiers, longer ones first, any identifier last."""
    runs = sorted({seq for _, seq in rules}, key=lambda s: (-len(s), [number[x] for x in s]))
    return "(" + "|".join("".join(f"<{number[x]}>" for x in seq) for seq in runs) + "|<[0-9]+>)"


def recognise(text: Column, known: Sequence[str]) -> Column:
    """Structs (at, id) of the known sentences of a text: place and number from 1."""
    some = "|".join(map(re.escape, keywords(known)))
    low = ascii_lower(text)
    sentences = F.when(low.rlike(some), F.split(low, SENTENCE_END)).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    names = F.array(*map(F.lit, known))
    numbered = F.transform(
        sentences,
        lambda s, i: F.struct(
            i.alias("at"),
            F.array_position(names, F.btrim(F.regexp_replace(s, NOT_ALNUM, " "))).alias("id"),
        ),
    )
    return F.filter(numbered, lambda x: x["id"] > 0)


def line_pattern(known: Sequence[str]) -> str:
    """Any known sentence that begins and ends at a ``|`` or a line break, longer ones first."""
    longest = sorted(set(known), key=lambda s: (-len(s.split()), s))
    found = "|".join(r"[ \n]".join(map(re.escape, s.split())) for s in longest)
    return rf"(?<![^|\n])(?:{found})(?![^|\n])"


def recognise_lines(text: Column, known: Sequence[str]) -> Column:
    """Structs (id, gap) of the known sentences; they may begin and end with a line, too.

    ``gap`` counts the sentences, or lines, from the known one before to this one. The text
    becomes words with one blank, line break or, where a sentence ends, ``|`` between them. Known
    sentences are found in it however their lines are wrapped.
    """
    some = "|".join(map(re.escape, keywords(known)))
    low = F.translate(text, UPPER + "|", LOWER + "-")
    plain = F.regexp_replace(low, SENTENCE_END, "|")
    for pattern, by in (
        (r"[^0-9a-z|\n]+", " "), (r" ?\n[ \n]*", "\n"), (r"[ \n]+\|", "|"), (r"\|[ \n]+", "|"),
        (r"^[ \n]+|[ \n]+$", ""),
    ):
        plain = F.regexp_replace(plain, pattern, by)
    plain = fenced(F.when(low.rlike(some), plain).otherwise(""))
    pattern = line_pattern(known)
    found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    # Sentences that end between two known ones or, within one sentence, lines.
    between = F.transform(
        F.split(plain, pattern, -1),
        lambda s: F.greatest(
            F.lit(1),
            F.when(s.contains("|"), F.length(s) - F.length(F.translate(s, "|", "")))
            .otherwise(F.length(s) - F.length(F.translate(s, "\n", ""))),
        ),
    )
    names = F.array(*map(F.lit, known))
    ids = F.transform(found, lambda s: F.array_position(names, F.translate(s, "\n", " ")))
    return F.arrays_zip(ids.alias("id"), F.slice(between, 1, F.size(ids)).alias("gap"))


def scan_licenses(
    documents: DataFrame,
    sentences: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    max_gap: int = MAX_GAP,
    lines: bool = True,
) -> DataFrame:
    """``documents`` with ``n_known``, ``sequence`` and ``licenses`` of each text.

    ``n_known`` counts known sentences, ``sequence`` is their identifiers in order
    (``|`` where more than ``max_gap`` sentences lie between), ``licenses`` the sorted names of the
    licences whose rules match. A known sentence begins and ends where a sentence of the text does
    or where a line does, and may be wrapped over lines; without ``lines`` only ends of
    sentences and empty lines count. Texts are read whole. A missing or empty text has none; rows are
    handled one by one, so repeated rows repeat; input columns with the name of a new one are
    replaced.
    """
    known = list(sentences.values())
    number = {name: k for k, name in enumerate(sentences, 1)}
    kept = [c for c in documents.columns if c not in ("n_known", "sequence", "licenses")]
    names_of = recognise_lines if lines else recognise
    found = documents.select(
        *kept, fenced(names_of(blank_if_null(F.col("text")), known)).alias("__found")
    )

    def gap(x: Column, k: Column) -> Column:
        return x["gap"] if lines else x["at"] - F.get("__found", k - 1)["at"]

    steps = F.transform(
        "__found",
        lambda x, k: F.concat(
            F.when((k > 0) & (gap(x, k) > max_gap), "|").otherwise(""),
            F.lit("<"), x["id"].cast("string"), F.lit(">"),
        ),
    )
    ordered = found.select(
        *kept, F.size("__found").cast("long").alias("n_known"),
        fenced(F.array_join(steps, "")).alias("sequence"),
    )
    names = {"".join(f"<{number[x]}>" for x in seq): name for name, seq in rules}
    runs, licences = F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values()))
    matches = F.regexp_extract_all("sequence", F.lit(rule_pattern(rules, number)), 1)
    named = F.transform(matches, lambda m: F.get(licences, (F.array_position(runs, m) - 1).cast("int")))
    return ordered.withColumn(
        "licenses", F.array_sort(F.array_distinct(F.filter(named, lambda n: n.isNotNull())))
    )
