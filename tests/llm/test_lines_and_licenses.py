"""Line dedup against all pairs, licence scan on hand-made texts."""

import random
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from firstdue.llm import licenses, line_dedup
from firstdue.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, line string, kept string"


def levenshtein(a, b):
    return duckdb.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0]


def expected(docs, bits=4, similarity=0.8):
    """Cleaned texts by comparing all pairs of different normalised lines."""
    first = {}
    for doc, text in docs:
        for n, line in enumerate(text.split("\n")):
            if plain := line_dedup.normalise(line):
                first.setdefault(plain, (doc, n))
    plains = sorted(first)
    sims = [line_dedup.line_hash(p.encode().split()) for p in plains]
    root = list(range(len(plains)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(plains)):
        for j in range(i):
            d = sum((x ^ y).bit_count() for x, y in zip(sims[i], sims[j], strict=True))
            longest = max(len(plains[i]), len(plains[j]))
            if d <= bits and levenshtein(plains[i], plains[j]) <= int((1 - similarity) * longest + 1e-9):
                root[find(i)] = find(j)
    best = {}
    for i, p in enumerate(plains):
        r = find(i)
        best[r] = min(best.get(r, first[p]), first[p])
    stay = set(best.values())
    return {
        doc: "\n".join(
            line for n, line in enumerate(text.split("\n"))
            if (doc, n) in stay or not line_dedup.normalise(line)
        )
        for doc, text in docs
    }


def made_docs():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "kmpst" for b in ("an", "el", "or", "ita", "umo")]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 9, 120, 150, 200)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            line = rng.choice(base).split(" ")
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ".join(line), " ".join(line).upper() + "!", ""]))
        docs.append((d, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("bucket", [2, 64])
def test_lines_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    docs = made_docs()
    df = spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    want = expected(docs)
    exact = expected(docs, -1)
    assert got == want and want != exact  # some lines go that are near, not equal


@pytest.mark.parametrize("similarity", [0.97, 0.99, 0.995])
def test_links_beyond_a_tree(spark, monkeypatch, similarity):
    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "kmpst" for b in ("an", "el", "or", "ita", "umo")]
    base = [rng.choice(words) for _ in range(300)]
    docs = []
    for d in range(40):
        line = list(base)
        for _ in range(rng.randrange(1, 4)):
            line[rng.randrange(300)] = rng.choice(words)
        docs.append((d, " ".join(line)))
    df = spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, similarity=similarity).collect()}
    assert got == expected(docs, similarity=similarity)


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_equal_all_pairs_of_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(6)]
    sims = [base[i % 6] for i in range(90)]
    # The first bit of either half, which is the sign of a long, differs in many.
    sims = [s ^ sum({1 << rng.choice([127, 63, rng.randrange(128)]) for _ in range(rng.randrange(6))}) for s in sims]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(s >> 64), signed(s & (1 << 64) - 1)) for k, s in enumerate(sims)]
    lines = spark.createDataFrame(rows, "key long, high long, low long")
    pairs, crowded = line_dedup.candidate_links(lines)
    roots = spark.createDataFrame([], "key long, root long")
    found = {(r.a, r.b) for r in pairs.collect()}
    beyond = {(r.a, r.b) for r in line_dedup.links_across(crowded, roots).collect()}
    want = {
        (i, j) for j in range(90) for i in range(j) if (sims[i] ^ sims[j]).bit_count() <= 4
    }
    assert found | beyond == want and (not beyond) == (bucket == 64)


def test_many_variants_of_one_line(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "kmpst" for b in ("an", "el", "or") for c in ("ita", "umo")]
    base = [rng.choice(words) for _ in range(400)]
    docs = [(d, " ".join(base[: d % 400] + [f"w{chr(97 + d // 400)}"] + base[d % 400 + 1 :])) for d in range(1000)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS)
    kept = line_dedup.dedup_lines(df).filter("text <> ''").count()
    assert kept < 50


@pytest.mark.parametrize("words", [1, 2, 3, 8, 30])
def test_edited_lines_are_found_whatever_their_bits(spark, words):
    """Against edit similarity alone, SimHash not asked."""
    rng = random.Random(words)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    docs = []
    for d in range(60):
        line = [word() for _ in range(words)]
        docs.append((3 * d, " ".join(line)))
        plain = list(" ".join(line))
        for copy in (1, 2):
            for _ in range(max(1, len(plain) // 30)):
                plain[rng.randrange(len(plain))] = rng.choice(letters)
            docs.append((3 * d + copy, "".join(plain)))
    df = spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, anchored=True).collect()}
    want = expected(docs, 128)
    assert got == want and sum(t == "" for t in want.values()) > 5


def test_short_lines_share_a_segment_with_all_near_ones():
    rng = random.Random(2)
    for _ in range(3000):
        line = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
        other = list(line)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
        other = "".join(other)
        longest = max(len(line), len(other))
        if not other or longest > 24 or levenshtein(line, other) > int(0.2 * longest + 1e-9):
            continue
        one, two = ({(k, x[a:b]) for k, a, b in line_dedup._segments(len(x), 0.8)} for x in (line, other))
        assert one & two


def hashed(texts):
    rows = range(len(texts))
    table = pa.table({"__id": pa.array(rows, pa.int64()), "__hash": pa.array(rows, pa.int64()), "text": texts})
    return [r for b in line_dedup._lines(iter(table.to_batches())) for r in b.to_pylist()]


def test_lines_are_hashed_as_one_by_one(monkeypatch):
    """Many lines at once give what each gives alone, by normalise and a plain count of bits."""
    rng = random.Random(8)
    odd = "aB1 _-\t\r\x0b\x00\x85 ΣσςİıßÅ٣²½Ⅷ中文字ﬃ𝟘𝐀\u0307\u0345.é\n "
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(90))) for _ in range(150)]
    texts += [" ".join(str(rng.random()) for _ in range(n)) for n in (63, 64, 127, 128, 254, 255, 600)]
    texts += ["", "\n\n", "___", "x " * 2000]
    want = []
    for row, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            if not (plain := line_dedup.normalise(line)):
                continue
            words = plain.encode().split()
            halves = np.array([divmod(xxhash.xxh3_128_intdigest(w), 1 << 64) for w in words], np.uint64)
            pairs = line_dedup._pair_hashes(halves[:-1], halves[1:])
            numbers = [int(a) << 64 | int(b) for a, b in [*halves, *pairs]]
            sim = sum(1 << k for k in range(128) if 2 * sum(x >> k & 1 for x in numbers) > len(numbers))
            want.append((row, n, xxhash.xxh3_64_intdigest(plain), sim >> 64, sim & (1 << 64) - 1))
    for size in (50, 1 << 20):
        monkeypatch.setattr(line_dedup, "HASHED", size)
        got = [(r["__id"], r["line"], *(r[c] % (1 << 64) for c in ("key", "high", "low"))) for r in hashed(texts)]
        assert got == want


def test_a_word_of_many_lines_is_hashed_once(monkeypatch):
    """Lines are normalised together, and words that come again are looked up: a call for each took most of the time."""
    calls = {"words": 0, "lines": 0}

    def counted(name, function):
        def run(value):
            calls[name] += 1
            return function(value)

        return run

    monkeypatch.setattr(line_dedup.xxhash, "xxh3_128_digest", counted("words", xxhash.xxh3_128_digest))
    monkeypatch.setattr(line_dedup, "normalise", counted("lines", line_dedup.normalise))
    assert len(hashed(["Ein Wort, zwei Wörter.\n" * 500] * 2)) == 1000
    assert calls == {"words": 4, "lines": 0}


def test_characters_of_which_normalise_leaves_something():
    for c in map(chr, range(sys.maxunicode + 1)):
        assert bool(line_dedup._SOME.search(c)) == bool(line_dedup.normalise(c)), c


def test_lines_of_odd_rows(spark):
    rows = [
        (1, "A line, with 12 words.\n\n---\nother", "", None), (2, "a LINE with 34 words", None, ""),
        (2, "a LINE with 34 words", None, ""), (3, None, None, None), (4, "", None, None),
        (None, "other", None, None),
    ]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got])) == sorted(
        map(str, [
            (1, "A line, with 12 words.\n\n---", 4, 1), (2, "", 1, 1), (2, "", 1, 1), (3, None, 1, 0),
            (4, "", 1, 0), (None, "other", 1, 0),
        ])
    )
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_query_equals_brute_force(spark, folder):
    import hashlib

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    lines = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            lines.setdefault(line_dedup.normalise(line), 0)
    want = expected(sorted((r.doc_id, r.text) for r in rows))
    got = {r.doc_id: r.text_md5 for r in QUERIES["op5_line_dedup"](spark, folder).collect()}
    assert got == {d: hashlib.md5(t.encode()).hexdigest() for d, t in want.items()}


MIT = (
    "MIT License\n\nCopyright (c) 2020 A. Person\n\n"
    + licenses.SENTENCES["mit-grant"].capitalize() + ":\n\n"
    + licenses.SENTENCES["mit-notice"].capitalize() + ".\n\n"
    + licenses.SENTENCES["as-is"].upper().replace(" AS IS ", ' "AS IS", ') + "."
)


@pytest.mark.parametrize(
    ("text", "known", "names"),
    [
        (None, 0, []), ("", 0, []), ("the license of nobody.", 0, []),
        ("x\ny.\nReleased under the MIT License.", 1, ["MIT"]),
        (MIT, 4, ["MIT"]), (MIT.replace("\n\n", " . "), 4, ["MIT"]),
        ("Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", 2, ["CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0.\nfoo. This work is licensed under the "
         "GNU General Public License, version 3", 2, ["Apache-2.0", "GPL-3.0"]),
        # Only the notice: known, but no rule begins with it.
        (licenses.SENTENCES["mit-notice"], 1, []),
    ],
)
def test_licences(spark, text, known, names):
    df = spark.createDataFrame([(1, text, "keep")], "doc_id long, text string, sequence string")
    row = licenses.scan_licenses(df).collect()[0]
    assert (row.n_known, row.licenses) == (known, names)


@pytest.mark.parametrize(
    ("text", "known", "names"),
    [
        ("some words\nLicensed under CC BY-NC 4.0.", 1, ["CC-BY-NC-4.0"]),
        ("| a | b |\r\nLicensed under CC BY 4.0\r\nmore words", 1, ["CC-BY-4.0"]),
        ("# Copyright (c) 2020 A\n#\n# Licensed under the Apache License, Version 2.0\n# (the "
         '"License");\n# you may not use this file except in compliance\n# with the License.\n',
         2, ["Apache-2.0"]),
        ("MIT License\nCopyright (c) 2020 A. Person", 1, ["MIT"]),
        ("words, not\nreleased under\n  the MIT License\nhere", 1, ["MIT"]),
        # Inside a line, or across the end of a sentence, it is not one.
        ("it is licensed under CC BY 4.0\nor so", 0, []), ("Licensed under. CC BY 4.0", 0, []),
        ("MIT License\n" + "filler\n" * 9 + "MIT License", 2, ["MIT"]),
    ],
)
def test_licences_of_lines(spark, text, known, names):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scan_licenses(df).collect()[0]
    assert (row.n_known, row.licenses, "|" in row.sequence) == (known, names, "filler" in text)


def test_many_licence_lines_in_one_text(spark):
    text = "Licensed under CC BY 4.0\n" * 20_000 + "filler\n" * 9 + "MIT License\n" * 20_000
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (row.n_known, row.licenses, row.sequence.count("|")) == (40_000, ["CC-BY-4.0", "MIT"], 1)


def test_lines_find_what_sentences_find(spark, folder):
    both = QUERIES["op6_licenses"](spark, folder).alias("a").join(
        QUERIES["op6_license_lines"](spark, folder).alias("b"), "doc_id"
    ).selectExpr("a.n_known as x", "b.n_known as y", "a.sequence as s", "b.sequence as t").collect()
    assert all(r.y > r.x or (r.y, r.t) == (r.x, r.s) for r in both)
    assert sum(r.x for r in both) > 0


def test_order_and_gaps(spark):
    grant, notice = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-notice"]
    far = ". ".join([grant, *["filler words"] * 6, notice])
    df = spark.createDataFrame([(1, far), (2, f"{notice}. {grant}")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert "|" in rows[1].sequence and rows[1].licenses == [] and rows[2].licenses == []
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_every_rule_names_known_sentences():
    assert {x for _, seq in licenses.RULES for x in seq} <= set(licenses.SENTENCES)
    words = licenses.keywords(list(licenses.SENTENCES.values()))
    assert all(set(s.split()) & set(words) for s in licenses.SENTENCES.values())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    from oracle import compare, connect

    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
