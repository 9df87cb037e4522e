"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from firstdue.llm import simhash
from firstdue.llm.components import components

DOCS = "doc_id long, text string, component_id string"


def slow_fingerprint(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = [w for w in words.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, bits=2):
    """Smallest id of the group of each row, over all pairs."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_of_texts():
    rng = random.Random(1)
    words = ["a", "Bé", "c\x1cd", "ÉÀ", "x-y"]
    for n in [0, 1, 2, 3, 4, 300, 900]:
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b", "  "]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("bucket", [2, 32])
@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket, bits):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bits)
    prints = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
            prints.append(centre ^ flips)
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = dict(components(simhash.link_fingerprints(df, bits)).collect())
    named = {s: i for i, s in enumerate(signed)}
    got = [named[roots.get(s, s)] for s in signed]
    expected = groups(list(range(len(prints))), prints, bits)
    # Same partition of the fingerprints, whatever represents a group.
    assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected))


def test_rows_with_holes_and_copies(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (5, text, "x"), (3, text, None), (None, text, "x"), (7, None, None), (6, "", "y"),
        (6, "", "y"), (None, "quite another text that nobody has", None), (9, "two words", "z"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (None, 3), (7, 6), (6, 6), (None, None), (9, 9)}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(
        f"Row(doc_id={i})" for i in (3, 6, 9, None)
    )
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_query_equals_brute_force(spark, folder):
    from firstdue.llm.queries import QUERIES
    from firstdue.llm.registry import table

    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    expected = zip([r.doc_id for r in rows], prints, groups([r.doc_id for r in rows], prints), strict=True)
    got = QUERIES["op10_simhash"](spark, folder).collect()
    assert {tuple(r) for r in got} == {(i, f"{p:016x}", c) for i, p, c in expected}
    assert len(got) == len(rows)
