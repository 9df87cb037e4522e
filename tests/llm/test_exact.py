"""Exact duplicates against a plain loop."""

import hashlib
import random

import pytest

from firstdue.llm import exact

DOCS = "doc_id long, text string, id string, sha string, row map<string,int>"


def plain(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for text, ids in groups.items():
        last = max(ids, key=lambda i: (i is not None, i if i is not None else 0))
        sha, spare = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            kept = spare > 0 and i == last
            spare -= kept
            out.append((i, last, len(ids), kept, sha))
    return sorted(out, key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", {"z": 1}) for r in rows], DOCS).repartition(parts)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


CASES = {
    "empty": [],
    "one": [(3, "a")],
    "null and empty texts": [(1, None), (2, ""), (None, None), (4, " ")],
    "null ids": [(None, "a"), (None, "a"), (None, "b"), (7, "b")],
    "repeated rows": [(5, "a")] * 40 + [(6, "b"), (6, "b"), (1, "b")],
    "long": [(1, "x" * 2_000_000), (2, "x" * 2_000_000), (3, "x" * 1_999_999 + "y")],
}


@pytest.mark.parametrize("case", CASES)
def test_marks_equal_a_plain_loop(spark, case):
    rows = CASES[case]
    got = exact.mark_copies(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got) == plain(rows)
    kept = exact.drop_exact_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "sha", "row"]
    wanted = sorted((i, s) for i, _, _, k, s in plain(rows) if k and i is not None)
    found = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(x for x in found if x[0] is not None) == wanted
    assert len(found) == len({s for *_, s in plain(rows)})


@pytest.mark.parametrize("tracked", [8, 64, 10_000])
def test_the_way_a_row_takes_does_not_change_the_result(spark, tracked):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", f"t{rng.randrange(300)}", "a", "warm" if i % 9 else "hot"])) for i in range(3000)]
    assert rows_of(exact.mark_copies(frame(spark, rows, 7), tracked=tracked)) == plain(rows)
    kept = exact.drop_exact_copies(frame(spark, rows, 7), tracked=tracked)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in plain(rows) if r[3])


def test_text_ids_and_other_names(spark):
    df = spark.createDataFrame([("b", "q"), ("a", "q"), (None, "q")], "name string, body string")
    got = exact.mark_copies(df, "name", "body")
    assert sorted((r.name or "", r.keep_id, r.kept) for r in got.collect()) == [
        ("", "b", False), ("a", "b", False), ("b", "b", True)
    ]


def test_every_frequent_digest_is_named(spark):
    """All that have more than 7 / tracked of the rows, among many seldom ones."""
    rng = random.Random(5)
    texts = [f"h{i % 5}" for i in range(4000)] + [f"s{i}" for i in range(16_000)]
    rng.shuffle(texts)
    rows = exact._digests(frame(spark, list(enumerate(texts)), 9), "doc_id", "text")
    named = {r.short for r in exact.frequent_digests(rows, 256).collect()}
    hot = rows.groupBy("sha").count().filter("count > 547").selectExpr("xxhash64(sha) short")
    assert {r.short for r in hot.collect()} <= named and hot.count() == 5
    assert len(named) <= 74


def test_hot_texts_are_settled_before_the_exchange(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    plan = exact.mark_copies(frame(spark, rows))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("BroadcastHashJoin") == 2 and text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text and "Pandas" not in text
