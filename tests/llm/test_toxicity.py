"""Toxicity: the index against all comparisons, held-out labels, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstdue.llm import toxicity
from firstdue.llm.queries import QUERIES

DOCS = "doc_id long, text string, score string, __extra int"


@pytest.mark.parametrize("seed", range(4))
def test_nearest_equals_comparing_all(seed):
    rng = random.Random(seed)
    n_terms, vectors = 40, []
    for _ in range(rng.choice([1, 30, 500])):
        raw = {t: rng.choice([1.0, 1.0, 2.5]) for t in sorted(rng.sample(range(n_terms), rng.randrange(1, 5)))}
        size = sum(w * w for w in raw.values()) ** 0.5
        vectors.append({t: w / size for t, w in raw.items()})
    index = toxicity.Index.build(vectors, [i % 2 for i in range(len(vectors))], list(range(len(vectors))), n_terms)
    placed = [vectors[i] for i in index.ids]
    for query in vectors[:60]:
        for skip in (-1, 0):
            sums = [
                (-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 9), at)
                for at, v in enumerate(placed) if at != skip
            ]
            want = [(-s, at) for s, at in sorted(sums) if s < 0][:15]
            got = index.nearest(query, 15, skip)
            assert [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=2e-9)
            assert len({g[1] for g in got} ^ {w[1] for w in want}) <= 2 * sum(
                abs(w[0] - want[-1][0]) < 3e-9 for w in want
            )


def test_monotone_fit():
    uppers, shares = toxicity.monotone([0.1, 0.2, 0.3, 0.4, 0.4], [0, 1, 0, 1, 1])
    assert uppers == [0.1, 0.3, 0.4] and shares == pytest.approx([0.25, 0.5, 2.5 / 3])


def made(spark):
    rng = random.Random(2)
    plain = ["river", "stone", "cloud", "green", "seven", "paper"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbel", "grumbelig", "snarkz"]))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    odd = [(1000, None, None, None), (1001, "", "s", 2), (None, "RIVER Grumbel!", "s", 2),
           (1002, "stone " * 60_000 + "snarkz", "s", 2), (1002, "paper", "s", 2), (1002, "paper", "s", 2)]
    labels += [(5000, 1), (None, 1), (3, None)]
    return (
        spark.createDataFrame(rows + odd, DOCS),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_scores_of_made_texts(spark):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i in range(400):
        assert by_id[i].predicted == int(i % 5 == 0)
    assert by_id[None].predicted == 1 and by_id[1000].score == by_id[1001].score < 0.5
    assert sorted(r.predicted for r in got if r.doc_id == 1002) == [0, 0, 1]
    assert by_id[5].evidence[0].toxic == 1 and by_id[1001].evidence == []
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id % 5 = 0 and doc_id < 400").count() == 0
    assert kept.count() == 320 + 4  # clean ones, 1000, 1001, and twice 1002


def test_without_rows_or_labels(spark):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs, none).count() == docs.count()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op1_toxicity"](spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    aside = [r for r in rows if r.held_out]
    right = np.mean([r.predicted == r.toxic for r in aside])
    caught = np.mean([r.predicted for r in aside if r.toxic])
    assert right > 0.975 and caught > 0.85, (right, caught)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
