"""Source mixing against a plain reading of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from firstdue.llm import mixing

DOCS = "doc_id long, text string, source string, size string"


def shares(sizes, share=1.5, repeats=2, weights=(3, 1, 2)):
    """Targets by repeated resharing of what is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = repeats * sizes[s]
        left -= sum(repeats * sizes[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_reshared(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 300, 5000]) for i in range(rng.randrange(1, 14))}
    sizes[None] = 77
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def rows(n=300, seed=5):
    rng = random.Random(seed)
    out = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "B", "é", None]), "x") for i in range(n)]
    return out + [(None, "no id", "a", None), (n, None, "a", None), (1000, "copy copy", "b", ""), (1000, "copy copy", "b", "")]


def test_taken_words_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    df = spark.createDataFrame(rows(), DOCS)
    plan = mixing.plan_mix(df)
    assert plan.count() == df.count()
    got = plan.collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    target = shares(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(target[source])
        assert sum(r.taken for r in own) == int(own[0].target)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert all((r.position is not None) == (r.taken > 0) for r in got)
    assert all(0 <= r.position <= 1 for r in got if r.taken)
    again = mixing.plan_mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_whole_copies_and_training_order(spark):
    df = spark.createDataFrame(rows(), DOCS)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    got = mixed.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("i")).count()
    assert got.agg(F.max("count")).first()[0] <= 4  # document 1000 is there twice
    plan = mixing.plan_mix(df, whole=True)
    copies = plan.agg(F.sum(F.size(F.filter("copies", lambda c: c > 0)))).first()[0]
    assert mixed.count() == copies
    per = plan.groupBy("source").agg(
        F.sum("taken").alias("t"), F.max("target").alias("want"), F.max("size").alias("most")
    )
    assert per.filter(F.abs(F.col("t") - F.col("want")) > F.col("most") / 2 + 1).count() == 0


def asked(t, knots):
    """Share of a schedule's integral up to ``t``."""
    def area(end):
        total = 0.0
        for (t0, y0), (t1, y1) in zip(knots, knots[1:]):
            d = max(0.0, min(end, t1) - t0)
            total += d * (y0 + (y0 + (y1 - y0) * d / (t1 - t0))) / 2
        return total
    return area(t) / area(1.0)


@pytest.mark.parametrize("whole", [False, True])
def test_every_copy_follows_its_schedule(spark, monkeypatch, whole):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rng = random.Random(8)
    # The weights of a and c are high for their sizes, so both are taken twice.
    data = [(i, "w " * rng.randrange(1, 30), "abbbbbbc"[i % 8], "x") for i in range(800)]
    plan = mixing.plan_mix(spark.createDataFrame(data, DOCS), whole=whole).collect()
    twice = 0
    for place, source in enumerate("abc"):
        own = [r for r in plan if r.source == source]
        copies = sorted(
            (t, n) for r in own for t, n in zip(r.positions, r.copies, strict=True) if n > 0
        )
        target, done = own[0].target, 0
        for t, n in copies:
            assert asked(t, mixing.SCHEDULES[place]) * target == pytest.approx(done + n / 2, abs=1)
            done += n
        assert abs(done - target) <= 30 and copies[-1][0] > 0.95
        if target > 1.9 * own[0].source_size:
            twice += 1
            assert all(r.positions[0] < r.positions[1] for r in own if r.copies[1])
    assert twice == 2


def test_copies_lie_apart_in_the_mix(spark):
    data = [(i, "w " * 10, "a" if i < 20 else "b", "x") for i in range(200)]
    mixed = [r.doc_id for r in mixing.mix_documents(spark.createDataFrame(data, DOCS)).collect()]
    at = {}
    for n, doc in enumerate(mixed):
        at.setdefault(doc, []).append(n)
    assert all(len(at[i]) == 2 and at[i][1] - at[i][0] > len(mixed) / 5 for i in range(20))


def test_token_files_stand_in_training_order(spark):
    import corpus_pipeline

    (_, mix), (_, write) = corpus_pipeline.STAGES[3:]
    data = [(i, f"w{i} " * (1 + i % 9), "abbbbbbc"[i % 8], "x") for i in range(160)]
    mixed = mix(spark, spark.createDataFrame(data, DOCS), "")
    assert mixed.columns == ["doc_id", "text", "source", "size", "position"]
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    want = [r.doc_id for r in sorted(rows, key=lambda r: (r.position, r.doc_id))]
    index = write(spark, mixed, "").orderBy("start").collect()
    assert [r.doc_id for r in index] == want and want != sorted(want)
    assert [r.start for r in index[1:]] == [r.start + r.n_tokens for r in index[:-1]]


def test_query_in_training_order(spark, folder):
    from firstdue.llm.queries import QUERIES

    got = QUERIES["op2_training_order"](spark, folder).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mixing.plan_mix(docs, whole=True).collect()
    want = sorted((r.doc_id, t) for r in plan for t in r.positions if t is not None)
    assert sorted((r.doc_id, r.position) for r in got) == want


def test_time_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0))
    shares_ = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares_], "s double")
    times = [r[0] for r in df.select(mixing._time_of(F.col("s"), knots)).collect()]
    area = 0.6 * 0.75 + 0.4 * 1.5

    def reached(t):
        a, b = min(t, 0.6), max(t - 0.6, 0.0)
        return (a * 0.5 + (0.5 / 0.6) * a * a / 2 + b * 1.0 + 2.5 * b * b / 2) / area

    assert [reached(t) for t in times] == pytest.approx(shares_)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a", None), (2, None, None, None)], DOCS)
    assert [(r.taken, r.target) for r in mixing.plan_mix(blank).collect()] == [(0, 0.0)] * 2
