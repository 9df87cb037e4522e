"""All five stages in a row on a small table, each against plain Python on what the one before has written."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firstdue.llm import mixing, toxicity
from firstdue.llm.store import stored
from test_mixing import asked, shares
from test_simhash import groups, slow_fingerprint
from test_text_rules import brute
from test_tokens import expected_index


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows after each stage, the first being the table itself; the last stage's rows as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # A missing text, a missing source, and rows that are there twice.
    more = docs.orderBy("doc_id").limit(3).withColumn("source", F.lit(None).cast("string"))
    none = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(more).unionByName(none)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, out[-1], folder)
        out.append(stored(done, f"stage-{len(out)}"))
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, other):
    return Counter(map(repr, df.collect())) == Counter(map(repr, other.collect()))


def test_columns_stay_and_rows_come_from_the_stage_before(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.columns == before.columns
        assert not Counter(map(repr, after.collect())) - Counter(map(repr, before.collect()))
    assert stages[4].columns == [*stages[0].columns, "position"]


def test_toxic_documents_go(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(stages[0], labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scores = toxicity.score_toxicity(stages[0], model).select("doc_id", "score").collect()
    wanted = sorted(r.doc_id for r in scores if r.score < 0.5)
    assert [r[0] for r in sorted(rows(stages[1], "doc_id"))] == wanted
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    gone = {r.doc_id for r in scores if r.score >= 0.5}
    known = {r.doc_id for r in labels.collect()} & {r.doc_id for r in scores}
    assert gone and len(gone & known - toxic) <= 0.1 * len(known - toxic)
    assert len(toxic & gone) >= 0.8 * len(toxic & known)


def test_one_of_each_group_stays(stages):
    given = rows(stages[1], "doc_id", "text")
    ids = [i for i, _ in given]
    least = groups(ids, [slow_fingerprint(t) for _, t in given])
    assert sorted(i for i, in rows(stages[2], "doc_id")) == sorted(set(least)) and len(set(least)) < len(ids)


def test_contaminated_documents_go(spark, folder, stages):
    given = rows(stages[2], "doc_id", "text")
    items = rows(spark.read.parquet(f"{folder}/benchmark.parquet"), "item_id", "text")
    bad = {r[0] for r in brute(given, items) if r[-1]}
    assert bad and rows(stages[3], "doc_id") == sorted(((i,) for i, _ in given if i not in bad), key=repr)


def plain_mix(given):
    """(doc_id, position) of every copy, from the rules: order by hash, whole copies, inverted schedules."""
    sources = {}
    for doc, text, source in given:
        n = len((text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).replace(" ", "\n").split("\n"))
        n -= (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).replace(" ", "\n").split("\n").count("")
        sources.setdefault(source, []).append((hashlib.md5(str(doc).encode()).hexdigest(), doc, n))
    target = shares({s: sum(n for *_, n in own) for s, own in sources.items()})
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    out = []
    for place, source in enumerate(names):
        own, done = sorted(sources[source]), 0
        knots = mixing.SCHEDULES[place % len(mixing.SCHEDULES)]
        for _ in range(2):
            for _, doc, n in own:
                if n and 2 * (int(target[source] + 1e-9) - done) > n:
                    out.append((doc, (done + n / 2) / target[source], knots))
                done += n
    return out


def test_the_mix_follows_its_rules(stages):
    given = rows(stages[3], "doc_id", "text", "source")
    assert len({i for i, *_ in given}) == len(given)
    wanted = plain_mix(given)
    got = stages[4].select("doc_id", "position").collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in wanted)
    times = {}
    for r in got:
        times.setdefault(r.doc_id, []).append(r.position)
    turn = Counter()
    for doc, share, knots in wanted:
        own = sorted(times[doc])
        reached = asked(own[turn[doc]], knots)
        assert reached == pytest.approx(min(share, 1.0), abs=1e-6)
        turn[doc] += 1


def test_token_files_hold_the_mix_in_order(stages):
    mixed = sorted(stages[4].select("position", "doc_id", "text").collect(), key=lambda r: (r.position, r.doc_id))
    wanted = expected_index([(r.doc_id, r.text) for r in mixed])
    got = sorted(map(tuple, stages[5].collect()), key=lambda r: r[1])
    assert got == wanted


def test_run_is_the_stages_in_a_row(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, folder), f"own-{k}")
    assert same(got, docs)
