"""Decontamination, chat formatting, URL rules and quality rules on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from firstdue.llm import chat, decontamination, quality, urls
from firstdue.llm.queries import URL_RULES

DOCS = "doc_id long, text string, n_hit string, __words int"


# Decontamination ------------------------------------------------------------------


def words_of(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in {len(g) for g in grams}:
            for s in range(len(w) - m + 1):
                if ids := grams.get(tuple(w[s : s + m])):
                    hit |= set(range(s, s + m))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made_texts():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gam-ma", "délta", "42", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(13, 30))) for i in range(6)]
    items += [(10, "only four words here"), (11, ""), (12, None), (13, items[0][1]), (None, text(15)),
              (14, "the the the the the the the the the the the the the the the")]
    docs = []
    for i in range(40):
        parts = [text(rng.randrange(0, 40))]
        if i % 3 == 0:
            parts.append(rng.choice(items)[1] or "")
        if i % 4 == 0:
            w = (rng.choice(items)[1] or "").split()
            parts.append(" ".join(w[: rng.randrange(1, len(w) + 1)]) if w else "")
        docs.append((i, " ... ".join([*parts, text(rng.randrange(0, 20))])))
    long = "word " * 3000 + items[1][1] + " word" * 3000
    docs += [(100, None), (101, ""), (102, "!?"), (None, items[2][1]), (103, long), (104, "the " * 200),
             (5, items[3][1]), (6, "Only FOUR words, here"), (6, "Only FOUR words, here")]
    return docs, items


@pytest.mark.parametrize("limit", [0, 200_000])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    docs, items = made_texts()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    judged = decontamination.judge_contamination(df, bench)
    got = judged.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))
    if limit:
        assert decontamination.judge_contamination(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
        assert decontamination.judge_contamination(df.limit(0), bench).count() == 0


# Chat -------------------------------------------------------------------------------

TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "<|end|>", r"<\|turn|>", "\\", "\\\\<|", "a\nb<|says|>é😀", None]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [
        (c, t, rng.choice(["user", "assistant", "sys<|end|>tem", None]), rng.choice(TEXTS), "x")
        for c in [1, 2, 3, None] for t in range(6)
    ] + [(1, 2, "assistant", "twice", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    parts = df.withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))
    done = chat.assemble(chat.format_turns(parts))
    got = done.select(
        "conv_id", chat.parse(F.col("formatted")).alias("turns"),
        chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    ).collect()
    assert {r.conv_id for r in got} == {1, 2, 3, None}
    for r in got:
        own = [(t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] != [] and sorted((t.role, t.text) for t in r.turns) == sorted(
            (role, text) for _, role, text in own
        )
        assert sorted(r.learned) == sorted(x for _, role, x in own if role == "assistant" and x)
    assert chat.assemble(chat.format_turns(parts.limit(0))).count() == 0


def test_parts_become_ordered_placeholders(spark):
    df = spark.sql(
        f"""select 1L as conv_id, 0L as turn, 'user' as role, cast(array(
        named_struct('type', 'text', 'text', 'see <|', 'ref', null, 'units', null),
        named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'units', 4),
        named_struct('type', 'audio', 'text', null, 'ref', 'b.wav', 'units', 30),
        named_struct('type', 'document', 'text', null, 'ref', 'c.pdf', 'units', null),
        named_struct('type', 'other', 'text', ' end', 'ref', null, 'units', null)
        ) as {chat.PART_TYPE}) as parts union all select 1L, 1L, 'assistant', null"""
    )
    row = chat.assemble(chat.format_turns(df)).collect()[0]
    assert row.formatted == (
        r"<|turn|>user<|says|>see <\|<|image:0|><|audio:1|><|document:2|> end<|end|>"
        "<|turn|>assistant<|says|><|end|>"
    )
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (0, "image", "a.png", 1024), (1, "audio", "b.wav", 750), (2, "document", "c.pdf", 1024)
    ]
    assert row.attachment_tokens == 2798 and row.loss_spans == []


# URLs --------------------------------------------------------------------------------


def slow_rule(host, path, rules):
    fits = []
    for r in rules:
        sub = lambda g: re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        if re.fullmatch(rf"(?:[^/]*\.)?{sub(r.host)}", host, re.S) and re.match(sub(r.path), path, re.S):
            fits.append(r)
    return max(fits, key=lambda r: len(r.name.encode())).name if fits else None


GLOBS = (*URL_RULES, urls.Rule("block", "*pills*.org", "/"), urls.Rule("block", "a?.net", "/x*/z"),
         urls.Rule("allow", "dé.com", "/**end"), urls.Rule("block", "b" * 70 + ".net", "/" + "c" * 80))


def test_rules_equal_regular_expressions():
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "xexample.com", "a.www.example.com", "net", "q.net", "ab.net",
             "cheap-pills-1.org", "x.pills.org", "dé.com", "", "b" * 70 + ".net", "u." + "b" * 70 + ".net"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/", "/fr/x", "/xyy/z", "/x/y/z", "/a/b/end", "/" + "c" * 80 + "d"]
    pairs = [(rng.choice(hosts), rng.choice(paths)) for _ in range(400)]
    automaton = urls.Automaton(GLOBS)
    found = automaton.longest([f".{h}{p}".encode() for h, p in pairs])
    got = [automaton.rules[i].name if i >= 0 else None for i in found]
    assert got == [slow_rule(h, p, GLOBS) for h, p in pairs]
    assert automaton.longest([]).tolist() == []


def test_url_parts_and_odd_rows(spark):
    rows = [
        ("HTTP://WWW.Example.COM/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("x://q.NET/es/", "q.net", "/es/", "net/es/", "block"), ("x://É.com", "É.com", "", None, "allow"),
        ("a://b://c.com/", "b:", "//c.com/", None, "allow"), ("no scheme/com/", "", "", None, "allow"),
        ("", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://a.com?x://y", "a.com", "", None, "allow"), ("http://a.com/\nq", "a.com", "/\nq", "com/", "allow"),
        ("http://a.com/" + "z" * 50_000, "a.com", "/" + "z" * 50_000, "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "old") for i, r in enumerate(rows)], "page_id int, url string, rule string")
    got = urls.judge_urls(df, URL_RULES).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == rows
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, (), default="block").collect()} == {"block"}


# Quality -----------------------------------------------------------------------------


def slow_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = [i for i, w in enumerate(windows) if windows.count(w) > 1]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len({i + k for i in again for k in range(5)}),
    )


def test_statistics_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "é😀 #*$%&|<>\n\né😀 #*$%&|<>\x0b"]
    texts += ["".join(rng.choice(["a", "b", "c", "dd"]) + rng.choice([" ", "\n", "  "]) for _ in range(n))
              for n in (5, 9, 30, 80, 200)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    rows = quality.text_statistics(df).orderBy("doc_id").collect()
    assert [
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows
    ] == [slow_statistics(t) for t in texts]
    assert quality.text_statistics(df.limit(0)).count() == 0
    # A filter on the result does not compute the arrays anew for every element.
    assert quality.judge_quality(df, []).filter("kept").count() == sum(
        n >= 10 and 100 * r <= 20 * n for n, *_, r in map(slow_statistics, texts)
    )


def test_rules_are_learned_and_emitted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        bad = i % 4 == 0
        row = dict.fromkeys(quality.FEATURES, 0.0)
        row["n_words"] = float(rng.randrange(5, 400))
        row["symbols_per_word"] = rng.uniform(0.6, 1.5) if bad and i % 8 == 0 else rng.uniform(0, 0.4)
        row["upper_share"] = rng.uniform(0.7, 1) if bad and i % 8 else rng.uniform(0, 0.5)
        rows.append((*[row[f] for f in quality.FEATURES], int(not bad), int(i % 5 == 1)))
    rules = quality.learn_rules(rows)
    assert 1 <= len(rules) <= quality.MAX_RULES
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in rows], [*quality.FEATURES, "good", "prune"]
    ).withColumn("rule", quality.first_rule(rules))
    wrong = df.filter((F.col("rule") == 0) != (F.col("good") == 1)).count()
    assert wrong <= 10
    assert quality.learn_rules([]) == [] and quality.learn_rules(rows[1:2] * 50) == []


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    aside = F.col("doc_id") % 5 == 0
    rules = quality.fit_rules(docs, labels.filter(~aside))
    judged = quality.judge_quality(docs.filter(aside).select("doc_id", "text"), rules)
    r = judged.join(labels, "doc_id").agg(
        F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")),
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))),
    ).first()
    assert r[0] > 0.85 and r[1] > 0.95, (tuple(r), rules)
