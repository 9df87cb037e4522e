"""Benchmark decontamination by winnowed fingerprints.

Every span of ``window`` words contains ``window - k + 1`` k-grams. Of each such run the
smallest k-gram hash is kept, on both sides alike, so two texts that share a span share a
kept hash: none is missed, and only some two in ``window - k + 2`` hashes are joined. A
hit is then extended to all windows that contain it, and these are compared word
by word with the benchmark's.

Items shorter than a window are one window of their own length. For such a length the
run is a single k-gram of the whole length, which gives the same guarantee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.llm.text import KEY, alnum_words, fenced, row_key, without

WINDOW, K = 13, 5
#: Fingerprints of the benchmark that are sent to every executor; beyond, the join
#: shuffles both sides.
BROADCAST_ROWS = 200_000
NO_HASHES = "cast(array() as array<bigint>)"


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, none for a shorter text."""
    n = F.size(words)
    heads = F.slice(words, 1, F.greatest(n - k + 1, F.lit(0)))
    return F.transform(
        heads, lambda w, i: F.xxhash64(F.lit(k), w, *(F.get(words, i + j) for j in range(1, k)))
    )


def _minima(hashes: Column, run: int) -> Column:
    """The smallest of every ``run`` neighbouring hashes, each once."""
    n = F.size(hashes)
    heads = F.slice(hashes, 1, F.greatest(n - run + 1, F.lit(0)))
    least = F.transform(heads, lambda _, i: F.array_min(F.slice(hashes, i + 1, run)))
    return F.array_distinct(least)


def _fingerprints(rows: DataFrame, keep: list[str], lengths: list[int], window: int, k: int) -> DataFrame:
    """``rows`` (with ``__words``) and the array ``__prints`` of their kept hashes."""
    grams = rows.withColumn("__grams", fenced(_grams(F.col("__words"), k)))
    parts = [_minima(F.col("__grams"), window - k + 1)]
    parts += [F.array_distinct(_grams(F.col("__words"), m)) for m in lengths]
    prints = F.array_distinct(F.concat(*parts)) if len(parts) > 1 else parts[0]
    return grams.select(*keep, fenced(prints).alias("__prints"))


def _bounded(rows: DataFrame) -> DataFrame:
    """``rows``, hinted for broadcast when there are at most BROADCAST_ROWS of them."""
    small = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(rows) if small else rows


def _windows(words: Column, starts: Column, size: int) -> Column:
    """Structs of start, length and text of the windows at ``starts``."""
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"), F.lit(size).alias("length"),
            F.array_join(F.slice(words, s + 1, size), " ").alias("words"),
        ),
    )


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K
) -> DataFrame:
    """One row per key of ``documents`` with hits: ``__id, __hash, n_hit, n_items, items``.

    ``n_hit`` counts the words inside occurrences of windows, ``items`` is the sorted
    array of the ids (as text) of the items with such windows.
    """
    item_words = benchmark.select(
        F.col("item_id").cast("string").alias("__item"), fenced(alnum_words(F.col("text"))).alias("__words")
    ).filter(F.size("__words") > 0)
    short = sorted(
        r[0] for r in item_words.select(F.size("__words")).filter(F.size("__words") < window)
        .distinct().collect()
    )  # at most window - 1 numbers
    # Items of at least a window give its runs; a short item its own length only.
    long_items = item_words.filter(F.size("__words") >= window)
    short_items = item_words.filter(F.size("__words") < window)
    prints = _fingerprints(long_items, [], [], window, k)
    for m in short:
        own = short_items.filter(F.size("__words") == m)
        prints = prints.union(own.select(_grams(F.col("__words"), m)))
    known = _bounded(prints.select(F.explode("__prints").alias("__print")).distinct())

    texts = documents.select(*row_key(), fenced(alnum_words(F.col("text"))).alias("__words"))
    found = (
        _fingerprints(texts, KEY, short, window, k)
        .select(*KEY, F.explode("__prints").alias("__print"))
        .join(known, "__print", "left_semi")
        .groupBy(*KEY)
        .agg(F.collect_set("__print").alias("__found"))
    )

    # Only texts with hits go on. Repeated rows with one key are one text here.
    hit_texts = documents.select(*row_key(), "text").join(found, KEY)
    hit_texts = hit_texts.select(*KEY, fenced(alnum_words(F.col("text"))).alias("__words"), "__found")
    n = F.size("__words")
    hit_texts = hit_texts.withColumn("__grams", fenced(_grams(F.col("__words"), k)))
    at = F.transform("__grams", lambda g, i: F.when(F.array_contains("__found", g), i))
    hit_texts = hit_texts.withColumn("__at", fenced(F.filter(at, lambda i: i.isNotNull())))
    reach = F.flatten(
        F.transform(
            "__at",
            lambda i: F.sequence(F.greatest(i - (window - k), F.lit(0)), i),
        )
    )
    starts = F.array_distinct(F.filter(reach, lambda s: s <= n - window))
    hit_texts = hit_texts.withColumn("__starts", fenced(starts))
    candidates = [_windows(F.col("__words"), F.col("__starts"), window)]
    for m in short:
        own = F.transform(_grams(F.col("__words"), m), lambda g, i: F.when(F.array_contains("__found", g), i))
        candidates.append(_windows(F.col("__words"), F.filter(own, lambda i: i.isNotNull()), m))
    spread = hit_texts.select(*KEY, fenced(F.concat(*candidates)).alias("__w"))
    spread = spread.select(*KEY, F.explode("__w").alias("__w"))
    spread = spread.select(*KEY, "__w.start", "__w.length", "__w.words")

    every = F.sequence(F.lit(0), F.greatest(F.size("__words") - window, F.lit(0)))
    item_windows = item_words.select(
        "__item",
        F.explode(
            F.transform(every, lambda s: F.array_join(F.slice("__words", s + 1, window), " "))
        ).alias("words"),
    )
    owners = item_windows.groupBy("words").agg(F.collect_set("__item").alias("__items"))
    hits = spread.join(_bounded(owners), "words")
    marked = hits.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("items"),
    )
    # Words under a span that no earlier one has covered.
    cover = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["length"]).alias("end"),
            (s["n"] + F.greatest(x["start"] + x["length"] - F.greatest(s["end"], x["start"]), F.lit(0)))
            .alias("n"),
        ),
    )
    return marked.select(
        *KEY, cover["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items"
    )


def judge_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K,
    hit_share: int = 20,
) -> DataFrame:
    """``__id, __hash, doc_id, n_words, n_hit, n_items, items, contaminated`` of every row.

    A document is contaminated when at least one word in ``hit_share`` lies inside an occurrence
    of a benchmark window. A missing or empty text has no words and no hits; an item
    without words has no windows; windows of an item without id count as hits but name no
    item. Items with equal texts are all named. Repeated rows each get their row, an
    empty benchmark gives no hits, and other columns are ignored. Texts are read whole.
    """
    hits = benchmark_hits(documents, benchmark, window, k)
    rows = documents.select(
        *row_key(), "doc_id", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words")
    )
    joined = rows.join(hits, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        *KEY, "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        ((n_hit > 0) & (hit_share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with their columns."""
    bad = judge_contamination(documents, benchmark, **options).filter("contaminated")
    return without(documents, bad)
