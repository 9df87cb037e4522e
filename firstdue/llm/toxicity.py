"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words, the beginnings of words, and either of them met often in a text; those that mark
toxic texts are chosen on a bounded sample of labelled rows (log-likelihood ratio); their document frequencies are counted over
all documents. The examples' unit vectors stand in an inverted index whose posting lists
are cut into blocks of ``BLOCK`` examples, each with the largest weight in it. A query
adds up the block maxima of its terms, reads the blocks with the highest bounds first, and then
only those whose bound reaches the k-th similarity: the result is that of comparing all.

Neighbours vote with weights that fall with distance. Votes of the examples themselves, each
left out in turn, are turned into probabilities by monotone regression.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.llm.text import KEY, row_key, without

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that the model is fitted on, at most, and terms it knows, at most.
SAMPLE_ROWS, MAX_TERMS = 20_000, 1024
#: A term must be in so many sample rows, so many of which are toxic, and mark these with so
#: high a G statistic.
MIN_ROWS, MIN_SHARE, MIN_G = 4, 0.5, 15.0
NEIGHBOURS, BLOCK, FIRST_BLOCKS, EVIDENCE = 15, 64, 3, 3
HEAD = 4
PREFIXES = (4, 5, 6, 7, 8)
DENSE, DENSE_WORDS = "+", 100
#: Results that a task remembers.
KNOWN_COUNTS = 10_000
CHUNK = 1 << 20
_WORD, _SPACE = re.compile(r"[^\W_]+"), re.compile(r"\s")
#: Similarities this close count as equal, so that the order of sums does not decide.
CLOSE = 1e-9


def _words(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, some megabyte of it at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


def _terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def _terms(words: Mapping[str, int], total: int) -> dict[str, int]:
    """Counts of the terms of a text with so many words in all.

    A term that is met at least twice, and once in ``DENSE_WORDS`` words, is a further term:
    a text about which it says more than that it occurs.
    """
    counts: Counter[str] = Counter()
    for word, n in words.items():
        for term in _terms_of(word):
            counts[term] += n
    dense = {t + DENSE: n for t, n in counts.items() if n >= 2 and n * DENSE_WORDS >= total}
    return {**counts, **dense}


def _all_terms(text: str) -> Iterable[str]:
    words: Counter[str] = Counter()
    for part in _words(text):
        words.update(part)
    return _terms(words, words.total())


class Vocabulary:
    """Numbers of the known terms, and a text's counts of them."""

    def __init__(self, terms: Sequence[str]) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        # No known term begins otherwise, so nearly all words are passed over at once.
        self.heads = {t.removeprefix("^").removesuffix(DENSE)[:HEAD] for t in terms}

    def count(self, text: str) -> dict[int, int]:
        heads, words, total = self.heads, Counter(), 0
        for part in _words(text):
            total += len(part)
            words.update(w for w in part if w[:HEAD] in heads)
        found = _terms(words, total)
        return dict(sorted((self.number[t], n) for t, n in found.items() if t in self.number))


@dataclass
class Index:
    """Examples' unit vectors as block-max posting lists."""

    labels: np.ndarray
    ids: list
    #: Postings of term t are members[cuts[t, 0]:cuts[t, -1]]; cuts[t, b] begins block b.
    cuts: np.ndarray
    members: np.ndarray
    weights: np.ndarray
    highest: np.ndarray

    @classmethod
    def build(cls, vectors: Sequence[dict[int, float]], labels: Sequence[int], ids: list, n_terms: int):
        # Alike examples side by side, so that blocks differ in their maxima.
        order = sorted(
            range(len(vectors)),
            key=lambda i: (sorted(vectors[i], key=lambda t: (-vectors[i][t], t)), i),
        )
        blocks = -(-len(order) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for at, i in enumerate(order):
            for t, w in vectors[i].items():
                postings[t].append((at, w))
        flat = [p for row in postings for p in row]
        members = np.array([p[0] for p in flat], np.int64)
        weights = np.array([p[1] for p in flat], float)
        term = np.repeat(np.arange(n_terms), [len(row) for row in postings])
        edges = np.arange(n_terms)[:, None] * (blocks + 1) + np.arange(blocks + 1)
        cuts = np.searchsorted(term * (blocks + 1) + members // BLOCK, edges)
        highest = np.zeros((n_terms, blocks))
        np.maximum.at(highest, (term, members // BLOCK), weights)
        return cls(
            np.array([labels[i] for i in order], float), [ids[i] for i in order],
            cuts, members, weights, highest,
        )

    def _similarities(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Similarities of the examples of some blocks, from the postings in them."""
        starts = self.cuts[terms][:, blocks].ravel()
        sizes = self.cuts[terms][:, blocks + 1].ravel() - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        weights = self.weights[at] * np.repeat(np.repeat(q, len(blocks)), sizes)
        return np.bincount(self.members[at], weights, len(self.labels))

    def nearest(self, vector: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples with the highest similarity above 0, equal ones by place.

        The blocks with the highest bounds are read first. Their k-th similarity then rules out
        every block whose bound is lower; the rest is read in one step.
        """
        terms = np.fromiter(vector, np.int64, len(vector))
        q = np.fromiter(vector.values(), float, len(vector))
        bounds = q @ self.highest[terms]
        order = np.lexsort((np.arange(len(bounds)), -np.round(bounds, 9)))
        order = order[bounds[order] > 0]
        first, rest = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
        found: list[tuple[float, int]] = []
        for blocks in (first, rest):
            if len(found) == k:
                low = found[-1][0] - CLOSE
                blocks = blocks[bounds[blocks] >= low]
            if not len(blocks):
                continue
            sums = np.round(self._similarities(terms, q, blocks), 9)
            if skip >= 0:
                sums[skip] = 0
            hits = np.flatnonzero(sums > 0)
            if len(hits) > k:
                hits = hits[sums[hits] >= np.partition(sums[hits], -k)[-k]]
                hits = hits[np.argsort(-sums[hits], kind="stable")[:k]]
            found += [(float(sums[i]), int(i)) for i in hits]
            found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        return found


def _vote(near: Sequence[tuple[float, int]], labels: np.ndarray) -> float:
    weights = [1 / (1.05 - s) for s, _ in near]
    return sum(w * labels[at] for w, (_, at) in zip(weights, near, strict=True)) / sum(weights)


def monotone(votes: Sequence[float], labels: Sequence[float]) -> tuple[list[float], list[float]]:
    """Upper votes and probabilities of the steps of a rising fit (pool adjacent violators)."""
    steps: list[list[float]] = []
    for vote, label in sorted(zip(votes, labels, strict=True)):
        if steps and steps[-1][0] == vote:
            steps[-1][1] += label
            steps[-1][2] += 1
        else:
            steps.append([vote, label, 1])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [last[0], steps[-1][1] + last[1], steps[-1][2] + last[2]]
    # Half a row of each kind keeps small steps from certainty.
    return [s[0] for s in steps], [(s[1] + 0.5) / (s[2] + 1) for s in steps]


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: Index | None
    #: Score of a text without known terms.
    otherwise: float
    steps: tuple[list[float], list[float]] = field(default_factory=lambda: ([], []))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit vector of (1 + ln tf) * idf."""
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()}

    def calibrated(self, vote: float) -> float:
        uppers, shares = self.steps
        # Between steps on a line, so that a higher vote is a higher score.
        return float(np.interp(vote, uppers, shares)) if uppers else vote

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """Score of a text with these counts of known terms, and its nearest examples."""
        if not counts or self.index is None:
            return self.otherwise, []
        near = self.index.nearest(self.vector(counts), NEIGHBOURS)
        if not near:
            return self.otherwise, []
        return self.calibrated(_vote(near, self.index.labels)), near[:EVIDENCE]


def _log_ratio(a: Column, n: Column, toxic: int, rows: int) -> Column:
    """G statistic of a term in ``n`` of ``rows`` rows, ``a`` of them toxic; 0 if it marks others."""
    cells = [
        (a, n * (toxic / rows)), (n - a, n * ((rows - toxic) / rows)),
        (toxic - a, (rows - n) * (toxic / rows)),
        (rows - toxic - n + a, (rows - n) * ((rows - toxic) / rows)),
    ]
    parts = [F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells]
    return F.when(a * rows > n * toxic, 2 * sum(parts[1:], parts[0])).otherwise(0.0)


def _sample(documents: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    chosen = (
        labels.select(F.col("doc_id").alias("__doc"), F.col("toxic").cast("int").alias("__toxic"))
        .dropna()
        .orderBy(F.xxhash64("__doc"), "__doc", "__toxic")
        .limit(max_rows)
    )
    # At most max_rows pairs of numbers: small by construction.
    return documents.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__doc")
    ).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__toxic")


def fit(
    documents: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> Model:
    """A model from the rows of ``documents`` that ``labels`` (doc_id, toxic 0/1) marks.

    At most ``max_rows`` labels are used, those with the smallest hash of their id. Labels that
    are missing, or whose document is, are left out; repeated rows all count. Without
    any usable label every score is 0.
    """
    sample = _sample(documents, labels, max_rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, toxic = Counter(), Counter()
            for text, label in zip(batch.column("text"), batch.column("__toxic").to_pylist(), strict=True):
                found = _all_terms(text.as_py())
                rows.update(found)
                if label:
                    toxic.update(found)
            names = list(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([rows[t] for t in names], pa.int64()),
                 pa.array([toxic[t] for t in names], pa.int64())],
                ["term", "n", "a"],
            )

    total = sample.agg(F.count(F.lit(1)), F.sum(F.col("__toxic"))).collect()[0]
    rows, toxic = total[0], total[1] or 0
    if not toxic or toxic == rows:
        return Model(Vocabulary([]), np.zeros(0), None, float(bool(toxic)))
    counts = sample.mapInArrow(terms, "term string, n long, a long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a")
    )
    marking = (F.col("n") >= MIN_ROWS) & (F.col("a") >= MIN_SHARE * F.col("n"))
    marked = counts.filter(marking).select(
        "term", _log_ratio(F.col("a"), F.col("n"), toxic, rows).alias("g")
    )
    best = marked.filter(F.col("g") >= MIN_G).orderBy(F.desc("g"), "term").limit(max_terms)
    vocabulary = Vocabulary(sorted(r.term for r in best.collect()))  # at most max_terms

    n_terms = len(vocabulary.number)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen[n_terms] += 1
                for t in vocabulary.count(text.as_py() or ""):
                    seen[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1)), pa.array(seen)], ["t", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("__toxic"),
                 pa.array([list(c) for c in found], pa.list_(pa.int64())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                ["id", "toxic", "t", "n"],
            )

    seen = np.zeros(n_terms + 1, np.int64)
    per = documents.select("text").mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n"))
    for t, n in per.collect():  # one row per term
        seen[t] = n
    idf = np.log((1 + seen[n_terms]) / (1 + seen[:n_terms])) + 1
    model = Model(vocabulary, idf, None, 0.0)

    rows = sample.mapInArrow(vectors, "id string, toxic int, t array<long>, n array<long>").collect()
    rows = sorted(rows, key=lambda r: (r.id, r.toxic, r.t, r.n))  # at most max_rows
    empty = [r.toxic for r in rows if not r.t]
    rows = [r for r in rows if r.t]
    model.otherwise = (sum(empty) + 0.5 * toxic / total[0]) / (len(empty) + 1)
    if not rows:
        return model
    units = [model.vector(dict(zip(r.t, r.n, strict=True))) for r in rows]
    model.index = Index.build(units, [r.toxic for r in rows], list(range(len(rows))), n_terms)
    votes, truth = [], []
    for at, own in enumerate(model.index.ids):
        near = model.index.nearest(units[own], NEIGHBOURS, skip=at)
        if near:
            votes.append(_vote(near, model.index.labels))
            truth.append(model.index.labels[at])
    model.steps = monotone(votes, truth)
    model.index.ids = [rows[i].id for i in model.index.ids]
    return model


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """``__id, __hash, doc_id, score, predicted, evidence`` of every row.

    ``score`` (0 to 1) rises with the likelihood of the label, ``predicted`` is 1 from 0.5 on,
    ``evidence`` lists the nearest examples (doc_id as text, similarity, toxic). Only the text
    is read. Missing and empty texts, and texts without known terms, get the share of toxic
    examples among such texts. Texts are read whole; repeated rows each get their row;
    an empty table gives an empty one; other columns are ignored. The model goes along with
    the tasks; its size is bounded by the sample and the vocabulary.
    """
    rows = documents.select(*row_key(), "doc_id", "text")
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies, and texts with a chance term or two, have the same counts.
        known: dict[tuple, tuple] = {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text"):
                counts = model.vocabulary.count(text.as_py() or "")
                key = tuple(counts.items())
                if key not in known:
                    if len(known) >= KNOWN_COUNTS:
                        known.clear()
                    known[key] = model.score(counts)
                score, near = known[key]
                scores.append(score)
                evidence.append([
                    {"doc_id": model.index.ids[at], "similarity": s, "toxic": int(model.index.labels[at])}
                    for s, at in near
                ])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*KEY, "doc_id")), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)],
                [*KEY, "doc_id", "score", "predicted", "evidence"],
            )

    name = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"__id long, __hash long, doc_id {name}, score double, predicted int, "
        "evidence array<struct<doc_id: string, similarity: double, toxic: int>>",
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: every fifth by the crc32 of its id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with their columns.

    The model learns from the labels outside the held-out fifth.
    """
    model = fit(documents, labels.filter(~held_out(F.col("doc_id"))), **options)
    return without(documents, score_toxicity(documents, model).filter("predicted = 1"))
