"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link when they differ in at most ``max_bits`` of 64 bits, up to 3. Cut into two
halves, one half then differs in at most one bit. Each half is indexed as it is, and
once for every bit with that bit taken out: linked fingerprints meet in the bucket
of the half that is equal, or in the one without the bit that differs. Fingerprints
that meet are compared bit by bit.

Buckets are streamed in key order. One with more than ``BUCKET`` fingerprints is not
compared pair by pair: its members are indexed once more by the other half with all
choices of the bits that may still differ taken out. Who meets there is linked, and
at most 2 ** max_bits different fingerprints do, so work stays in proportion to rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.llm.components import components
from firstdue.llm.runs import run_sizes, sorted_runs
from firstdue.llm.store import stored
from firstdue.llm.text import KEY, row_key
from firstdue.operators.joins import lookup_join

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, MAX_BITS, SEED = 3, 2, 42
BUCKET = 32
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: In place of a bit's number: the half as it is.
WHOLE = 32


def _word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabyte of it at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    # Bytes hold sums of up to 255 rows, which adds many columns in one instruction.
    sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return sums.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 hashes of a text's word shingles; 0 without words."""
    digest = xxhash.xxh64_intdigest
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_chunks((text or b"").lower()):
        words = tail + words
        shifted = [words[k:] for k in range(shingle)]
        hashes = [digest(b" ".join(s), SEED) for s in zip(*shifted, strict=False)]
        if hashes:
            counts += _bit_counts(np.array(hashes, np.uint64))
            total += len(hashes)
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``__id, __hash, doc_id, fp`` (fp a signed long) of every row."""
    rows = documents.select(*row_key(), "doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = [fingerprint(t.as_py(), shingle) for t in texts]
            array = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*KEY, "doc_id")), array], [*KEY, "doc_id", "fp"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id long, __hash long, doc_id {kind}, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """66 rows (bucket, fp) per fingerprint: half, bit taken out, remaining value."""
    masks = np.array([~(1 << j) & 0xFFFFFFFF for j in range(32)] + [0xFFFFFFFF], np.uint64)
    marks = np.arange(33, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            halves = [part & np.uint64(0xFFFFFFFF), part >> np.uint64(32)]
            keys = [
                (half[:, None] & masks) | (marks + np.uint64(33 * side << 32))
                for side, half in enumerate(halves)
            ]
            buckets = np.concatenate(keys, axis=1).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array(np.repeat(part, 66).view(np.int64))],
                ["bucket", "fp"],
            )


def _meet(max_bits: int):
    """A function that turns sorted (bucket, fp) rows into links and rows of large buckets."""

    def compare(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = run_sizes(bucket)
        large = sizes > BUCKET
        if large.any():
            yield _rows(bucket[large], fp[large], None)
        few = (sizes > 1) & ~large
        bucket, fp = bucket[few], fp[few]
        side_bit = bucket >> 32
        side, bit = side_bit // 33, side_bit % 33
        needed = np.where(
            bit == WHOLE, np.uint64(0),
            np.uint64(1) << ((side * 32 + np.minimum(bit, 31)).astype(np.uint64)),
        )
        for step in range(1, BUCKET):
            same = np.flatnonzero(bucket[:-step] == bucket[step:])
            if not len(same):
                break
            differ = (fp[same] ^ fp[same + step]).view(np.uint64)
            # In a bucket without a bit, only fingerprints that differ there are new.
            ok = (np.bitwise_count(differ) <= max_bits) & ((differ & needed[same]) == needed[same])
            if ok.any():
                yield _rows(None, fp[same[ok]], fp[same[ok] + step])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, (bucket, fp) in sorted_runs(batches, ["bucket", "fp"], BUCKET):
            if large:
                yield _rows(bucket, fp, None)
            else:
                yield from compare(bucket, fp)

    return run


def _rows(bucket, a, b) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if bucket is None else pa.array(bucket), pa.array(a), none if b is None else pa.array(b)],
        ["bucket", "a", "b"],
    )


def _refine(max_bits: int):
    """A function that gives the rows of large buckets their finer keys."""

    def choices(n: int) -> np.ndarray:
        return np.array(
            [sum(1 << k for k in c) for c in combinations(range(32), n)], np.uint64
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, minus = choices(max_bits), choices(max_bits - 1)
        for batch in batches:
            bucket, fp = (batch.column(c).to_numpy() for c in ("bucket", "a"))
            side, bit = (bucket >> 32) // 33, (bucket >> 32) % 33
            word = fp.view(np.uint64)
            other = np.where(side == 0, word >> np.uint64(32), word & np.uint64(0xFFFFFFFF))
            for masks, chosen in ((whole, bit == WHOLE), (minus, bit != WHOLE)):
                rows = np.flatnonzero(chosen)
                for at in range(0, len(rows), 512):
                    r = rows[at : at + 512]
                    kept = other[r][:, None] & ~masks
                    number = np.arange(len(masks), dtype=np.uint64) << np.uint64(32)
                    fine = (kept | number).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(bucket[r], len(masks))), pa.array(fine),
                         pa.array(np.repeat(fp[r], len(masks)))],
                        ["bucket", "fine", "fp"],
                    )

    return run


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``max_bits`` of each other.

    Pairs that meet in large buckets are linked through one member of their fine
    bucket, so not every pair has a row, but every linked pair is connected.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    variants = prints.select("fp").distinct().mapInArrow(_variants, "bucket long, fp long")
    ordered = variants.repartition("bucket").sortWithinPartitions("bucket", "fp")
    met = stored(ordered.mapInArrow(_meet(max_bits), "bucket long, a long, b long"), "met")
    pairs = met.filter("b is not null").select("a", "b")
    fine = met.filter("bucket is not null").mapInArrow(
        _refine(max_bits), "bucket long, fine long, fp long"
    )
    # At most 2 ** max_bits fingerprints share all bits but those taken out.
    groups = fine.groupBy("bucket", "fine").agg(F.sort_array(F.collect_set("fp")).alias("s"))
    stars = groups.filter(F.size("s") > 1).select(
        F.get("s", F.lit(0)).alias("a"), F.explode(F.slice("s", 2, 2**max_bits)).alias("b")
    )
    return pairs.union(stars)


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``__id, __hash, doc_id, fp, root, component_id`` of every row of ``documents``.

    ``root`` is the least fingerprint of the row's group and ``component_id`` the smallest
    doc_id in it. Texts without words, missing ones too, have fingerprint 0 and are
    one group with what links to it. Missing doc_ids do not count as smallest;
    a group without any has a null component_id. Repeated rows each get their row; an empty table
    gives an empty one; other columns are ignored. A fingerprint that most rows
    share is one row of the index, and its rows are found by a join that splits hot keys.
    """
    rows = stored(fingerprints(documents, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(link_fingerprints(distinct, max_bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = lookup_join(named.select("fp", "root"), least, "root")
    return lookup_join(rows, groups, "fp").select(
        *KEY, "doc_id", "fp", "root", "component_id"
    )


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of ``documents``, with their columns: that with the smallest
    doc_id (a missing one last), then text hash. Of rows that agree in both one stays."""
    judged = near_duplicates(documents, **options)
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *map(F.col, KEY)
    )
    first = judged.groupBy("root").agg(F.min(order).alias("first")).select("first.*").select(*KEY)
    keyed = documents.select(*row_key(), F.struct(*documents.columns).alias("__row"))
    # A chosen id and hash name one row, or copies of one row.
    kept = keyed.join(first, KEY, "left_semi")
    # Of copies the least row; columns with maps in them have no order and do not decide.
    ordered = [c for c, kind in documents.dtypes if not re.search(r"\bmap<|variant", kind)]
    if len(ordered) == len(documents.columns):
        least = F.min("__row")
    else:
        least = F.min_by("__row", F.struct(*[F.col("__row")[c] for c in ordered]))
    one = kept.groupBy(*KEY).agg(least.alias("__row"))
    return one.select("__row.*")
