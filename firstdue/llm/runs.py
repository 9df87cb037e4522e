"""Runs of equal keys in a stream of sorted Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle


# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def sorted_runs(
    batches: Iterable[pa.RecordBatch], names: list[str], limit: int | None = None
) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns of ``names`` (all long, the first is the sorted key), cut between keys.

    Yields ``(False, columns)`` with whole runs only. A run that is still open after more than
    ``limit`` rows comes in pieces as ``(True, columns)``, so memory stays bounded by a batch
    and ``limit``. A piece of the first kind may hold long runs too.
    """
    held = [np.zeros(0, np.int64)] * len(names)
    flooded = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in names]
        if flooded is not None:
            more = now[0] == flooded
            if more.any():
                yield True, [c[more] for c in now]
                now = [c[~more] for c in now]
        now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        # The last run may go on in the next batch.
        last = int(np.searchsorted(now[0], now[0][-1], side="left"))
        yield False, [c[:last] for c in now]
        held = [c[last:] for c in now]
        if limit is not None and len(held[0]) > limit:
            flooded = held[0][0]
            yield True, held
            held = [c[:0] for c in held]
    yield False, held


def run_sizes(key: np.ndarray) -> np.ndarray:
    """For each row of a sorted key the number of rows with the same key."""
    if not len(key):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    return np.repeat(sizes, sizes)
