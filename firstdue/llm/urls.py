"""URL filter: all wildcard rules run at once as one bit-parallel automaton.

Every rule is a host glob and a path glob. Both are laid out as one chain of
states, one bit each, and all chains lie side by side in the words of a bit
vector. One Shift-And step per character of the canonical URL moves every rule at
once: ``state = ((state << 1) & enter[c]) | (state & stay[c])``. ``enter`` has the
bits whose character is ``c``; ``stay`` those of a wildcard that may swallow it.
URLs of an Arrow batch advance together, so a step is a few array operations.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.llm.text import ascii_lower


# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and paths that begin with ``path``.

    In both parts ``*`` stands for any run of characters but ``/``, ``**`` for any
    run, ``?`` for one character but ``/``. The host is matched from its end.
    """

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """The rules as bit masks; ``longest`` gives the winning rule of each URL."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        #: Longer rules first, so that the first accepted one wins; ties by place.
        self.rules = sorted(rules, key=lambda r: -len(r.name.encode()))
        literal: list[set[int] | None] = []
        loops: list[str] = []
        self.starts, self.ends = [], []
        for rule in self.rules:
            # A canonical URL begins with a dot, so "*." before the host covers subdomains.
            tokens = _tokens(f"*.{rule.host}") + _tokens(rule.path) + ["**"]
            self.starts.append(len(literal))
            literal.append(None)
            loops.append("")
            for token in tokens:
                if token in ("*", "**"):
                    loops[-1] = max(loops[-1], token, key=len)
                else:
                    literal.append({token} if isinstance(token, int) else None)
                    loops.append("?" if token == "?" else "")
                    if token == "?":
                        literal[-1] = set(range(256)) - {ord("/")}
                        loops[-1] = ""
            self.ends.append(len(literal) - 1)
        width = len(literal) // 64 + 1
        self.enter = np.zeros((256, width), np.uint64)
        self.stay = np.zeros((256, width), np.uint64)
        for bit, (chars, loop) in enumerate(zip(literal, loops, strict=True)):
            word, mask = bit // 64, np.uint64(1 << (bit % 64))
            for c in chars or ():
                self.enter[c, word] |= mask
            if loop:
                self.stay[:, word] |= mask
                if loop == "*":
                    self.stay[ord("/"), word] &= ~mask
        self.first = np.zeros(width, np.uint64)
        for bit in self.starts:
            self.first[bit // 64] |= np.uint64(1 << (bit % 64))

    def longest(self, urls: Sequence[bytes]) -> np.ndarray:
        """Index of the longest rule that accepts each URL, -1 for none."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        offsets = (np.cumsum(sizes) - sizes)[order]
        text = np.frombuffer(b"".join(urls), np.uint8)
        state = np.repeat(self.first[None, :], len(urls), axis=0)
        # The URLs still being read are a prefix of the order: longest first.
        ends = -sizes[order]
        for at in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(ends, -at, side="left"))
            c = text[offsets[:n] + at]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.enter[c]) | (now & self.stay[c])
        found = np.full(len(urls), -1, np.int64)
        for index in reversed(range(len(self.rules))):
            bit = self.ends[index]
            accepted = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            found[order[accepted.astype(bool)]] = index
        return found


def _tokens(glob: str) -> list[int | str]:
    out: list[int | str] = []
    at = 0
    while at < len(glob):
        if glob[at] == "*":
            double = glob[at : at + 2] == "**"
            out.append("**" if double else "*")
            at += 2 if double else 1
        elif glob[at] == "?":
            out.append("?")
            at += 1
        else:
            out.extend(glob[at].encode())
            at += 1
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each row.

    The longest rule (host and path together) decides; without one ``rule`` is null
    and the verdict is ``default``. A missing URL, or one without ``://``, has an
    empty host and path and gets the default. Rows are judged one by one: repeated
    rows all stay, an empty table gives an empty table, and columns of the input
    with the name of a new one are replaced. Very long URLs only take more steps.
    """
    automaton = Automaton(rules)
    names = [r.name for r in automaton.rules]
    verdicts = [r.verdict for r in automaton.rules]

    @F.pandas_udf("int")
    def winner(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(automaton.longest([u.encode() for u in urls]), dtype="int32")

    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    at = parts.withColumn("__rule", winner(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    lookup = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__rule"))
    if not names:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return at.select(
        *kept, "host", "path",
        F.when(F.col("__rule") >= 0, lookup(names)).alias("rule"),
        F.when(F.col("__rule") >= 0, lookup(verdicts)).otherwise(default).alias("verdict"),
    )
