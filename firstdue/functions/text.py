"""Text expressions: trimming, ordered replacement and address building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from firstdue.constants import ADDRESS_REPLACEMENTS, ADDRESS_SUFFIX
from firstdue.functions.nulls import if_else, paste


def trim_ws(c: Column | str) -> Column:
    """Strip blanks, tabs and line ends from both sides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(" \t\r\n"))


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, applied one after the other."""
    return reduce(lambda acc, rule: F.replace(acc, F.lit(rule[0]), F.lit(rule[1])), rules, c)


def strip_lead(c: Column, lead: str, strip: str = "all") -> Column:
    """Take ``lead`` off a text that starts with it.

    ``all`` also removes it everywhere else in such a text ("0 100 MAIN" becomes
    "10MAIN"); ``prefix`` removes only the start. One regular expression, so that
    the text is referred to once and nested clean-up steps stay small plans.
    """
    quoted = f"\\Q{lead}\\E"
    if strip == "all":
        # First match at the start, each further one where the last one ended.
        return F.regexp_replace(c, rf"(?s)(?:^|(?!^)\G(.*?)){quoted}", "$1")
    if strip == "prefix":
        return F.regexp_replace(c, f"^{quoted}", "")
    raise ValueError(f"unknown strip mode {strip!r}")


def street(number: Column, name1: Column, name2: Column) -> Column:
    """"12 MAIN ST" with a number, "MAIN ST & ELM ST" for a crossing."""
    return if_else(number != "", paste(number, name1), paste(name1, F.lit("&"), name2))


def in_town(address: Column, variant: str = "v1", suffix: str | None = None) -> Column:
    """Add the town, trim, and apply the clean-up rules of a variant in order."""
    suffix = ADDRESS_SUFFIX[variant] if suffix is None else suffix
    text = trim_ws(F.concat(address, F.lit(suffix)))
    return replace_all(text, ADDRESS_REPLACEMENTS[variant])


def expand_state(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit(", MA"), F.lit(", Massachusetts"))


def compact(c: Column | str) -> Column:
    """Remove every blank, as a routing service wants its coordinates."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit(" "), F.lit(""))
