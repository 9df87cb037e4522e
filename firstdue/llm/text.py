"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters; every other character belongs to a word.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Runs of these end a word of the stricter kind: only digits, letters a to z and
#: everything beyond ASCII are part of one.
NON_ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_WORDS = "cast(array() as array<string>)"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """The words between ASCII white space; none for a missing text."""
    trimmed = F.btrim(blank_if_null(text), F.lit(SPACES))
    return F.when(trimmed == "", F.expr(NO_WORDS)).otherwise(F.split(trimmed, SPACE_RUN))


def alnum_words(text: Column) -> Column:
    """The lower-cased runs of digits, a to z and non-ASCII characters."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(blank_if_null(text)), NON_ALNUM_RUN, " "))
    return F.when(spaced == "", F.expr(NO_WORDS)).otherwise(F.split(spaced, " "))


def chars_in(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def fenced(column: Column) -> Column:
    """``column``, computed once where it stands.

    Without this the optimizer may copy an array expression into a filter, or into the
    lambda of a later one, where it is computed again for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a row by its id and its text.

    Rows that agree in both get the same results from every operator that keys
    its intermediate tables by them, so repeated ids and missing ids are safe. Ids may have any type that
    can be text: whole numbers, as text too, stand for themselves and keep their order, others are named
    and ordered by the hash of their text, and a missing one comes first.
    """
    low = F.lit(-(2**63)).cast("long")
    name = F.col(doc_id).cast("string")
    named = F.when(name.isNotNull(), F.coalesce(name.try_cast("long"), F.xxhash64(name)))
    return [
        F.coalesce(named, low).alias("__id"),
        F.xxhash64(F.col(text)).alias("__hash"),
    ]


KEY = ["__id", "__hash"]


def without(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose row key is not in ``keys``, with their columns.

    The columns wait in one value, so that none of them can be taken for a key.
    """
    keyed = documents.select(*row_key(), F.struct(*documents.columns).alias("__row"))
    return keyed.join(keys.select(*KEY).distinct(), KEY, "left_anti").select("__row.*")
