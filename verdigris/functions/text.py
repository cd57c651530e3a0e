"""Text expressions: numbers, sentences, cleaning, truncation.  All stay in the JVM."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import keep

#: What a number looks like, and the signs that normalising drops.
NUMBER = r"[$€£¥₹]?[\d,]+\.?\d*"
SIGNS = r"(?U)[$€£¥₹\s]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind.  Only the first blank of a run begins an attempt, and an
    attempt gives nothing back, so that a text is read once however long its runs are."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++\z", "")


def normalise_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, SIGNS, ""), ",", ""), r"\.0+$", "")


def numbers(c: Column) -> Column:
    """Normalised numbers of a text, in order; a sign in front is no part of one."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, normalise_number), lambda x: x != "")


def sentences(c: Column, most: int = 50) -> Column:
    """Sentences of 31 to 499 characters that do not begin with a bullet or arrow; the first ``most``."""
    parts = F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip)
    sound = lambda s: (F.length(s) > 30) & (F.length(s) < 500) & ~s.rlike(r"^[|\-><»«]")
    return F.slice(F.filter(parts, sound), 1, most)


def clean(c: Column) -> Column:
    """Without the artefacts of site navigation."""
    for pattern in (
        # Fixed values; the numbers begin where no digit stands before, and give nothing back.
        r"(?iu)—[^—]+documentation",
        r"(?U)(?<!\d)\d++\.\d++(?:\.\d++)?+\s++Documentation",
        r"(?iuU)Navigation\s+index\s+modules",
        r"(?iuU)\|\s*(next|previous|home|index)\s*\|",
        r"(?iuU)Theme\s+(Auto|Light|Dark)",
    ):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def capitalised(c: Column) -> Column:
    """Runs of capitalised words.  Possessive, as the engine would recurse for each word of a run otherwise; a word of a
    run always ends at a boundary."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+)"), F.lit(1))


def technical(c: Column) -> Column:
    """Names in snake case and camel case."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\b[a-z]+_[a-z]+\b|\b[a-z]+[A-Z][a-z]+\b"), F.lit(0))


def shorten(c: Column, most: int = 200, mark: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bound(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def distinct_by(items: Column, key) -> Column:
    """The first item of each key, in order."""
    first = lambda x, keys: F.filter(x, lambda _, i: F.array_position(keys, F.element_at(keys, (i + 1).cast("int"))) == i + 1)
    return bound(items, lambda x: bound(F.transform(x, key), lambda keys: first(x, keys)))


def prompt_hash(c: Column) -> Column:
    """The first twelve hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 12)


def numbered(rows: DataFrame, order: list[str] | None = None, name: str = "n") -> DataFrame:
    """Rows numbered from 1: in the given order, or as their files are read.

    Each task counts its rows and the driver gets one number from each; so no task sees more than its part.  Sorted rows
    are written to the shared folder, as the two passes must see the same parts.
    """
    src = keep(rows.orderBy(*order)) if order else rows
    sizes = dict(src.groupBy(F.spark_partition_id().alias("part")).count().collect())
    before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return src.withColumn(name, F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), F.spark_partition_id() + 1) + within + 1)


def two_decimals(c: Column) -> Column:
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
