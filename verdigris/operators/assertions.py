"""The assertion language: eleven kinds of checks of a response, as column expressions and as a table operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

#: The kinds that may be declared.
KINDS = ("contains", "contains_number", "exact_match", "regex", "one_of", "max_length", "min_length", "json_valid", "semantic_similarity", "council_judge", "json_schema")

ASSERTION = (
    "struct<type:string,value:string,values:array<string>,pattern:string,min_score:double,chars:int,"
    "case_sensitive:boolean,criteria:string,mode:string,schema:string>"
)


def contains(response: Column, value: Column, sensitive: Column | bool = True) -> Column:
    s = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    return F.coalesce(F.when(s, F.contains(response, value)).otherwise(F.contains(F.lower(response), F.lower(value))), F.lit(False))


def contains_number(response: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(t.numbers(response), t.normalise_number(value)), F.lit(False))


def exact_match(response: Column, value: Column, sensitive: Column | bool = True) -> Column:
    s = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    a, b = t.strip(response), t.strip(value)
    return F.coalesce(F.when(s, a == b).otherwise(F.lower(a) == F.lower(b)), F.lit(False))


def one_of(response: Column, values: Column, sensitive: Column | bool = True) -> Column:
    s = sensitive if isinstance(sensitive, Column) else F.lit(sensitive)
    return F.coalesce(F.exists(values, lambda v: F.when(s, F.contains(response, v)).otherwise(F.contains(F.lower(response), F.lower(v)))), F.lit(False))


def max_length(response: Column, chars: Column) -> Column:
    return F.coalesce(F.length(response) <= chars, F.lit(False))


def min_length(response: Column, chars: Column) -> Column:
    return F.coalesce(F.length(response) >= chars, F.lit(False))


@F.pandas_udf(T.BooleanType())
def json_valid(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What Python's parser accepts: scalars, NaN and repeated keys too, but nothing after the value."""
    import json

    def one(x: str | None) -> bool:
        try:
            json.loads(x)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    for part in texts:
        yield part.map(one).astype(bool)


@F.pandas_udf(T.BooleanType())
def regex_search(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Python's dialect; null for a pattern that does not compile."""
    import functools
    import re

    @functools.lru_cache(4096)
    def compiled(pattern: str, sensitive: bool):
        try:
            return re.compile(pattern, 0 if sensitive else re.IGNORECASE)
        except re.error:
            return None

    def one(text, pattern, sensitive):
        if text is None or pattern is None:
            return False
        p = compiled(pattern, bool(sensitive))
        return None if p is None else p.search(text) is not None

    for texts, patterns, sensitive in parts:
        yield pd.Series([one(*x) for x in zip(texts, patterns, sensitive, strict=True)], dtype=object)


def evaluate(cases: DataFrame, response: str = "response", assertions: str = "assertions") -> DataFrame:
    """One row for each case and assertion: all columns of the case but the list, and position, type, passed, message,
    actual.  ``council_judge`` passes here; a verdict replaces it later.  Kinds without a check fail."""
    r, a = F.coalesce(F.col(response), F.lit("")), F.col("assertion")
    rows = cases.select(*[c for c in cases.columns if c != assertions], F.posexplode(assertions).alias("position", "assertion"))
    sensitive = F.coalesce(a["case_sensitive"], F.lit(True))
    # The slow kinds see a response only where they apply, so other rows cost next to nothing there.
    matched = regex_search(F.when(a["type"] == "regex", r), a["pattern"], sensitive)
    parsed = json_valid(F.when(a["type"] == "json_valid", r))
    rows = rows.withColumns({"_matched": matched, "_parsed": parsed})
    kind = a["type"]
    missing = (
        F.when(kind.isin("contains", "contains_number", "exact_match") & a["value"].isNull(), "No value specified")
        .when((kind == "regex") & a["pattern"].isNull(), "No pattern specified")
        .when((kind == "one_of") & (F.coalesce(F.size(a["values"]), F.lit(0)) <= 0), "No values specified")
        .when(kind.isin("max_length", "min_length") & a["chars"].isNull(), "No chars specified")
        .when((kind == "regex") & F.col("_matched").isNull(), "Invalid pattern")
        .when(~kind.isin("contains", "contains_number", "exact_match", "regex", "one_of", "max_length", "min_length", "json_valid", "council_judge"), F.concat(F.lit("Unknown assertion type: "), kind))
    )
    passed = (
        F.when(missing.isNotNull(), False)
        .when(kind == "contains", contains(r, a["value"], sensitive))
        .when(kind == "contains_number", contains_number(r, a["value"]))
        .when(kind == "exact_match", exact_match(r, a["value"], sensitive))
        .when(kind == "regex", F.col("_matched"))
        .when(kind == "one_of", one_of(r, a["values"], sensitive))
        .when(kind == "max_length", max_length(r, a["chars"]))
        .when(kind == "min_length", min_length(r, a["chars"]))
        .when(kind == "json_valid", F.col("_parsed"))
        .otherwise(kind == "council_judge")
    )
    out = rows.withColumn("passed", F.coalesce(passed, F.lit(False)))
    message = F.coalesce(missing, F.when(F.col("passed"), "ok").otherwise(F.concat(kind, F.lit(" failed"))))
    return out.select(*[c for c in cases.columns if c != assertions], "position", kind.alias("type"), "passed", message.alias("message"), t.shorten(r).alias("actual"))


def with_verdicts(results: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Council verdicts (keys, position, passed) replace the placeholder; without one the placeholder stays."""
    v = verdicts.select(*keys, "position", F.col("passed").alias("_verdict"))
    judged = F.when(F.col("type") == "council_judge", F.coalesce("_verdict", "passed")).otherwise(F.col("passed"))
    return results.join(v, [*keys, "position"], "left").withColumn("passed", judged).drop("_verdict").select(results.columns)


def case_status(results: DataFrame, cases: DataFrame, keys: list[str], error: str | None = None) -> DataFrame:
    """passed, failed or error for each case; a case without assertions passes."""
    every = results.groupBy(*keys).agg(F.bool_and("passed").alias("_all"), F.min(F.when(~F.col("passed"), F.struct("position", "message"))).alias("_first"))
    status = F.when(F.coalesce(F.col("_all"), F.lit(True)), "passed").otherwise("failed")
    if error:
        status = F.when(F.col(error).isNotNull(), "error").otherwise(status)
    return cases.join(every, keys, "left").withColumn("status", status).withColumn("detail", F.substring(F.col("_first.message"), 1, 50)).drop("_all", "_first")


def run_summary(statuses: DataFrame, keys: list[str] = ()) -> DataFrame:
    """total, passed, failed, errors and pass_rate (0 when empty) by key."""
    count = lambda s: F.count_if(F.col("status") == s)
    rate = F.coalesce(F.try_divide(count("passed"), F.count("*")), F.lit(0.0))
    return statuses.groupBy(*keys).agg(F.count("*").alias("total"), count("passed").alias("passed"), count("failed").alias("failed"), count("error").alias("errors"), rate.alias("pass_rate"))


def report(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for a console: a mark and the detail (first failed check, else the error), worst first."""
    place = F.when(F.col("status") == "error", 0).when(F.col("status") == "failed", 1).otherwise(2)
    error = F.col("error") if "error" in statuses.columns else F.lit(None).cast("string")
    return statuses.select(*keys, F.upper("status").alias("mark"), F.substring(F.coalesce("detail", error, F.lit("")), 1, 50).alias("detail")).orderBy(place, *keys)
