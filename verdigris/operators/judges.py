"""Judge replies and verdicts: parsing of free text, votes, synthesis, and the prompts that judges get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Fixed values.
POSITIVE = ("excellent", "good", "well", "correct", "accurate", "helpful", "clear", "proper", "appropriate", "follows", "adheres", "compliant")
NEGATIVE = ("poor", "bad", "wrong", "incorrect", "missing", "fails", "violates", "lacks", "inadequate", "inconsistent")
SCORE_PATTERNS = (
    r"(?iU)(?:overall|final|total)[\s_]*(?:score)?[\s:=]+([0-9.]+)",
    r"(?iU)(?:score|rating)[\s:=]+([0-9.]+)(?:\s*/\s*1)?",
    r"(?iU)\b([0-9]\.[0-9]+)\s*/\s*1(?:\.0)?",
)
PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return t.bound(c, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))))


def _lines(c: Column, stripped: bool) -> Column:
    lines = F.split(c, "\n")
    return F.transform(lines, t.strip) if stripped else lines


def _as_number(c: Column) -> Column:
    return t.bound(t.strip(c), lambda x: F.when(x.rlike(PLAIN_NUMBER), x.try_cast("double")))


def _last(values: Column) -> Column:
    """The last item that is not null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def _after_first_colon(line: Column) -> Column:
    return t.strip(F.substring(line, F.locate(":", line) + 1, F.length(line)))


def single_reply(c: Column) -> Column:
    """SCORE and REASONING lines: struct(score clamped, 0.5 by default; reasoning, the text by default; passed at 0.7)."""
    def read(lines: Column) -> Column:
        score = _last(F.transform(F.filter(lines, lambda x: x.startswith("SCORE:")), lambda x: _as_number(F.substring(x, 7, 1 << 30))))
        reason = _last(F.transform(F.filter(lines, lambda x: x.startswith("REASONING:")), lambda x: t.strip(F.substring(x, 11, 1 << 30))))
        return t.bound(F.coalesce(clamp(score), F.lit(0.5)), lambda value: F.struct(value.alias("score"), F.coalesce(reason, c).alias("reasoning"), (value >= 0.7).alias("passed")))

    return t.bound(_lines(c, False), read)


#: Names of lines in a judge's reply, in any case, with a blank or an underscore.
NAMES = ("OVERALL_SCORE", "ROLE_ADHERENCE", "RESPONSE_QUALITY", "CONSISTENCY", "REASONING", "WEAK_AREAS")


def _told(c: Column) -> Column:
    """Lines that begin with one of the names and a colon: array of (name, what stands behind).  All names at once, so a
    text is read twice, not once for each."""
    pattern = rf"(?iUmd)^\s*({'|'.join(NAMES).replace('_', '[_ ]')}):([^\n]*)$"
    part = lambda g: F.regexp_extract_all(c, F.lit(pattern), F.lit(g))
    return F.zip_with(part(1), part(2), lambda name, rest: F.struct(F.upper(F.lower(F.replace(name, F.lit(" "), F.lit("_")))).alias("name"), rest.alias("rest")))


def _after(told: Column, name: str) -> Column:
    """What stands behind this name, line by line."""
    return F.transform(F.filter(told, lambda x: x["name"] == name), lambda x: x["rest"])


def _named(told: Column, name: str) -> Column:
    """Of the lines with this name, the number after the last colon; the last that parses."""
    return clamp(_last(F.transform(_after(told, name), lambda x: _as_number(F.regexp_extract(F.substring_index(x, ":", -1), r"[\d.]+", 0)))))


def sentiment(c: Column) -> Column:
    """0.5 and 0.3 (p - n) / (p + n + 1) from the numbers of listed words found, within 0.2 and 0.9."""
    count = lambda low, words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = lambda x: F.when(x["p"] + x["n"] > 0, clamp(0.5 + 0.3 * (x["p"] - x["n"]) / (x["p"] + x["n"] + 1), 0.2, 0.9)).otherwise(0.5)
    return t.bound(F.lower(c), lambda low: t.bound(F.struct(count(low, POSITIVE).alias("p"), count(low, NEGATIVE).alias("n")), score))


def _scaled(c: Column) -> Column:
    return t.bound(c, lambda x: F.when((x >= 0) & (x <= 1), x).when((x > 1) & (x <= 10), x / 10).when((x > 10) & (x <= 100), x / 100))


def batch_reply(c: Column) -> Column:
    """struct(overall_score, role_adherence, response_quality, consistency, reasoning, weak_areas): named lines, else
    scaled numbers near known words, else sentiment."""
    def named(told: Column) -> Column:
        overall, role, quality, consistency, reasoning, weak = NAMES
        areas = F.filter(F.transform(_after(told, weak), t.strip), lambda x: F.lower(x) != "none")
        scores = [_named(told, name).alias(alias) for name, alias in ((overall, "overall"), (role, "role"), (quality, "quality"), (consistency, "consistency"))]
        return F.struct(*scores, _last(F.transform(_after(told, reasoning), t.strip)).alias("reason"), _last(areas).alias("areas"))

    told = F.filter(F.split(c, r"\."), lambda s: F.lower(s).rlike("overall|summary|conclusion|score"))
    found = [_scaled(_as_number(F.regexp_extract(c, p, 1))) for p in SCORE_PATTERNS]

    def whole(x: Column) -> Column:
        return t.bound(F.coalesce(x["overall"], *found, sentiment(c)), lambda overall: t.bound(F.when(overall == 0, 0.5).otherwise(overall), lambda rest: F.struct(
            overall.alias("overall_score"),
            F.coalesce(x["role"], rest).alias("role_adherence"),
            F.coalesce(x["quality"], rest).alias("response_quality"),
            F.coalesce(x["consistency"], rest).alias("consistency"),
            F.coalesce(t.blank_to_null(x["reason"]), t.blank_to_null(F.substring(t.strip(F.try_element_at(told, F.lit(1))), 1, 200)), t.strip(F.substring(c, 1, 200))).alias("reasoning"),
            F.filter(F.transform(F.split(F.coalesce(x["areas"], F.lit("")), ","), t.strip), lambda a: a != "").alias("weak_areas"),
        )))

    return t.bound(t.bound(_told(c), named), whole)


def synthesis_reply(c: Column, mean: Column) -> Column:
    """FINAL_SCORE (not clamped; the mean by default), CONFIDENCE if it is a known one, SUMMARY."""
    def read(lines: Column) -> Column:
        take = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: t.strip(F.substring(x, len(name) + 2, 1 << 30)))
        score = _last(F.transform(take("FINAL_SCORE"), _as_number))
        known = _last(F.filter(F.transform(take("CONFIDENCE"), lambda x: F.lower(x)), lambda x: x.isin("high", "medium", "low")))
        return F.struct(F.coalesce(score, mean).alias("final_score"), F.coalesce(known, F.lit("medium")).alias("confidence"), F.coalesce(_last(take("SUMMARY")), F.lit("")).alias("summary"))

    return t.bound(_lines(c, False), read)


def strict_reply(c: Column) -> Column:
    """Upper-case names only, the whole rest after the last colon a number, not clamped, 0.5 by default.  A text is split
    once for all names."""
    def read(lines: Column) -> Column:
        rest = lambda name: F.filter(lines, lambda x: x.startswith(name + ":"))
        value = lambda name: F.coalesce(_last(F.transform(rest(name), lambda x: _as_number(F.substring_index(x, ":", -1)))), F.lit(0.5))
        sure = _last(F.filter(F.transform(rest("CONFIDENCE"), lambda x: F.lower(t.strip(F.substring_index(x, ":", -1)))), lambda x: x.isin("high", "medium", "low")))
        told = _last(F.transform(rest("RECOMMENDATIONS"), _after_first_colon))
        advice = F.filter(F.transform(F.split(F.coalesce(told, F.lit("")), ","), t.strip), lambda x: x != "")
        names = ("OVERALL_SCORE", "ROLE_ADHERENCE", "RESPONSE_QUALITY", "CONSISTENCY", "APPROPRIATENESS", "FINAL_SCORE")
        return F.struct(*[value(n).alias(n.lower()) for n in names], F.coalesce(sure, F.lit("medium")).alias("confidence"), F.coalesce(_last(F.transform(rest("SUMMARY"), _after_first_colon)), F.lit("")).alias("summary"), advice.alias("recommendations"))

    return t.bound(_lines(c, True), read)


def mean_std(score: str = "score") -> tuple[Column, Column]:
    return F.coalesce(F.avg(score), F.lit(0.0)), F.coalesce(F.stddev_pop(score), F.lit(0.0))


def vote(scores: DataFrame, keys: list[str], min_score: float = 0.7, score: str = "score") -> DataFrame:
    """Passed if strictly more than half of the judges reach the minimum; a missing score counts as 0.5."""
    s = F.coalesce(F.col(score), F.lit(0.5))
    yes, n = F.count_if(s >= min_score), F.count("*")
    out = scores.groupBy(*keys).agg(n.alias("judges"), yes.alias("in_favour"), F.avg(s).alias("final_score"))
    told = F.concat(F.col("in_favour").cast("string"), F.lit("/"), F.col("judges").cast("string"), F.lit(" judges passed"))
    return out.withColumn("passed", F.col("in_favour") * 2 > F.col("judges")).withColumn("confidence", F.lit("medium")).withColumn("summary", told)


def synthesise(scores: DataFrame, keys: list[str], chairman: DataFrame | None = None, min_score: float = 0.7) -> DataFrame:
    """Mean of the judges unless the chairman's reply (keys, reply) has another; disagreement above a deviation of 0.15."""
    mean, std = mean_std()
    out = scores.groupBy(*keys).agg(F.coalesce(F.avg("score"), F.lit(0.5)).alias("mean"), std.alias("std"))
    out = out.join(chairman, keys, "left") if chairman is not None else out.withColumn("reply", F.lit(None).cast("string"))
    out = out.withColumn("s", synthesis_reply(F.coalesce("reply", F.lit("")), F.col("mean")))
    told = F.when(F.col("std") > 0.15, F.concat(F.lit("Judges disagreed (std: "), t.two_decimals(F.col("std")), F.lit(")")))
    return out.select(*keys, F.col("s.final_score").alias("final_score"), (F.col("s.final_score") >= min_score).alias("passed"), F.col("s.confidence").alias("confidence"), F.col("s.summary").alias("summary"), "std", told.alias("disagreement"))


def weak_areas(scores: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, area, n, first) of the areas that ``least`` judges or more name; ``first``: (judge, place) of the first."""
    named = scores.select(*keys, "judge", F.posexplode("weak_areas").alias("at", "area"))
    return named.groupBy(*keys, "area").agg(F.count("*").alias("n"), F.min(F.struct("judge", "at")).alias("first")).where(F.col("n") >= least)


def batch_verdict(scores: DataFrame, keys: list[str], min_score: float = 0.7, runs: DataFrame | None = None) -> DataFrame:
    """``scores``: keys, judge (order), the four scores and weak_areas.  Recommendations: areas that two judges name,
    else the first three, in order of first mention.  ``runs`` (keys): these without a judge score nothing and fail.

    Replies are parsed once: each gives a row for its scores and one for each area, which are summed by area first and
    then by run, so that what is collected for a run are its different areas."""
    four = ("overall_score", "role_adherence", "response_quality", "consistency")
    marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("weak_areas", F.array().cast("array<string>")))
    rows = scores.select(*keys, "judge", *four, F.posexplode(marked).alias("at", "area"))
    own = F.col("area").isNull()
    once = rows.groupBy(*keys, "area").agg(
        F.count("*").alias("n"), F.min(F.when(~own, F.struct("judge", "at"))).alias("first"), *[F.avg(F.when(own, F.col(c))).alias(c) for c in four],
        F.var_pop(F.when(own, F.col(four[0]))).alias("spread"),
    )
    listed = F.sort_array(F.collect_list(F.when(~own, F.struct("first", "area", "n"))))
    only = lambda c: F.max(F.when(own, c))
    out = once.groupBy(*keys).agg(*[only(F.col(c)).alias(c) for c in four], F.sqrt(F.coalesce(only(F.col("spread")), F.lit(0.0))).alias("std"), listed.alias("areas"))
    twice = F.transform(F.filter("areas", lambda x: x["n"] >= 2), lambda x: x["area"])
    advice = F.when(F.size(twice) > 0, twice).otherwise(F.slice(F.transform("areas", lambda x: x["area"]), 1, 3))
    sure = F.when(F.col("std") < 0.1, "high").when(F.col("std") < 0.2, "medium").otherwise("low")
    label = zip(("Score: ", " | Role: ", " | Quality: ", " | Consistency: "), four, strict=True)
    told = F.concat(*[x for name, c in label for x in (F.lit(name), t.two_decimals(F.col(c)))])
    out = out.select(*keys, F.col("overall_score").alias("final_score"), (F.col("overall_score") >= min_score).alias("passed"), sure.alias("confidence"), told.alias("summary"), advice.alias("recommendations"), F.struct(*four[1:]).alias("breakdown"))
    if runs is None:
        return out
    none = F.array().cast("array<string>")
    full = runs.select(*keys).distinct().join(out, keys, "left")
    return full.select(
        *keys, F.coalesce("final_score", F.lit(0.0)).alias("final_score"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.coalesce("summary", F.lit("No judges available")).alias("summary"), F.coalesce("recommendations", none).alias("recommendations"), "breakdown",
    )


def critique_prompt(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the evaluations of a case without the judges' names, for the chairman to criticise.  ``scores``:
    keys, judge (order), score, reasoning; a case has a handful of judges."""
    return _evaluations(scores, keys, lambda x, i: F.concat(F.lit("Judge "), (i + 1).cast("string"), F.lit(": Score "), t.two_decimals(x["score"]), F.lit(" - "), x["reasoning"]))


def synthesis_prompt(scores: DataFrame, keys: list[str], critiques: DataFrame | None = None) -> DataFrame:
    """(keys, text): the evaluations with the judges' names, and the critiques (keys, reply) if there are any."""
    out = _evaluations(scores, keys, lambda x, i: F.concat(F.lit("- "), x["judge"], F.lit(": Score "), t.two_decimals(x["score"]), F.lit(" - "), x["reasoning"]))
    if critiques is None:
        return out
    text = F.concat("text", F.when(F.coalesce("reply", F.lit("")) != "", F.concat(F.lit("\n\nCRITIQUES:\n"), "reply")).otherwise(""))
    return out.join(critiques.select(*keys, "reply"), keys, "left").select(*keys, text.alias("text"))


def _evaluations(scores: DataFrame, keys: list[str], line) -> DataFrame:
    each = F.struct("judge", F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
    return scores.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("e")).select(*keys, F.array_join(F.transform("e", line), "\n").alias("text"))


def batch_prompt(outputs: DataFrame, keys: list[str], order: str, most: int = 25, response: int = 400, expected: int = 150, told: bool = True) -> DataFrame:
    """The numbered blocks of the first ``most`` outputs of a run, with so many characters of response and expectation,
    and (``told``) how many more there are: (keys, text).  A single judge sees 20 outputs, 500 and 200 characters, and
    is not told of others."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    ranked = outputs.withColumn("_n", F.row_number().over(w))
    total = outputs.groupBy(*keys).agg(F.count("*").alias("_total"))
    block = F.concat(
        F.lit("\n### Test "), F.col("_n").cast("string"), F.lit(": "), F.col("test_id"), F.lit("\n**Prompt:** "), F.substring(F.coalesce("prompt", F.lit("")), 1, 200),
        F.lit("\n**Response:** "), F.substring(F.coalesce("response", F.lit("")), 1, response),
        F.when(F.coalesce("expected", F.lit("")) != "", F.concat(F.lit("\n**Expected:** "), F.substring("expected", 1, expected))).otherwise(""),
    )
    shown = ranked.where(F.col("_n") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", block.alias("b")))).alias("_b"))
    more = F.col("_total") - most
    blocks = F.transform("_b", lambda x: x["b"])
    blocks = F.when((more > 0) & F.lit(told), F.array_append(blocks, F.concat(F.lit("\n... and "), more.cast("string"), F.lit(" more tests (showing representative sample)")))).otherwise(blocks)
    return shown.join(total, keys).select(*keys, F.array_join(blocks, "\n---").alias("text"))


def matrix(outputs: DataFrame, members: list[str]) -> DataFrame:
    """Every output with every judge of a fixed list."""
    return outputs.withColumn("judge", F.explode(F.array(*map(F.lit, members))))
