"""Runs: cases to responses, checks, verdicts and comparison, as one lazy plan of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import assertions, baselines, judges
from ..sources.store import keep

COMPLETION = "response string, latency_ms int, tokens_in int, tokens_out int, error string"


def settings(cases: DataFrame, model: str) -> DataFrame:
    """Model, temperature and max_tokens of each case.  Blank models fall through; the suite's limit of tokens is not
    asked; zero tokens mean the default."""
    d, has = F.col("defaults"), F.col("defaults").isNotNull()
    return cases.withColumns({
        "model": F.coalesce(t.blank_to_null(F.col("model")), t.blank_to_null(d["model"]), F.lit(model)),
        "temperature": F.when(F.col("temperature").isNotNull(), F.col("temperature")).when(has, d["temperature"]).otherwise(F.lit(0.0)),
        "max_tokens": F.coalesce(F.nullif("max_tokens", F.lit(0)), F.lit(1000)),
    })


def system_prompt(bsp: Column, defaults: Column) -> Column:
    return F.coalesce(t.blank_to_null(bsp), defaults["system_prompt"])


def provider(model: Column) -> Column:
    """struct(provider, name): what stands before the first slash, or the local one."""
    at = F.locate("/", model)
    return F.when(at > 0, F.struct(F.substring_index(model, "/", 1).alias("provider"), F.substring(model, at + 1, F.length(model)).alias("name"))).otherwise(F.struct(F.lit("ollama").alias("provider"), model.alias("name")))


class Pace:
    """Least seconds between the calls of one task: they double with each reply that asks for patience (``slow``), and
    shrink back with the others."""

    def __init__(self, gap: float, slow: Callable[[Exception], bool] = lambda e: "429" in str(e), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least, self.gap, self.slow, self.clock, self.sleep, self.next = gap, gap, slow, clock, sleep, None

    def __enter__(self):
        now = self.clock()
        if self.next is not None and self.next > now:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap
        return self

    def __exit__(self, kind, error, trace):
        self.gap = min(self.gap * 2, self.least * 64) if error is not None and self.slow(error) else max(self.least, self.gap * 0.9)


def complete(cases: DataFrame, function: Callable[[dict], dict], partitions: int | None = None, per_minute: float | None = None) -> DataFrame:
    """Calls a function for each case; an exception becomes the response ``ERROR: ...``.  ``partitions`` bounds how
    many calls run at once.  ``per_minute`` bounds the calls of all tasks together: each of ``partitions`` (1 unless
    told) tasks has its share of them.  The plan calls again whenever it is run; ``ledger.Ledger`` keeps the replies."""
    if per_minute is not None:
        partitions = partitions or 1
    src = cases.repartition(partitions) if partitions else cases
    names = src.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(60 * partitions / per_minute) if per_minute else nullcontext()
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                try:
                    with pace:
                        rows.append({"error": None, **function(row)})
                except Exception as e:  # noqa: BLE001  whatever the function raises is this case's result
                    rows.append({"response": f"ERROR: {e}", "error": str(e)})
            got = pd.DataFrame(rows, columns=["response", "latency_ms", "tokens_in", "tokens_out", "error"], index=part.index)
            yield pd.concat([part, got], axis=1)

    from pyspark.sql import types as T

    extra = T.StructType.fromDDL(COMPLETION)
    return src.mapInPandas(run, T.StructType([*src.schema.fields, *extra.fields])).select(*names, *extra.names)


def retrying(function: Callable[[dict], dict], attempts: int = 5, delay: float = 2.0, again: Callable[[Exception], float | None] = lambda e: 0.0 if "429" in str(e) else None, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], dict]:
    """The function, called up to ``attempts`` times with waits that double from ``delay`` seconds.  ``again`` gives the
    seconds to wait at least after an exception, or None if another call is of no use."""

    def call(row: dict) -> dict:
        for k in range(attempts):
            try:
                return function(row)
            except Exception as e:
                wait = again(e)
                if wait is None or k == attempts - 1:
                    raise
                sleep(max(wait, delay * 2**k))
        raise ValueError("attempts must be positive")

    return call


def request_body(kind: str, model: Column, prompt: Column, system: Column, temperature: Column, max_tokens: Column) -> Column:
    """The JSON body of a provider's request; a blank system prompt is left out."""
    said = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    has = F.coalesce(system, F.lit("")) != ""
    messages = F.when(has, F.array(said("system", system), said("user", prompt))).otherwise(F.array(said("user", prompt)))
    if kind == "ollama":
        body = F.struct(model.alias("model"), messages.alias("messages"), F.lit(False).alias("stream"), F.struct(temperature.alias("temperature"), max_tokens.alias("num_predict")).alias("options"))
    elif kind == "openai":
        body = F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens"))
    elif kind == "anthropic":
        body = F.struct(model.alias("model"), max_tokens.alias("max_tokens"), F.array(said("user", prompt)).alias("messages"), F.when(has, system).alias("system"), F.when(temperature > 0, temperature).alias("temperature"))
    elif kind == "google":
        text = F.when(has, F.concat(system, F.lit("\n\n"), prompt)).otherwise(prompt)
        parts = F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")))
        body = F.struct(parts.alias("contents"), F.struct(temperature.alias("temperature"), max_tokens.alias("maxOutputTokens")).alias("generationConfig"))
    else:
        raise ValueError(f"unknown provider: {kind}")
    return F.to_json(body)


def from_recordings(cases: DataFrame, recordings: DataFrame) -> DataFrame:
    """Responses recorded for (model, system_prompt, prompt); the key is a hash, so that the join moves no prompts."""
    key = lambda: F.xxhash64("model", F.coalesce("system_prompt", F.lit("")), "prompt")
    rec = recordings.select(key().alias("_k"), "response", "latency_ms", "tokens_in", "tokens_out").groupBy("_k").agg(F.first(F.struct("response", "latency_ms", "tokens_in", "tokens_out")).alias("_r"))
    return cases.withColumn("_k", key()).join(rec, "_k", "left").select(*cases.columns, "_r.*", F.when(F.col("_r").isNull(), "no recording").alias("error"))


def unpack_reply(body: Column, kind: str) -> Column:
    """struct(text, tokens_in, tokens_out) of a provider's JSON reply."""
    get = lambda p: F.get_json_object(body, p)
    if kind == "ollama":
        return F.struct(get("$.message.content").alias("text"), get("$.prompt_eval_count").cast("int").alias("tokens_in"), get("$.eval_count").cast("int").alias("tokens_out"))
    if kind == "openai":
        return F.struct(get("$.choices[0].message.content").alias("text"), get("$.usage.prompt_tokens").cast("int").alias("tokens_in"), get("$.usage.completion_tokens").cast("int").alias("tokens_out"))
    if kind == "anthropic":
        parts = F.from_json(get("$.content"), "array<struct<type:string,text:string>>")
        text = F.array_join(F.transform(F.filter(parts, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
        return F.struct(text.alias("text"), get("$.usage.input_tokens").cast("int").alias("tokens_in"), get("$.usage.output_tokens").cast("int").alias("tokens_out"))
    if kind == "google":
        parts = F.from_json(get("$.candidates[0].content.parts"), "array<struct<text:string>>")
        return F.struct(F.array_join(F.transform(parts, lambda b: b["text"]), "").alias("text"), get("$.usageMetadata.promptTokenCount").cast("int").alias("tokens_in"), get("$.usageMetadata.candidatesTokenCount").cast("int").alias("tokens_out"))
    raise ValueError(f"unknown provider: {kind}")


def suite_run(cases: DataFrame, keys: list[str], verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checks, case statuses and the summary of cases that have responses.  Three plans over the same cases: responses
    that a model gives come from a ledger or are kept before."""
    checks = assertions.evaluate(cases)
    if verdicts is not None:
        checks = assertions.with_verdicts(checks, verdicts, keys)
    statuses = assertions.case_status(checks, cases, keys, "error" if "error" in cases.columns else None)
    return checks, statuses, assertions.run_summary(statuses)


def council(outputs: DataFrame, keys: list[str], members: list[str], ask: Callable[[DataFrame], DataFrame], mode: str = "fast", chairman: str | None = None, min_score: float = 0.7) -> DataFrame:
    """The verdict on each output (keys, text: what the judges are shown).  ``ask`` adds ``reply`` to (keys, judge,
    text), null where a judge failed, which counts as 0.5.  ``vote``: the majority; ``fast``: the chairman merges the
    evaluations; ``full``: after having criticised them.  The chairman is the first member unless named.  Each round of
    replies is kept before it is used, so every judge is asked once."""
    asked = keep(ask(judges.matrix(outputs.select(*keys, "text"), members)))
    parsed = asked.select(*keys, "judge", F.when(F.col("reply").isNotNull(), judges.single_reply(F.col("reply"))).alias("s"))
    scores = parsed.select(*keys, "judge", F.coalesce("s.score", F.lit(0.5)).alias("score"), F.coalesce("s.reasoning", F.lit("Error")).alias("reasoning"))
    if mode == "vote":
        return judges.vote(scores, keys, min_score)
    head = F.lit(chairman or members[0])
    critiques = keep(ask(judges.critique_prompt(scores, keys).withColumn("judge", head))) if mode == "full" else None
    merged = keep(ask(judges.synthesis_prompt(scores, keys, critiques).withColumn("judge", head)))
    return judges.synthesise(scores, keys, merged.select(*keys, "reply"), min_score)


def single_judge(outputs: DataFrame, model: str, ask: Callable[[DataFrame], DataFrame], min_score: float = 0.7) -> DataFrame:
    """The verdict of one model on each run, where no council is wanted."""
    shown = judges.batch_prompt(outputs, ["run_id"], "test_id", most=20, response=500, expected=200, told=False)
    replies = keep(ask(shown.withColumn("judge", F.lit(model)))).withColumn("s", judges.strict_reply(F.coalesce("reply", F.lit(""))))
    summary = F.coalesce(t.blank_to_null(F.col("s.summary")), F.substring(F.coalesce("reply", F.lit("")), 1, 500))
    score = F.col("s.final_score")
    return replies.select("run_id", score.alias("final_score"), (score >= min_score).alias("passed"), F.col("s.confidence").alias("confidence"), summary.alias("summary"), F.col("s.recommendations").alias("recommendations"))


def validate(outputs: DataFrame, members: list[str], ask: Callable[[DataFrame], DataFrame], history: DataFrame, min_score: float = 0.7, threshold: float = 0.0, single: str | None = None) -> DataFrame:
    """The verdict of each run against the latest stored score: one prompt for each judge and run, however many
    outputs it has.  ``ask`` adds a column ``reply`` to (run_id, judge, text).  Runs without judges score nothing;
    ``single`` names one model that judges in the council's place."""
    if single is not None:
        verdict = single_judge(outputs, single, ask, min_score)
    elif not members:
        none = outputs.limit(0).select("run_id", F.lit(None).cast("string").alias("judge"), *[F.lit(None).cast("double").alias(c) for c in ("overall_score", "role_adherence", "response_quality", "consistency")], F.lit(None).cast("array<string>").alias("weak_areas"))
        verdict = judges.batch_verdict(none, ["run_id"], min_score, outputs)
    else:
        asked = judges.matrix(judges.batch_prompt(outputs, ["run_id"], "test_id"), members)
        scores = keep(ask(asked)).withColumn("s", judges.batch_reply(F.coalesce("reply", F.lit("")))).select("run_id", "judge", "s.*")
        verdict = judges.batch_verdict(scores, ["run_id"], min_score, outputs)
    last = baselines.latest(history).select(F.col("score").alias("previous"))
    out = verdict.join(F.broadcast(last), F.lit(True), "left")  # one row at most
    out = out.withColumn("improvement", F.col("final_score") - F.col("previous"))
    return out.withColumn("push", baselines.should_push(F.col("previous"), F.col("final_score"), F.col("passed"), threshold))
