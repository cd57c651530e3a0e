"""A ledger of calls: replies of models, kept in a table under a hash of model, system prompt and prompt.

Plans over replies read the ledger and never call a model themselves, so a plan that is run twice, a branch that is used
three times or a task that is run again asks nothing.  Only calls that the ledger lacks are made, each once however many
rows need it, and written in slices: when a run ends early, what its finished slices have asked is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import keep
from . import runs

REPLY = ("response", "latency_ms", "tokens_in", "tokens_out", "error")
CALL = "call string, model string, system_prompt string, prompt string"
SCHEMA = f"{CALL}, {runs.COMPLETION}, batch long"
#: Calls that are written at a time.
SLICE = 10_000


def call_key(model: Column, system_prompt: Column, prompt: Column) -> Column:
    """Null and empty texts are the same call."""
    none = F.lit("")
    return F.sha2(F.to_json(F.array(F.coalesce(model, none), F.coalesce(system_prompt, none), F.coalesce(prompt, none))).cast("binary"), 256)


class Ledger:
    """``path``: a folder in a store that all executors reach.  One run writes to a ledger at a time; any may read."""

    def __init__(self, spark: SparkSession, path: str, slice_calls: int = SLICE):
        self.spark, self.path, self.slice_calls = spark, path, slice_calls

    def rows(self) -> DataFrame:
        """All replies as they were written; none before the first."""
        try:
            found = self.spark.read.schema(SCHEMA).parquet(self.path)
            found.schema  # noqa: B018  resolves the path
            return found
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def replies(self) -> DataFrame:
        """(call, reply columns): the latest reply to each call."""
        return self.rows().groupBy("call").agg(F.max_by(F.struct(*REPLY), "batch").alias("r")).select("call", "r.*")

    def missing(self, calls: DataFrame, again: bool = False) -> DataFrame:
        """Calls (model, system_prompt, prompt) without a reply, each once; with ``again`` also those that failed."""
        known = self.replies()
        if again:
            known = known.where("error is null")
        keyed = calls.select(call_key(F.col("model"), F.col("system_prompt"), F.col("prompt")).alias("call"), "model", "system_prompt", "prompt")
        return keyed.join(known.select("call"), "call", "left_anti").dropDuplicates(["call"])

    def fill(self, calls: DataFrame, function: Callable[[dict], dict], again: bool = False, partitions: int | None = None, per_minute: float | None = None) -> int:
        """Makes the calls that the ledger lacks; how many there were."""
        todo = keep(self.missing(calls, again))
        n = todo.count()
        slices = -(-n // self.slice_calls)
        last = self.rows().agg(F.max("batch")).first()[0] if n else None
        for k in range(slices):
            part = todo.where(F.pmod(F.xxhash64("call"), F.lit(slices)) == k) if slices > 1 else todo
            asked = runs.complete(part, function, partitions, per_minute)
            asked.withColumn("batch", F.lit((last or 0) + k + 1).cast("long")).write.mode("append").parquet(self.path)
        return n

    def complete(self, cases: DataFrame, function: Callable[[dict], dict], again: bool = False, partitions: int | None = None, per_minute: float | None = None) -> DataFrame:
        """The cases (model, system_prompt, prompt and others) with their replies, as ``runs.complete`` gives them."""
        self.fill(cases, function, again, partitions, per_minute)
        return self.joined(cases)

    def joined(self, cases: DataFrame) -> DataFrame:
        """The cases with the replies that the ledger has; the join moves keys, not prompts of other cases."""
        key = call_key(F.col("model"), F.col("system_prompt"), F.col("prompt"))
        return cases.withColumn("call_", key).join(self.replies().withColumnRenamed("call", "call_"), "call_", "left").select(*cases.columns, *REPLY)

    def judge(self, function: Callable[[dict], dict], system_prompt: str | None = None, again: bool = False, partitions: int | None = None, per_minute: float | None = None) -> Callable[[DataFrame], DataFrame]:
        """What ``runs.council`` and ``runs.validate`` take as ``ask``: adds ``reply`` to rows of (judge, text), null where
        the judge failed."""

        def ask(shown: DataFrame) -> DataFrame:
            calls = shown.withColumns({"model": F.col("judge"), "system_prompt": F.lit(system_prompt).cast("string"), "prompt": F.col("text")})
            got = self.complete(calls, function, again, partitions, per_minute)
            return got.select(*shown.columns, F.when(F.col("error").isNull(), F.col("response")).alias("reply"))

        return ask
