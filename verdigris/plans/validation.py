"""Validation of a system prompt from suites to the stored score, as one plan over the ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import suites
from ..sources.history import History
from ..sources.store import keep
from . import runs
from .ledger import Ledger


@dataclass
class Validation:
    outputs: DataFrame  # run_id, test_id, prompt, response and others, one for each case
    verdict: Row | None
    version: int | None  # of the history, if the score was stored
    total: int


def bsp_cases(cases: DataFrame, bsp: str | None, model: str) -> DataFrame:
    """The cases with what is asked: model, system_prompt (of the run before the suite's), temperature and max_tokens."""
    return runs.settings(cases, model).withColumn("system_prompt", runs.system_prompt(F.lit(bsp).cast("string"), F.col("defaults")))


def run_cases(cases: DataFrame, ledger: Ledger, function: Callable[[dict], dict], run_id: str, timestamp: str, bsp: str | None, model: str, per_minute: float | None = 20, partitions: int = 1) -> DataFrame:
    """Outputs of all cases, in the columns of ``suites.OUTPUTS``'s structs with the run's id and time."""
    asked = ledger.complete(bsp_cases(cases, bsp, model), function, partitions=partitions, per_minute=per_minute)
    return asked.select(F.lit(run_id).alias("run_id"), F.lit(timestamp).alias("timestamp"), F.col("id").alias("test_id"), "prompt", F.col("system_prompt").alias("bsp"), "response", "expected", "latency_ms", "tokens_in", "tokens_out", "model", "assertions", "error")


def batch(outputs: DataFrame, bsp: str | None, bsp_version: str, model: str) -> DataFrame:
    """One row for each run, as ``suites.write_outputs`` stores it.  A run is one document, so its outputs meet there."""
    one = F.struct("test_id", "prompt", "bsp", "response", "expected", "latency_ms", "tokens_in", "tokens_out")
    packed = outputs.groupBy("run_id", "timestamp").agg(F.sort_array(F.collect_list(one)).alias("outputs"))
    said = F.lit(bsp or "")
    return packed.select("run_id", "timestamp", said.alias("bsp"), F.when(said != "", t.prompt_hash(said)).otherwise("").alias("bsp_hash"), F.lit(bsp_version).alias("bsp_version"), F.lit(model).alias("model"), F.size("outputs").alias("total_tests"), "outputs")


def validate(
    found: DataFrame | None, ledger: Ledger, function: Callable[[dict], dict], members: list[str], judge: Callable[[dict], dict], history: History, run_id: str, timestamp: str, bsp: str | None, model: str,
    version: str = "1.0.0", generate: Callable[[], DataFrame] | None = None, outputs_path: str | None = None, min_score: float = 0.7, threshold: float = 0.0, single: str | None = None, per_minute: float | None = 20, partitions: int = 1,
) -> Validation:
    """Runs the cases of suites (``found``: rows of ``suites.cases``), or those that ``generate`` makes if there are none,
    judges all outputs, compares the score with the latest one and stores it if it is better by more than ``threshold``
    (a first score: if it passed).  Suites that cannot be read are left out; no cases at all is an error.

    A validation that is run again with the same run_id asks nothing and stores nothing."""
    cases = found
    if (cases is None or cases.isEmpty()) and generate is not None:
        cases = generate()
    if cases is None or cases.isEmpty():
        raise ValueError("no cases: write suites or let them be generated")
    outputs = keep(run_cases(cases, ledger, function, run_id, timestamp, bsp, model, per_minute, partitions))
    if outputs_path is not None:
        suites.write_outputs(batch(outputs, bsp, version, model), outputs_path)
    ask = ledger.judge(judge, partitions=partitions, per_minute=per_minute)
    seen = history.version()
    verdict = runs.validate(outputs, members, ask, history.entries(seen), min_score, threshold, single).first()
    total = outputs.count()
    entry = {
        "run_id": run_id, "timestamp": timestamp, "score": verdict["final_score"], "bsp_hash": outputs.select(t.prompt_hash(F.lit(bsp or ""))).first()[0] if bsp else "", "bsp_version": version, "model": model,
        "total_tests": total, "passed": verdict["passed"], "confidence": verdict["confidence"],
    }
    better = lambda last: verdict["passed"] if last is None else entry["score"] - last["score"] > threshold
    return Validation(outputs, verdict, history.append(entry, better), total)
