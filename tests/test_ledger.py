"""Calls of models: each once, however often plans read the replies."""

import os
import time
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.plans import ledger, runs

MEMBERS = ["m/one", "m/two", "m/three"]


def counting(folder, hard=None):
    """A model that leaves a file for each call; prompts that hold ``hard`` end the whole task."""
    folder.mkdir(exist_ok=True)
    path = str(folder)

    def call(row):
        if hard and hard in row["prompt"] and not os.path.exists(f"{path}/mended"):
            raise SystemExit("lost")
        open(f"{path}/{uuid.uuid4()}", "w").write(row["model"])
        if "bad" in row["prompt"]:
            raise ValueError("status 500")
        return {"response": f"SCORE: 0.9\nFINAL_SCORE: 0.8\nREASONING: fine {zlib.crc32(row['prompt'].encode())}\nSUMMARY: s", "latency_ms": 1, "tokens_in": 2, "tokens_out": 3}

    return call, lambda: sum(x != "mended" for x in os.listdir(path))


def outputs(spark, n=10):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)], "id int, text string")


@pytest.mark.parametrize("mode,calls", [("vote", 30), ("fast", 40), ("full", 50)])
@pytest.mark.parametrize("kept", [True, False])
def test_a_council_asks_each_judge_once(spark, tmp_path, mode, calls, kept):
    call, made = counting(tmp_path / "calls")
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))

    def plainly(shown):
        got = runs.complete(shown.withColumns({"model": F.col("judge"), "prompt": F.col("text")}), call)
        return got.select(*shown.columns, F.col("response").alias("reply"))

    ask = book.judge(call, "be fair") if kept else plainly
    for again in range(2 if kept else 1):
        verdicts = runs.council(outputs(spark), ["id"], MEMBERS, ask, mode)
        assert verdicts.count() == 10 and len(verdicts.collect()) == 10 and verdicts.where("final_score > 0.5").count() == 10
        assert made() == calls, again


def test_equal_calls_are_one(spark, tmp_path):
    call, made = counting(tmp_path / "calls")
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    cases = spark.createDataFrame([(i, "m", None if i % 2 else "", "same") for i in range(20)] + [(20, "n", "", "same"), (21, None, None, None)], "id int, model string, system_prompt string, prompt string")
    got = book.complete(cases.withColumns({"call": F.lit("x"), "batch": F.lit(1)}).where("prompt is not null"), call)
    assert got.columns == ["id", "model", "system_prompt", "prompt", "call", "batch", *ledger.REPLY] and got.where("tokens_out = 3").count() == 21
    assert made() == 2 and book.complete(cases.limit(0), call).count() == 0 and made() == 2


def test_failures_are_kept_and_asked_again_only_if_told(spark, tmp_path):
    call, made = counting(tmp_path / "calls")
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    cases = spark.createDataFrame([("m", None, p) for p in ("good", "bad")], "model string, system_prompt string, prompt string")
    for _ in range(2):
        got = {r["prompt"]: r["error"] for r in book.complete(cases, call).collect()}
        assert got == {"good": None, "bad": "status 500"} and made() == 2
    assert book.fill(cases, lambda row: {"response": "mended"}, again=True) == 1
    assert {r["prompt"]: (r["response"][:6], r["error"]) for r in book.joined(cases).collect()}["bad"] == ("mended", None)


def test_a_lost_run_asks_for_the_rest_only(spark, tmp_path):
    call, made = counting(tmp_path / "calls", hard="text 7")
    book = ledger.Ledger(spark, str(tmp_path / "ledger"), slice_calls=5)
    cases = outputs(spark, 40).select(F.lit("m").alias("model"), F.lit(None).cast("string").alias("system_prompt"), F.col("text").alias("prompt"))
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of a dead worker
        book.fill(cases, call)
    had = book.rows().count()
    assert 0 < had < 40
    (tmp_path / "calls" / "mended").write_text("")
    assert book.fill(cases, call) == 40 - had and book.replies().count() == 40


def test_pace_of_all_tasks(spark, tmp_path):
    cases = spark.range(40).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("prompt"))

    def call(row):
        return {"response": str(time.time())}

    out = [float(r["response"]) for r in runs.complete(cases, call, partitions=4, per_minute=600).collect()]
    assert max(out) - min(out) >= 60 / 600 * 40 * 0.7 and len(out) == 40


def test_pace_slows_down_when_told():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    pace = runs.Pace(1.0, clock=lambda: now[0], sleep=sleep)
    for error in (None, ValueError("status 429"), None, None):
        try:
            with pace:
                if error:
                    raise error
        except ValueError:
            pass
    with pace:
        pass
    assert waits == [1.0, 1.0, 2.0, 1.8]
