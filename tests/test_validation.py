"""Validation from suites to the stored score, and the history under repeated and racing writers."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from test_ledger import counting

from verdigris.plans import generation, validation
from verdigris.plans.ledger import Ledger
from verdigris.sources import suites
from verdigris.sources.history import History


def entry(run_id, score, timestamp="2024-01-01", passed=True):
    return {"run_id": run_id, "timestamp": timestamp, "score": score, "passed": passed}


def test_versions(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.version() == 0 and h.entries().count() == 0
    assert [h.append_if_improved(entry(f"r{k}", s, f"2024-01-0{k + 1}"), 0.1) for k, s in enumerate((0.5, 0.55, 0.7, 0.7, 0.2, 0.95))] == [1, None, 2, None, None, 3]
    assert h.append_if_improved(entry("r0", 9.0)) is None  # the run is there
    assert [(r["position"], r["run_id"], r["score"]) for r in h.entries().orderBy("position").collect()] == [(1, "r0", 0.5), (2, "r2", 0.7), (3, "r5", 0.95)]
    assert h.entries(2).count() == 2


def test_racing_writers_leave_one_entry(spark, tmp_path):
    stores = [History(spark, str(tmp_path / "h")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: stores[k].append_if_improved(entry(f"w{k}", 0.8)), range(4)))
    assert sorted(got, key=str) == [1, None, None, None] and stores[0].entries().count() == 1
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: stores[k].append(entry(f"all{k}", 0.1 * k)), range(4)))
    assert sorted(got) == [2, 3, 4, 5] and stores[0].entries().count() == 5
    assert not list((tmp_path / "h" / "drafts").glob("*.json"))


def test_validation_from_files_to_the_stored_score(spark, tmp_path):
    folder = tmp_path / "suites"
    folder.mkdir()
    for k in range(3):
        (folder / f"s{k}.yaml").write_text(json.dumps({"defaults": {"model": "m/x", "system_prompt": "suite's"}, "cases": [{"id": f"c{k}-{i}", "prompt": f"q {k} {i}", "expected": "e"} for i in range(4)]}))
    (folder / "broken.yaml").write_text("cases: [")
    found = suites.cases(suites.parse(suites.discover(spark, str(folder))))
    call, made = counting(tmp_path / "calls")
    judged, judgements = counting(tmp_path / "judged")

    def judge(row):
        judged(row)
        return {"response": "OVERALL_SCORE: 0.8\nROLE_ADHERENCE: 0.8\nREASONING: r"}

    ledger, history = Ledger(spark, str(tmp_path / "ledger")), History(spark, str(tmp_path / "history"))
    run = lambda run_id, **more: validation.validate(found, ledger, call, ["a/1", "b/2"], judge, history, run_id, "2024-01-01", "You are a tutor.", "m/default", outputs_path=str(tmp_path / "out"), per_minute=None, **more)
    first = run("r1")
    assert (first.total, first.version, made(), judgements()) == (12, 1, 12, 2) and first.verdict["final_score"] == pytest.approx(0.8) and first.verdict["push"]
    assert {r["model"] for r in first.outputs.collect()} == {"m/x"} and {r["bsp"] for r in first.outputs.collect()} == {"You are a tutor."}
    again = run("r1")
    assert again.version is None and made() == 12 and judgements() == 2  # nothing is asked or stored twice
    later = run("r2")
    assert later.version is None and later.verdict["improvement"] == 0 and made() == 12
    stored = suites.read_outputs(spark, str(tmp_path / "out" / "run_id=r1")).first()
    assert stored["total_tests"] == 12 and stored["bsp_hash"] and len(stored["outputs"]) == 12


def test_cases_are_generated_where_there_are_none(spark, tmp_path):
    text = "The ledger is a long list of entries that every clerk must keep with care. Photosynthesis is the process by which green plants convert light into chemical energy."
    contents = spark.createDataFrame([(f"https://h{k}.org/", text) for k in range(3)], "url string, text string")
    results = spark.createDataFrame([("how to do code review", "brave", k, f"https://h{k}.org/") for k in range(3)], "query string, provider string, rank int, url string")
    edges = contents.selectExpr("url", "url as link", "1 as place")
    prompts = spark.createDataFrame([("p", "You are a code review expert.")], "prompt_id string, prompt string")
    call, made = counting(tmp_path / "calls")

    def generate():
        rows = generation.from_prompts(prompts, results.withColumn("query", generation.F.lit("code review guide")), contents, edges)
        return rows.selectExpr("*", "cast(null as string) as model", "cast(null as double) as temperature", "cast(null as int) as max_tokens").withColumn("defaults", generation.F.lit(None).cast(suites.SUITE.split("defaults ")[1].split(", stage")[0]))

    ledger, history = Ledger(spark, str(tmp_path / "ledger")), History(spark, str(tmp_path / "history"))
    args = (ledger, call, [], call, history, "r", "2024", "You are a code review expert.", "m/d")
    got = validation.validate(None, *args, generate=generate, per_minute=None)
    assert got.total == made() > 0 and got.version is None  # without judges nothing passes
    with pytest.raises(ValueError):
        validation.validate(None, *args)
