"""Suites, imports and stored state as DataFrames, and their sinks.

Files are found and read by Spark, so any store that Spark reaches will do; only the text of one suite at a time is
parsed in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import generate
from ..operators.assertions import ASSERTION, KINDS

CASE = f"struct<id:string,prompt:string,input:string,input_file:string,expected:string,assertions:array<{ASSERTION}>,tags:array<string>,model:string,temperature:double,max_tokens:int,timeout_ms:int>"
SUITE = (
    "path string, metadata struct<name:string,version:string,tags:array<string>,owner:string>, "
    "defaults struct<model:string,temperature:double,max_tokens:int,timeout_ms:int,system_prompt:string>, "
    f"stage string, cases array<{CASE}>, error string"
)
OUTPUTS = "run_id string, timestamp string, bsp string, bsp_hash string, bsp_version string, model string, total_tests int, outputs array<struct<test_id:string,prompt:string,bsp:string,response:string,expected:string,latency_ms:int,tokens_in:int,tokens_out:int>>"
BASELINE = "tag string, run_id string, timestamp string, results map<string,struct<status:string,response_hash:bigint,latency_ms:int,score:double>>"
#: Cases and characters of a suite file at most, by which the memory of who writes or parses it is bounded.
CASES, CHARS = 2_000, 1 << 20
HISTORY = "run_id string, timestamp string, score double, bsp_hash string, bsp_version string, model string, total_tests int, passed boolean, confidence string, tag string"


def discover(spark: SparkSession, directory: str, pattern: str = "*.{yaml,yml}") -> DataFrame:
    """(path, text) of suite files below a directory, sorted by path.  Spark passes over files without a byte."""
    files = spark.read.format("binaryFile").load(directory, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select("path", F.decode("content", "UTF-8").alias("text")).orderBy("path")


def _text(x):
    if x is not None and not isinstance(x, str):
        raise ValueError(f"not a string: {x!r}")
    return x


def _no_number(x: str):
    raise ValueError(f"not JSON: {x}")


def _load(source: str):
    """YAML; its JSON form is read as JSON, which takes a fraction of the time and memory and keeps every character."""
    if source.lstrip()[:1] == "{":
        try:
            return json.loads(source, parse_constant=_no_number)
        except ValueError:  # flow style
            pass
    import yaml

    return yaml.safe_load(source)


def _suite(source: str) -> dict:
    data = _load(source)
    if not data:
        raise ValueError("empty suite")
    if not isinstance(data, dict) or "cases" not in data:
        raise ValueError("no cases")
    meta, defaults = data.get("metadata"), data.get("defaults")
    if meta is not None and not meta.get("name"):
        raise ValueError("metadata without a name")
    cases = []
    for c in data["cases"] or []:
        checks = []
        for a in c.get("assertions") or []:
            if a.get("type") not in KINDS:
                raise ValueError(f"unknown assertion type: {a.get('type')!r}")
            checks.append({
                "type": a["type"], "value": _text(a.get("value")), "values": a.get("values"), "pattern": _text(a.get("pattern")), "min_score": a.get("min_score"), "chars": a.get("chars"),
                "case_sensitive": a.get("case_sensitive", True), "criteria": a.get("criteria"), "mode": a.get("mode"), "schema": json.dumps(a["schema"]) if a.get("schema") is not None else None,
            })
        cases.append({"id": _text(c["id"]), "prompt": _text(c.get("prompt")), "assertions": checks, "tags": c.get("tags") or [], **{k: c.get(k) for k in ("input", "input_file", "expected", "model", "temperature", "max_tokens", "timeout_ms")}})
    if defaults is not None:
        defaults = {"model": defaults.get("model"), "temperature": float(defaults.get("temperature", 0)), "max_tokens": defaults.get("max_tokens"), "timeout_ms": defaults.get("timeout_ms", 30000), "system_prompt": defaults.get("system_prompt")}
    if meta is not None:
        meta = {k: meta.get(k) for k in ("name", "version", "tags", "owner")}
    return {"metadata": meta, "defaults": defaults, "stage": data.get("stage"), "cases": cases}


def parse(files: DataFrame) -> DataFrame:
    """One row for each file; what cannot be loaded has its reason in ``error`` and no cases."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, source in zip(part["path"], part["text"], strict=True):
                try:
                    row = {"path": path, "error": None, **_suite(source)}
                except Exception as e:  # noqa: BLE001  the file is at fault, whatever it is
                    row = {"path": path, "error": f"{type(e).__name__}: {e}"[:500], "metadata": None, "defaults": None, "stage": None, "cases": None}
                yield pd.DataFrame({"path": [path], "json": [json.dumps(row)]})  # one suite at a time

    parsed = files.mapInPandas(run, "path string, json string")
    return parsed.select(F.from_json("json", SUITE).alias("s")).select("s.*")


def cases(suites: DataFrame, stage: str | None = None) -> DataFrame:
    """One row for each case of the suites that loaded, with the suite's defaults."""
    rows = suites.where("error is null")
    if stage is not None:
        rows = rows.where(F.col("stage") == stage)
    return rows.select("path", "stage", "defaults", F.posexplode("cases").alias("position", "case")).select("path", "stage", "defaults", "position", "case.*")


def errors(suites: DataFrame) -> DataFrame:
    return suites.where("error is not null").select("path", "error")


def import_csv(spark: SparkSession, path: str, input_column: str = "input", expected_column: str = "expected", stage_column: str = "stage", tags_column: str = "tags") -> DataFrame:
    """Cases of a CSV file with a header: a text that is expected must be contained; the first row sets the stage."""
    return csv_cases(t.numbered(spark.read.csv(path, header=True, multiLine=True, escape='"'), name="_i"), input_column, expected_column, stage_column, tags_column)


def csv_cases(rows: DataFrame, input_column: str = "input", expected_column: str = "expected", stage_column: str = "stage", tags_column: str = "tags") -> DataFrame:
    """Cases of rows that are numbered from 1 in ``_i``; a column that is not there is empty."""
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    expected = t.blank_to_null(col(expected_column))
    check = F.when(expected.isNotNull(), F.array(F.struct(F.lit("contains").alias("type"), expected.alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    tags = F.filter(F.transform(F.split(F.coalesce(col(tags_column), F.lit("")), ","), t.strip), lambda x: x != "")
    head = rows.where("_i = 1").select(col(stage_column)).first()
    stage = F.lit(head[0] if head else None).cast("string")
    return rows.select(F.concat(F.lit("imported-"), F.col("_i").cast("string")).alias("id"), F.coalesce(col(input_column), F.lit("")).alias("prompt"), expected.alias("expected"), check.alias("assertions"), tags.alias("tags"), stage.alias("stage"))


def import_jsonl(spark: SparkSession, path: str, prompt_key: str = "prompt", response_key: str = "response") -> DataFrame:
    """Cases of captured exchanges, one JSON object a line.  Blank and broken lines and empty prompts are skipped, but
    counted in the ids."""
    return exchange_cases(t.numbered(spark.read.text(path), name="_i"), prompt_key, response_key)


def exchange_cases(rows: DataFrame, prompt_key: str = "prompt", response_key: str = "response") -> DataFrame:
    """Cases of lines (``value``) that are numbered from 1 in ``_i``."""
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    rows = rows.withColumn("_m", parsed)
    prompt, response = F.try_element_at("_m", F.lit(prompt_key)), t.blank_to_null(F.try_element_at("_m", F.lit(response_key)))
    check = F.when(response.isNotNull(), F.array(F.struct(F.lit("semantic_similarity").alias("type"), response.alias("value"), F.lit(0.8).alias("min_score")))).otherwise(F.array().cast("array<struct<type:string,value:string,min_score:double>>"))
    return rows.where(F.coalesce(prompt, F.lit("")) != "").select(F.concat(F.lit("captured-"), F.col("_i").cast("string")).alias("id"), prompt.alias("prompt"), response.alias("expected"), check.alias("assertions"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUTS).json(path, multiLine=True)


def write_outputs(outputs: DataFrame, path: str) -> None:
    outputs.write.mode("append").partitionBy("run_id").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The score history with its order of storage; a store that does not exist is empty, and files in it that cannot
    be read are passed over."""
    try:
        rows = spark.read.schema(HISTORY + ", position bigint").option("ignoreCorruptFiles", True).parquet(path)
        rows.schema  # noqa: B018  resolves the path
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], HISTORY + ", position bigint")
        raise


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_baseline(snapshot: DataFrame, path: str, tag: str) -> None:
    """Replaces the rows of one tag and no other."""
    snapshot.withColumn("tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(path)


def read_baseline(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("tag") == tag).drop("tag")


def delete_baseline(spark: SparkSession, path: str, tag: str) -> bool:
    """Removes the rows of one tag; whether there were any."""
    jvm = spark.sparkContext._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tag)
    folder = jvm.org.apache.hadoop.fs.Path(path, f"tag={escaped}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def baseline_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tag").distinct()


def _suite_texts(cases: Iterable[str], name: str, stage: str | None) -> Iterator[str]:
    """Suites of at most ``CASES`` cases and about ``CHARS`` characters; a longer case has one of its own."""
    head = json.dumps({"metadata": {"name": name}, **({"stage": stage} if stage else {})}, ensure_ascii=False)[:-1] + ', "cases": ['
    held, size = [], 0
    for case in cases:
        if held and (len(held) == CASES or size + len(case) > CHARS):
            yield head + ", ".join(held) + "]}"
            held, size = [], 0
        held.append(case)
        size += len(case)
    if held:
        yield head + ", ".join(held) + "]}"


def write_suite(rows: DataFrame, path: str, name: str, stage: str | None = None) -> None:
    """Suite files in YAML's JSON form, a line each: as many for each partition of the rows as its cases need."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for text in _suite_texts((x for part in parts for x in part["case"]), name, stage):
            yield pd.DataFrame({"value": [text]})

    packed = rows.select(F.to_json(F.struct(*rows.columns)).alias("case"))
    packed.mapInPandas(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_generated(made: dict[str, DataFrame], path: str, domain: str) -> dict[str, str]:
    """Writes what ``generate.process`` has made, each kind to a folder of its own and only if it has rows:
    ``benchmark``, ``masked`` and ``roleplay`` as suites, ``finetune`` as lines of JSON.  The folders by kind."""
    slug = domain.lower().replace(" ", "_")
    rows = {
        "benchmark": lambda x: generate.answer_cases(x, domain, [*[c for c in x.columns if c in ("url", "doc_id")], "position"]),
        "masked": lambda x: generate.cloze_cases(x, domain, [*[c for c in x.columns if c in ("url", "doc_id")], "position"]),
        "roleplay": lambda x: x,
    }
    out = {}
    for kind, found in made.items():
        if found.isEmpty():
            continue
        out[kind] = f"{path}/{slug}_{'cloze' if kind == 'masked' else kind}"
        if kind == "finetune":
            found.select("value").write.mode("overwrite").text(out[kind])
        else:
            write_suite(rows[kind](found), out[kind], f"{domain.title()} - {kind}")
    return out


def stages(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Pipeline stages (name, prompt_template, prompt_file, position): of one name the last wins, at the first's place."""
    return stage_rows(spark.createDataFrame([(r["name"], r.get("prompt_template"), r.get("prompt_file"), i) for i, r in enumerate(rows)], "name string, prompt_template string, prompt_file string, at int"))


def stage_rows(every: DataFrame) -> DataFrame:
    """``stages`` of rows (name, prompt_template, prompt_file, at)."""
    last = F.max_by(F.struct("prompt_template", "prompt_file"), "at")
    return every.groupBy("name").agg(F.min("at").alias("position"), last.alias("s")).select("name", "position", "s.*")


def stage(stages_: DataFrame, name: str) -> DataFrame:
    """The stage of this name, if there is one."""
    return stages_.where(F.col("name") == name)


def stage_names(stages_: DataFrame) -> list[str]:
    """In order; a pipeline has a handful of stages."""
    return [r["name"] for r in stages_.orderBy("position").select("name").collect()]


def stage_prompts(stages_: DataFrame, files: DataFrame) -> DataFrame:
    """The prompt of each stage: its template, else its file's text.  ``files``: (path, text)."""
    f = files.select(F.col("path").alias("prompt_file"), F.col("text").alias("_text"))
    return stages_.join(f, "prompt_file", "left").withColumn("prompt", F.coalesce(t.blank_to_null(F.col("prompt_template")), "_text")).drop("_text")


def stage_problems(stages_: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select(F.col("path").alias("prompt_file"), F.lit(True).alias("_there"))
    rows = stages_.join(f, "prompt_file", "left")
    none = F.when(t.blank_to_null(F.col("prompt_template")).isNull() & F.col("prompt_file").isNull(), F.concat(F.lit("Stage '"), F.col("name"), F.lit("' has no prompt source")))
    gone = F.when(F.col("prompt_file").isNotNull() & F.col("_there").isNull(), F.concat(F.lit("Stage '"), F.col("name"), F.lit("': file not found: "), F.col("prompt_file")))
    return rows.select("name", F.explode(F.array_compact(F.array(none, gone))).alias("problem"))
