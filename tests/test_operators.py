"""Golden rows of single operators; expected values follow from the semantics."""

import json
import random
import re
import time

import pytest
from helpers import same
from pyspark.sql import functions as F

from verdigris import catalog
from verdigris.functions import text as t
from verdigris.functions import urls
from verdigris.operators import assertions, baselines, generate, html, judges, prompts
from verdigris.plans import runs
from verdigris.sources import config, suites


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_numbers(spark):
    assert one(spark, t.numbers(F.lit("cost $70,000.00 or 45.0, x"))) == ["70000", "45"]
    assert one(spark, assertions.contains_number(F.lit("cost $70,000.00"), F.lit("70000"))) is True


def test_exact_match_strips_any_space(spark):
    assert one(spark, assertions.exact_match(F.lit("yes\n"), F.lit(" Yes "), False)) is True
    assert one(spark, assertions.exact_match(F.lit("yes\n"), F.lit(" Yes "), True)) is False


@pytest.mark.parametrize("text,valid", [("NaN", True), ('{"a":1,"a":2}', True), ('{"a":1} x', False), ("", False), (None, False)])
def test_json_valid(spark, text, valid):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(assertions.json_valid("s").alias("x")).first()["x"] is valid


def test_assertion_table(spark):
    fields = "type string, value string, values array<string>, pattern string, min_score double, chars int, case_sensitive boolean, criteria string, mode string, schema string"
    none = dict.fromkeys(f.split()[0] for f in fields.split(", "))
    checks = [{"type": "one_of", "values": []}, {"type": "min_length", "value": "50"}, {"type": "regex", "pattern": "("}, {"type": "regex", "pattern": "HEL+O", "case_sensitive": False}, {"type": "json_schema"}, {"type": "contains", "value": ""}]
    rows = spark.createDataFrame([(1, "hello", [tuple((none | c).values()) for c in checks]), (2, None, [])], f"id int, response string, assertions array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    checked, statuses, summary = runs.suite_run(rows, ["id"])
    got = {r["position"]: (r["passed"], r["message"]) for r in checked.collect()}
    assert got == {0: (False, "No values specified"), 1: (False, "No chars specified"), 2: (False, "Invalid pattern"), 3: (True, "ok"), 4: (False, "Unknown assertion type: json_schema"), 5: (True, "ok")}
    assert {r["id"]: r["status"] for r in statuses.collect()} == {1: "failed", 2: "passed"}
    assert summary.first().asDict() == {"total": 2, "passed": 1, "failed": 1, "errors": 0, "pass_rate": 0.5}


@pytest.mark.parametrize(
    "reply,overall,role",
    [("OVERALL_SCORE: 85", 1.0, 1.0), ("Rating 8.5 of ten", 0.85, 0.85), ("Total = 92", 0.92, 0.92), ("good and clear but lacks depth", 0.575, 0.575), ("OVERALL_SCORE: 0", 0.0, 0.5), ("nothing here", 0.5, 0.5), ("overall score: 0.4\nROLE ADHERENCE: x 0.9", 0.4, 0.9)],
)
def test_batch_reply(spark, reply, overall, role):
    x = one(spark, judges.batch_reply(F.lit(reply)))
    assert x["overall_score"] == pytest.approx(overall) and x["role_adherence"] == pytest.approx(role)


def test_other_replies(spark):
    assert one(spark, judges.single_reply(F.lit("SCORE: 0.2\nSCORE: 0.9\nREASONING: fine")))[:] == (0.9, "fine", True)
    x = one(spark, judges.synthesis_reply(F.lit("FINAL_SCORE: 1.7\nCONFIDENCE: maybe\nSUMMARY: ok"), F.lit(0.5)))
    assert x[:] == (1.7, "medium", "ok")
    x = one(spark, judges.strict_reply(F.lit("OVERALL_SCORE: 0.8d\nCONSISTENCY: 1.5\nRECOMMENDATIONS: a, b")))
    assert x["overall_score"] == 0.5 and x["consistency"] == 1.5 and x["recommendations"] == ["a", "b"]


def test_lines_of_a_reply_are_split_once(spark):
    df = spark.createDataFrame([("a",)], "reply string")
    for x in (judges.strict_reply(F.col("reply")), judges.single_reply(F.col("reply")), judges.synthesis_reply(F.col("reply"), F.lit(0.5))):
        plan = df.select(x.alias("s")).select("s.*")._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"split\(reply", plan)) == 1


def test_votes(spark):
    rows = spark.createDataFrame([("a", 0.8), ("a", 0.8), ("a", 0.5), ("b", 0.8), ("b", 0.5)], "id string, score double")
    got = {r["id"]: r for r in judges.vote(rows, ["id"]).collect()}
    assert got["a"]["passed"] and got["a"]["final_score"] == pytest.approx(0.7) and got["a"]["summary"] == "2/3 judges passed"
    assert not got["b"]["passed"]


def test_batch_verdict_recommendations(spark):
    schema = "run_id int, judge int, overall_score double, role_adherence double, response_quality double, consistency double, weak_areas array<string>"
    rows = spark.createDataFrame([(1, 1, 0.9, 0.9, 0.9, 0.9, ["z", "tone"]), (1, 2, 0.8, 0.8, 0.8, 0.8, ["tone"]), (2, 1, 0.1, 0.1, 0.1, 0.1, ["b", "a"]), (2, 2, 0.9, 0.9, 0.9, 0.9, [])], schema)
    got = {r["run_id"]: r for r in judges.batch_verdict(rows, ["run_id"]).collect()}
    assert got[1]["recommendations"] == ["tone"] and got[1]["confidence"] == "high" and got[1]["summary"].startswith("Score: 0.85 | Role: 0.85")
    assert got[2]["recommendations"] == ["b", "a"] and got[2]["confidence"] == "low"


def test_regressions(spark):
    schema = "case_id string, status string, latency_ms int, score double"
    base = spark.createDataFrame([("a", "passed", 100, 0.90), ("b", "passed", 0, 0.90)], schema)
    now = spark.createDataFrame([("a", "failed", 151, 0.74), ("b", "error", 9, 0.0), ("c", "failed", 1, 0.1)], schema)
    got = [(r["case_id"], r["kind"], r["severity"]) for r in baselines.compare(now, base).orderBy("case_id", "place").collect()]
    assert got == [("a", "status", "high"), ("a", "latency", "medium"), ("a", "score", "medium")]
    assert baselines.compare(base, base).count() == 0


def test_latest_takes_the_earliest_of_ties(spark):
    h = spark.createDataFrame([("2024", 1, 0.5), ("2025", 2, 0.6), ("2025", 3, 0.7)], "timestamp string, position int, score double")
    assert baselines.latest(h).first()["score"] == 0.6


def test_question_families(spark):
    text = "What is a catalyst engine? It plans queries well. Q: Which way is the best one? A: The second way is the best."
    got = one(spark, generate.qa_patterns(F.lit(text)))
    assert ("What is a catalyst engine?", "It plans queries well.") in [tuple(p) for p in got]
    assert one(spark, generate.is_valid_qa(F.lit("What is the next thing?"), F.lit("Some long answer."))) is False


#: The families written without thought of speed, as Python would run them: openings, sentences of an answer.
SLOW = [
    r"(?is)(?:Q|Question)[:\s]+(.+?)(?:A|Answer)[:\s]+(.+?)(?=(?:Q|Question)[:\s]|$)",
    *(rf"(?i)({opening} [^?]+\?)\s*([^.!?]+[.!?]{'(?:[^.!?]+[.!?])?' if n == 2 else ''})" for opening, n in generate.OPENINGS),
]


def test_linear_families_find_the_same(spark):
    rng = random.Random(5)
    parts = ["What is", "How to", "Which", "Why are", "When do", "Q:", "A:", "Question ", "answer: ", " a ", " q ", "?", "? ", ".", "!", "\n", "  ", "some longer words here", "another thing entirely", "yes indeed it is so"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 25))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r["i"]: r for r in rows.select("i", *[F.expr("null").alias("x")], *[F.regexp_extract_all("s", F.lit(p), F.lit(g)).alias(f"g{k}_{g}") for k, p in enumerate(generate.families()) for g in (1, 2)]).collect()}
    for i, text in enumerate(texts):
        for k, slow in enumerate(SLOW):
            want = [(q.strip(), a.strip()) for q, a in re.findall(slow, text) if len(q.strip()) > 5 and len(a.strip()) > 5]
            mine = [(q.strip(), a.strip()) for q, a in zip(got[i][f"g{k}_1"], got[i][f"g{k}_2"], strict=True) if len(q.strip()) > 5 and len(a.strip()) > 5]
            assert mine == want, (k, text)


@pytest.mark.parametrize("text", ["Foo " * 50_000, "q " * 70_000, "what is " * 25_000, "how to x? " * 20_000, "q a " * 40_000, "can go " * 30_000 + "\n", "never " * 30_000, "which" + " " * 150_000 + "x", "Q" + " " * 150_000, "only that " * 20_000 + "\n" + "only this"])
def test_long_texts(spark, text):
    began = time.time()
    r = prompts.analyse(spark.createDataFrame([(text,)], "prompt string")).first()
    assert r["role"] and len(r["keywords"]) <= 20
    one(spark, generate.qa_patterns(F.lit(text)))
    assert time.time() - began < 20


def test_phrases_are_what_the_patterns_capture(spark):
    rng = random.Random(6)
    parts = ["can ", "will ", "only ", "never ", "and ", "within ", ". ", ", ", "\n", "walk the dog", "sandy", "x", "\r", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for patterns in (prompts.CAPABILITY_PATTERNS, prompts.CONSTRAINT_PATTERNS):
        for i, found in rows.select("i", prompts.phrases(F.col("s"), patterns)).collect():
            want = [x.strip()[:100] for p in patterns for x in re.findall(f"(?i){p}", texts[i]) if len(x.strip()) > 5][:10]
            assert found == want, texts[i]


def test_guarded_patterns_find_the_same(spark):
    rng, words = random.Random(3), ["can", "CAN", "aSſists", "ſhould", "wİthin", "ınside", "\u212aan", "able to", "x", "only", "never", "provide", "helps users to", "limited to", ".", ",", "and", "\n"]
    rows = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(12)),) for _ in range(300)], "s string")
    every = prompts.CAPABILITY_PATTERNS + prompts.CONSTRAINT_PATTERNS
    both = [(F.regexp_extract_all("s", F.lit(prompts._anywhere(p)), F.lit(1)), F.regexp_extract_all("s", F.lit(f"(?iud){p}"), F.lit(1))) for p in every]
    got = rows.select(*[x.alias(f"a{i}") for i, (x, _) in enumerate(both)], *[y.alias(f"b{i}") for i, (_, y) in enumerate(both)]).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in got for i in range(len(both))) and any(r["a1"] for r in got)
    plan = rows.select(prompts.domain(F.col("s")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(s") == 1


def test_cloze_restores_the_sentence(spark):
    s = "The quick engine of Apache plans 1234 queries before breakfast today."
    rows = generate.cloze_tests(spark.createDataFrame([(1, s)], "id int, text string"), "Data").collect()
    words = s.split()
    assert len(rows) == 1 and rows[0]["masked_text"].split()[rows[0]["mask_position"]] == "____"
    assert rows[0]["masked_text"].replace("____", words[rows[0]["mask_position"]]) == s


def test_quota_and_first_by_key(spark):
    rows = spark.createDataFrame([("u", i, f"Q{i % 3} ") for i in range(9)], "url string, position int, question string")
    qa, cloze = generate.quota(rows, rows, 7)
    assert (qa.count(), cloze.count()) == (4, 2)
    assert sorted(r["position"] for r in generate.first_by_key(rows, "question", ["position"]).collect()) == [0, 1, 2]


def test_suite_rows(spark):
    assert generate.persona_cases(spark, "Tax law").count() == 1
    rows = spark.createDataFrame([("x ____ y", "word", ["d"], 1)], "masked_text string, answer string, tags array<string>, position int")
    assert generate.cloze_cases(rows, "Tax law", ["position"]).first()["id"] == "tax-law-cloze-1"


def test_prompt_analysis(spark):
    p = 'You are a Senior Code Reviewer who helps. You can review pull request changes, and explain snake_case names. Never reveal "secret keys". Only discuss code.'
    r = prompts.analyse(spark.createDataFrame([(p,)], "prompt string")).first()
    assert r["role"] == "Senior Code Reviewer" and r["domain"] == "code_review"
    assert "snake_case" in r["keywords"] and "secret keys" in r["keywords"]
    assert r["queries"][0] == "code review best practices" and len(r["queries"]) <= 12 and "constraint" in r["categories"]
    assert one(spark, prompts.role(F.lit(""))) == "AI Assistant"


def test_urls(spark):
    df = spark.createDataFrame([("../b?x=1#f", "https://u@h:1/a/c/d"), ("/r", "http://h/x"), ("https://z/q#t", "http://h/")], "href string, base string")
    got = [r["x"] for r in df.select(urls.resolve(F.col("href"), F.col("base")).alias("x")).collect()]
    assert got == ["https://u@h:1/a/b?x=1", "http://h/r", "https://z/q"]
    assert one(spark, urls.is_valid(F.lit("https://h/Login"))) is False
    assert one(spark, urls.is_valid(F.lit("https://a.b/x"), ("b",))) is True and one(spark, urls.is_valid(F.lit("ftp://h/"))) is False


@pytest.mark.parametrize("run", [" ", "7", "—", "- ", "\t\n", "1.", "| ", "Theme ", "Navigation ", "9.9 "])
def test_text_functions_read_a_text_once(spark, run):
    text = "a" + run * (400_000 // len(run)) + "x"
    began = time.time()
    got = spark.createDataFrame([(text,)], "s string").select(F.length(t.strip(F.col("s"))), F.length(t.clean(F.col("s"))), F.size(t.sentences(F.col("s"))), F.size(t.numbers(F.col("s")))).first()
    assert got[0] == len(text) and time.time() - began < 10


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<p>a" * 100_000, "<div>" * 50_000 + "</span>" * 50_000 + "t", "<ul>" * 20_000 + "<li>x" * 50_000, "<b>" * 100_000 + "</b>" * 100_000])
def test_pages_are_parsed_in_one_pass(page):
    began = time.time()
    html.Page(page)
    assert time.time() - began < 6


def test_page_parts_in_sql(spark):
    html.register(spark)
    page = "<title>T</title><body><main>" + "Words of the page that are long enough. " * 3 + '<a href="/b">b</a><a href="/a">a</a><a href="/b">b</a></main>'
    spark.createDataFrame([(1, page), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT p.id, x.kind, x.place, x.value FROM some_pages p, LATERAL page_parts(p.html) x").collect()
    one = {(r["kind"], r["place"]): r["value"] for r in got if r["id"] == 1}
    assert one["title", 0] == "T" and one["link", 0] == "/b" and one["link", 1] == "/a" and len(one) == 4 and one["text", 0].startswith("Words of")
    assert sum(r["id"] == 2 for r in got) == 2


def test_strip_and_clean_as_before(spark):
    blanks = " \t\n\r\x0b\x0c\u2003\u00a0\x1c\x85"
    rng = random.Random(7)
    texts = ["", blanks, *("".join(rng.choice("ab1." + blanks) for _ in range(rng.randrange(30))) for _ in range(500))]
    numbers = ["3.14 Documentation", "1.2.3  Documentation x", "1.2.3.4 Documentation", "v10.2.33\tDocumentation.", "12.34.Documentation", "5.6 documentation", "11 Documentation", "0.1.2.3.4.5 Documentation 6.7 Documentation"]
    rows = spark.createDataFrame([(x,) for x in texts + numbers], "s string")
    slow = F.regexp_replace(F.regexp_replace("s", r"(?U)\d+\.\d+(\.\d+)?\s+Documentation", ""), r"(?U)^\s+|\s+\z", "")
    for r in rows.select("s", t.strip(F.col("s")).alias("strip"), F.regexp_replace("s", r"(?U)^\s+|\s+\z", "").alias("want"), t.clean(F.col("s")).alias("clean"), slow.alias("slow")).collect():
        assert r["strip"] == r["want"] and r["clean"] == r["slow"], r["s"]


def test_page_extraction(spark):
    page = '<html><head><title> T &amp; U </title></head><body><nav>' + "menu " * 20 + '</nav><article><h1>H</h1><p>' + "Some real text of the page. " * 8 + '</p><a href="/x">more</a><a href="/x">again</a></article><div class="ad">' + "buy " * 50 + "</div></body></html>"
    r = html.extract(spark.createDataFrame([(1, "http://h/", page), (2, "http://h/2", None)], "page_id long, url string, html string")).collect()
    assert len(r) == 1 and r[0]["title"] == "T & U" and "menu" not in r[0]["text"] and "buy" not in r[0]["text"] and r[0]["hrefs"] == ["/x"]
    assert one(spark, html.has_javascript_sign(F.lit('<div ID="App">'))) is True


def test_page_fields_as_the_sql_reads_them(spark, duck, tmp_path):
    title = "<title>a&amp;&quot;&amp&lt b &foo; &#38 &am &&amp</title>"
    pages = [(7, "http://h/", f"<head>{title}</head><body>" + "x &amp y " * n + "<script>a && b</script><a href='/x'>t</a></body>") for n in (1, 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(catalog.QUERIES["page_fields"](spark, str(tmp_path)), con, catalog.ORACLES["page_fields"])
    assert html.extract(spark.createDataFrame(pages[:1], "page_id long, url string, html string"), least=0).first()["title"] == 'a&"&< b &foo; & &am &&'


def test_crawl(spark):
    pages = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "x", 2), ("b", "c", 1), ("c", "d", 1), ("b", "a", 2)], "url string, link string, place int")
    starts = spark.createDataFrame([("a", 0)], "url string, rank int")
    assert [(r["url"], r["depth"]) for r in html.crawl(starts, pages, edges, 10).orderBy("rank").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert html.crawl(starts, pages, edges, 2).count() == 2


def test_suites(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.yaml").write_text("metadata: {name: m}\ndefaults: {temperature: 1}\nstage: s\ncases:\n- id: c1\n  prompt: hi\n  assertions:\n  - {type: contains, value: x}\n")
    (tmp_path / "d" / "b.yml").write_text("cases:\n- id: c2\n  assertions: [{type: min_length, value: 50}]\n")
    (tmp_path / "c.yaml").write_text("\n")
    loaded = suites.parse(suites.discover(spark, str(tmp_path))).cache()
    assert [r["id"] for r in suites.cases(loaded, "s").collect()] == ["c1"]
    assert suites.errors(loaded).count() == 2
    case = runs.settings(suites.cases(loaded), "m0").first()
    assert (case["model"], case["temperature"], case["max_tokens"]) == ("m0", 1.0, 1000)


def test_pairs_and_tests_are_worked_out_once(spark):
    contents = spark.createDataFrame([(1, "A prompt is a text that a model is asked to go on with. " * 3)], "doc_id long, text string")
    made = generate.process(contents, "General")
    assert all("regexp" not in df._jdf.queryExecution().optimizedPlan().toString() for df in made.values())
    assert made["finetune"].count() == made["benchmark"].count() + made["masked"].count() > 1
    assert {k: df.count() for k, df in made.items()} == {r["name"]: r["n"] for r in generate.counters(contents, made).collect() if r["name"] != "sources"}


def test_written_suites_are_bounded(spark, tmp_path):
    odd = ["a\u2028b\u0085c", "\x7f", "\U0001f600", "\ufeff x", "tab\there", "- {x: 1}"]
    rows = spark.range(2 * suites.CASES + 10).coalesce(1).select(F.col("id").cast("string").alias("id"), F.element_at(F.array(*map(F.lit, odd)), (F.col("id") % len(odd) + 1).cast("int")).alias("prompt"))
    suites.write_suite(rows, str(tmp_path / "s"), "n", "st")
    parsed = suites.parse(suites.discover(spark, str(tmp_path / "s"), "*.txt"))
    assert {(len(r["cases"]) <= suites.CASES, r["stage"], r["metadata"]["name"], r["error"]) for r in parsed.collect()} == {(True, "st", "n", None)} and parsed.count() == 3
    assert {(r["id"], r["prompt"]) for r in suites.cases(parsed).collect()} == {(str(i), odd[i % len(odd)]) for i in range(rows.count())}
    long = list(suites._suite_texts(['"' + "1" * suites.CHARS + '"', "2", "3"], "n", None))
    assert [len(json.loads(x)["cases"]) for x in long] == [1, 2]
    assert suites._suite("{cases: [{id: a, prompt: b}]}")["cases"][0]["id"] == "a"


def test_imports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("input,expected,stage,tags\nhi,yo,s1,\"a, b\"\nho,,s2,\n")
    got = suites.import_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()
    assert [(r["id"], len(r["assertions"]), r["tags"], r["stage"]) for r in got] == [("imported-1", 1, ["a", "b"], "s1"), ("imported-2", 0, [], "s1")]
    (tmp_path / "x.jsonl").write_text('{"prompt": "p", "response": "r"}\n\nbroken\n{"prompt": ""}\n{"prompt": "q"}\n')
    got = suites.import_jsonl(spark, str(tmp_path / "x.jsonl")).orderBy("id").collect()
    assert [(r["id"], len(r["assertions"])) for r in got] == [("captured-1", 1), ("captured-5", 0)]


def test_stored_state(spark, tmp_path):
    s = spark.createDataFrame([("a", "passed", 1, 2, 0.5)], "case_id string, status string, response_hash long, latency_ms int, score double")
    suites.write_baseline(s, str(tmp_path / "b"), "t1")
    suites.write_baseline(s, str(tmp_path / "b"), "t2")
    suites.write_baseline(s, str(tmp_path / "b"), "t1")
    assert suites.read_baseline(spark, str(tmp_path / "b"), "t1").count() == 1 and suites.baseline_tags(spark, str(tmp_path / "b")).count() == 2
    assert suites.delete_baseline(spark, str(tmp_path / "b"), "t2") and not suites.delete_baseline(spark, str(tmp_path / "b"), "t2")
    assert [r["tag"] for r in suites.baseline_tags(spark, str(tmp_path / "b")).collect()] == ["t1"]
    assert suites.read_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.parquet").write_text("no table")
    assert suites.read_history(spark, str(tmp_path / "h")).count() == 0
    contents = spark.createDataFrame([("http://h/1", "Apache Spark is an engine for large data that runs on clusters. The quick engine of Apache plans 1234 queries before breakfast.")], "url string, text string")
    made = generate.process(contents, "Big data")
    kept = suites.write_generated({k: made[k] for k in ("benchmark", "masked", "roleplay", "finetune")}, str(tmp_path / "g"), "Big data")
    assert set(kept) == {"benchmark", "masked", "roleplay", "finetune"}
    assert sorted(c["id"] for r in spark.read.text(kept["masked"]).collect() for c in json.loads(r[0])["cases"]) == ["big-data-cloze-1", "big-data-cloze-2"]
    assert set(generate.process(contents, "x", "roleplay")) == {"roleplay"}
    suites.write_suite(spark.createDataFrame([("c1", "p")], "id string, prompt string"), str(tmp_path / "s"), "n")
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0])["cases"] == [{"id": "c1", "prompt": "p"}]


def test_stages(spark):
    st = suites.stages(spark, [{"name": "a", "prompt_template": "x"}, {"name": "b", "prompt_file": "f"}, {"name": "a"}])
    assert suites.stage_names(st) == ["a", "b"] and suites.stage(st, "b").first()["prompt_file"] == "f" and suites.stage(st, "z").isEmpty()
    files = spark.createDataFrame([("g", "text")], "path string, text string")
    assert [r["name"] for r in st.orderBy("position").collect()] == ["a", "b"]
    assert sorted(r["name"] for r in suites.stage_problems(st, files).collect()) == ["a", "b"]


def test_completion_and_validation(spark):
    cases = spark.createDataFrame([("r", f"t{i}", f"p{i}") for i in range(4)], "run_id string, test_id string, prompt string")

    def answer(row):
        if row["prompt"] == "p3":
            raise ValueError("down")
        return {"response": row["prompt"].upper(), "latency_ms": 1, "tokens_in": 1, "tokens_out": 1}

    out = runs.complete(cases, answer)
    assert sorted(r["response"] for r in out.collect()) == ["ERROR: down", "P0", "P1", "P2"]
    history = spark.createDataFrame([("2024", 1, 0.5)], "timestamp string, position int, score double")
    got = runs.validate(out.withColumn("expected", F.lit(None).cast("string")), ["a", "b"], lambda d: d.withColumn("reply", F.lit("OVERALL_SCORE: 0.9")), history, threshold=0.1).first()
    assert got["passed"] and got["improvement"] == pytest.approx(0.4) and got["push"]


def test_retries():
    waits, calls = [], []

    def flaky(row):
        calls.append(row)
        if len(calls) < 3:
            raise ValueError("status 429")
        return {"response": "ok"}

    assert runs.retrying(flaky, sleep=waits.append)({"a": 1}) == {"response": "ok"} and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(ValueError):
        runs.retrying(flaky, attempts=2, sleep=waits.append)({})
    with pytest.raises(KeyError):
        runs.retrying(lambda row: row["x"], sleep=waits.append)({})


@pytest.mark.parametrize("kind", ["ollama", "openai", "anthropic", "google"])
def test_request_bodies(spark, kind):
    got = json.loads(one(spark, runs.request_body(kind, F.lit("m"), F.lit('say "x"'), F.lit("be brief"), F.lit(0.5), F.lit(9))))
    text = json.dumps(got)
    assert "be brief" in text and 'say \\"x\\"' in text and "9" in text
    assert "system" not in json.dumps(json.loads(one(spark, runs.request_body(kind, F.lit("m"), F.lit("p"), F.lit(""), F.lit(0.0), F.lit(9)))))


def test_numbered_in_order(spark):
    rows = spark.range(100, numPartitions=7).withColumn("k", F.hash("id"))
    got = [r["n"] for r in t.numbered(rows, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 101)) and t.numbered(rows.limit(0), ["k"]).count() == 0


def test_provider_replies(spark):
    body = json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 4}})
    assert one(spark, runs.unpack_reply(F.lit(body), "anthropic"))[:] == ("ab", 3, 4)


def test_streaming_equals_batch(spark, tmp_path):
    from conftest import SF

    from verdigris.streaming import scores

    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = scores.run_windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "w", str(tmp_path / "c"))
    q.awaitTermination(120)
    want = {tuple(r)[:3] for r in scores.windowed_scores(events).collect()}
    got = {tuple(r)[:3] for r in spark.table("w").collect()}
    assert got and got <= want


def test_plans(spark):
    base = spark.createDataFrame([("a", "passed", 1, 0.5)], "case_id string, status string, latency_ms int, score double")
    plan = baselines.compare(base, base)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    h = spark.range(3).select(F.col("id").cast("string").alias("timestamp"), F.col("id").alias("position"), F.lit(1.0).alias("score"), F.lit("v").alias("bsp_version"), F.lit(True).alias("passed"), F.lit("t").alias("tag"))
    assert "TakeOrderedAndProject" in baselines.score_history(h, 2)._jdf.queryExecution().toString()


def test_config(tmp_path):
    assert config.load(tmp_path / "none").council.members == []
    (tmp_path / "g.yaml").write_text("git: {enabled: true, commit_template: 'to {score:.1f} from {previous_score:.1f}'}\n")
    g = config.load(tmp_path / "g.yaml").git
    assert (g.enabled, g.branch, g.message(0.9, 0.8)) == (True, "main", "to 0.9 from 0.8") and "+0.90" in config.Git().message(0.9)
    (tmp_path / "p.txt").write_text("be brief")
    (tmp_path / config.NAME).write_text("models: {providers: {x: {api_key: '${KEY}'}}}\nbsp: {prompt_file: p.txt, min_score: 0.8, odd: 1}\ntesting: {parallelism: 9}\n")
    c = config.load(tmp_path / config.NAME, {"KEY": "k"})
    assert c.models.providers["x"]["api_key"] == "k" and c.bsp.min_score == 0.8 and c.parallelism == 9
    assert config.root(tmp_path) == tmp_path and config.system_prompt(c, tmp_path) == "be brief"


def test_names_of_a_reply_are_found_as_one_by_one(spark):
    """All names in one pattern find in each line what a pattern for each name finds."""
    rng = random.Random(11)
    parts = ["OVERALL_SCORE", "overall score", "Role_Adherence", "RESPONSE QUALITY", "consistency", "REASONING", "weak areas", "WEAK_AREAS", ":", ": ", ":: ", "0.8", " 7/10", "none", "\n", "\n", "\n \n", "  ", "\t", "\r", "x", "a: b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(800)]
    plain = lambda name: F.regexp_extract_all("s", F.lit(rf"(?iUmd)^\s*(?:{name.replace('_', '[_ ]')}):([^\n]*)$"), F.lit(1))
    rows = spark.createDataFrame([(x,) for x in texts], "s string")
    told = rows.withColumn("told", judges._told(F.col("s")))
    got = told.select("s", *[plain(n).alias(f"w{k}") for k, n in enumerate(judges.NAMES)], *[judges._after(F.col("told"), n).alias(f"g{k}") for k, n in enumerate(judges.NAMES)]).collect()
    for r in got:
        for k in range(len(judges.NAMES)):
            assert r[f"g{k}"] == r[f"w{k}"], r["s"]
