"""Dictionaries in texts, and improvements as a stream."""

import random
import time

import pytest
from conftest import SF
from helpers import rows
from pyspark.sql import functions as F

from verdigris import catalog
from verdigris.operators import baselines, dictionary, prompts
from verdigris.streaming import improvements


@pytest.mark.parametrize("slice_words", [200_000, 7])
def test_words_as_substrings(spark, slice_words):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé ") for _ in range(r.randint(1, 4))) for _ in range(60)})
    texts = [(i, "".join(r.choice("ABÉabé c") for _ in range(r.randint(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (None, "ab")]
    df = spark.createDataFrame(texts, "k int, text string").withColumns({c: F.lit("x") for c in ("word", "place", "key")})
    listed = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0].upper(),)], "word string")
    got = sorted(((x["k"], x["word"], x["place"]) for x in dictionary.found(df, listed, "k", slice_words=slice_words).collect()), key=repr)
    want = [(k, w, t.lower().index(w) + len(w) - 1) for k, t in texts if t for w in words if w in t.lower()]
    assert got == sorted(want, key=repr)
    assert dictionary.found(df, listed.limit(0), "k").count() == dictionary.found(df.limit(0), listed, "k").count() == 0


def test_cost_does_not_follow_the_dictionary(spark):
    texts = spark.range(200).select("id", F.concat(F.lit("some words about item"), F.col("id").cast("string"), F.lit(" and more")).alias("text"))
    words = spark.range(100_000).select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("word"))
    began = time.time()
    hits = dictionary.found(texts, words, "id")
    assert hits.where("word = concat('item', id)").count() == 200 and time.time() - began < 30


def test_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(["law " + "x" * 2000] * 20_000)], ["key", "text"])
    tracemalloc.start()
    hits = sum(b.num_rows for b in dictionary._scan(iter([batch, batch]), ["law", "w x"]))
    assert hits == 80_000 and tracemalloc.get_traced_memory()[1] < 25e6 < batch.nbytes
    tracemalloc.stop()


def test_domains_as_by_expressions(spark):
    p = catalog.system_prompts(spark, str(SF))
    got = dictionary.domains(p, dictionary.domain_words(spark), "doc_id").select("doc_id", "domain")
    want = p.select("doc_id", prompts.domain(F.col("prompt")).alias("domain"))
    assert rows(got.toPandas()) == rows(want.toPandas())


def test_improvements_as_a_stream(spark, tmp_path):
    """Batches in order give what the batch operator gives; rows that come again or late give nothing."""
    history = catalog.history(spark, str(SF)).select("tag", "timestamp", "position", "score", "passed").cache()
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    cuts = ["2024-01-10", "2024-01-20", "2024-03-01"]
    before = ""
    for cut in [*cuts, "again"]:
        part = history.where(F.col("timestamp") < cuts[0]) if cut == "again" else history.where((F.col("timestamp") >= before) & (F.col("timestamp") < cut))
        part.coalesce(1).write.mode("append").parquet(source)
        before = cut
        stream = spark.readStream.schema(history.schema).parquet(source)
        improvements.run_improvements(stream, out, marks, 0.5).awaitTermination(120)
    got = spark.read.parquet(out).select("tag", "position", F.round("improvement", 6).alias("improvement"), "push")
    want = baselines.improvements(history, ["tag"], 0.5).select("tag", "position", F.round("improvement", 6).alias("improvement"), "push")
    assert rows(got.toPandas()) == rows(want.toPandas())
