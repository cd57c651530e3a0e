"""Words of a dictionary found in texts as substrings, whatever the number of words.

All words of a dictionary are one automaton, so a text is read once for each ``SLICE`` of words, not once for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prompts

#: Words of one automaton; a dictionary of more is taken in slices, each of which is one pass over the texts.
SLICE = 200_000
#: Distinct words that a batch of texts gives at most before they are handed on.
ROWS = 50_000
#: Texts that a worker holds as strings at a time.
TEXTS = 256


def found(texts: DataFrame, words: DataFrame, key: str, text: str = "text", slice_words: int | None = None) -> DataFrame:
    """(key, word, place): each word that is part of the text in any case, once for each row, with the first place (in
    characters, from 0) at which it ends.  ``words``: (word); empty and null words are in no text, null texts hold none.
    """
    slice_words = SLICE if slice_words is None else slice_words
    each = words.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    n = each.count()
    out = None
    for k in range(max(1, -(-n // slice_words))):
        slices = max(1, -(-n // slice_words))
        part = each.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k)
        listed = [r["word"] for r in part.collect()]  # about ``slice_words``, which bounds the automaton
        hits = _pass(texts, listed, key, text)
        out = hits if out is None else out.unionByName(hits)
    return out


def _scan(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """Of batches (key, text) the words found.  Texts are taken out of a batch ``TEXTS`` at a time, so that a worker holds
    a batch, these and ``ROWS`` words, however many rows a batch has."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    rows: list[tuple] = []
    for batch in batches:
        pack = lambda rows, kind=batch.schema.field(0).type: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (kind, pa.string(), pa.int64()), strict=True)], ["key", "word", "place"])
        for lo in range(0, batch.num_rows if words else 0, TEXTS):
            for k, t in zip(*(c.to_pylist() for c in batch.slice(lo, TEXTS).columns), strict=True):
                first: dict[str, int] = {}
                for end, word in automaton.iter(t) if t else ():
                    first.setdefault(word, end)
                rows += [(k, w, e) for w, e in first.items()]
                if len(rows) >= ROWS:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)
            rows = []


def _pass(texts: DataFrame, words: list[str], key: str, text: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(words)
    src = texts.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(lambda batches: _scan(batches, shared.value), f"key {kind}, word string, place long").withColumnRenamed("key", key)


def domain_words(spark) -> DataFrame:
    """(domain, place, word, weight): the keywords of all domains; a word weighs as many words as it has."""
    rows = [(name, k, w, len(w.split())) for k, (name, words) in enumerate(prompts.DOMAIN_KEYWORDS.items()) for w in words]
    return spark.createDataFrame(rows, "domain string, place int, word string, weight int")


def domains(texts: DataFrame, words: DataFrame, key: str, text: str = "prompt", none: str = "general") -> DataFrame:
    """(key, domain, score): the domain with the largest sum of weights of its words that the text holds; of equal ones
    that of the smaller place.  ``words``: (domain, place, word, weight), a word listed twice counting twice."""
    hits = found(texts, words, key, text).select(key, "word")
    listed = words.select("domain", "place", F.lower("word").alias("word"), "weight")
    scores = hits.join(listed, "word").groupBy(key, "domain").agg(F.sum("weight").alias("score"), F.min("place").alias("place"))
    best = scores.where("score > 0").groupBy(key).agg(F.max_by(F.struct("domain", "score"), F.struct("score", -F.col("place"))).alias("b")).select(F.col(key).alias("key_"), "b.*")
    return texts.select(key).join(best, F.col(key).eqNullSafe(F.col("key_")), "left").select(key, F.coalesce("domain", F.lit(none)).alias("domain"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
