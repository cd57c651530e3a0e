"""Substring dedup by hashing of paragraphs, lines or sentences.

A text is cut into units: ``paragraph`` (lines up to a blank one), ``line``, or ``sentence`` (lines that are cut at a
blank after ``.!?`` and at a unit separator, U+001F, as well, so that of a passage pasted into a running line all but
its edges are units).  Several, as
``line+sentence``, are cut side by side: a line may repeat as a whole, or a sentence of it, and a sentence of one text
may be a line of another.  Units are
normalised (lower case, single blanks) and digested (128 bits).  Digests are grouped over the whole corpus; the
occurrence that ranks first by (doc_id, text, offset) is kept, and every other one is removed together with the one
character that parts it from the next unit.  Units under ``min_words`` words take no part; by default all do.

Defined results: null or empty texts and those without words have no units and stay as they are; rows without doc_id
take no part and stay whole; rows with the same doc_id and text count as one document and are all cut alike; texts
that share a doc_id are documents of their own; of equal units of one text the first stays; very long texts are read
whole; an empty table gives an empty result; other columns of the input, of any names, are kept (``kept`` is replaced).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import small
from .tables import cut, free, in_arrow, table

#: Words that a unit of the query has at least: shorter sentences recur by nature.
MIN_WORDS = 15
SENTENCE = re.compile(r"[\n\x1f]|(?<=[.!?])[ \t\x0b\x0c\r]")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    """Lower case letter by letter, as in SQL: a sigma is the same wherever it stands, and a dotted I is an i."""
    return text.replace("Σ", "σ").replace("İ", "i").lower()


def pieces(text: str, unit: str) -> Iterator[str]:
    """Parts that make up the text again with one character between each two."""
    if unit == "sentence":
        yield from SENTENCE.split(text)
    elif unit == "line":
        yield from text.split("\n")
    elif unit == "paragraph":
        held: list[str] = []
        for line in text.split("\n"):
            if line.strip(BLANKS):
                held.append(line)
                continue
            if held:
                yield "\n".join(held)
            held = []
            yield line
        if held:
            yield "\n".join(held)
    else:
        raise ValueError(f"unknown unit: {unit}")


def units_of(text: str, unit: str = "line", min_words: int = 1) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, length, words, digest) of each unit that has enough words; offsets are in code points of the text."""
    seen: set[tuple[int, int]] = set()
    kinds = unit.split("+")
    for kind in kinds:
        at = 0
        for piece in pieces(text, kind):
            words = lower(piece).encode("utf-8", "surrogatepass").split()
            if words and len(words) >= min_words and (at, len(piece)) not in seen:
                yield at, len(piece), len(words), hashlib.md5(b" ".join(words)).digest()
                if len(kinds) > 1:
                    seen.add((at, len(piece)))
            at += len(piece) + 1


UNITS = "doc_id long, version long, start int, length int, n_words int, d1 long, d2 long"


def _units(unit: str, min_words: int):
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in UNITS.split(", ")]
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in small(batches):
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, length, n, d in units_of(text, unit, min_words):
                    rows.append((doc_id, version, start, length, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _version(text: Column) -> Column:
    return F.xxhash64(text)


def _ranked(units: DataFrame, src: DataFrame) -> DataFrame:
    """The units with ``rank``, which orders the texts of a doc_id; null where a doc_id has one text, as most do.  Texts of
    other doc_ids are sorted among all tasks, so that many under one doc_id do not meet in one."""
    many = cut(units.groupBy("doc_id").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low <> high").select("doc_id"))
    if many.isEmpty():
        return units.withColumn("rank", F.lit(None).cast("long"))
    texts = src.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id", "version"]).orderBy("doc_id", "text")
    ranks = cut(texts.select("doc_id", "version", F.monotonically_increasing_id().alias("rank")))
    return units.join(ranks, ["doc_id", "version"], "left")


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """(doc_id, version, cuts) of every document that has later occurrences; ``cuts``: (start, length, n_words,
    first_doc_id, first_start) by start.

    Units are computed and written once.  The first occurrence is a minimum for each digest, combined before the
    shuffle; the join back to the occurrences deals both sides out anew, so that adaptive execution can split a digest
    which many documents share.  What is collected belongs to one document.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version(F.col("text")).alias("version"), "text").where("doc_id is not null and text is not null")
    units = cut(src.mapInArrow(_units(unit, min_words), UNITS))
    first = _ranked(units, src).groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "rank", "start", "version")).alias("k"), F.count("*").alias("c")).where("c > 1")
    fresh = first.select((F.col("d1") + F.lit(0).cast("long")).alias("d1"), "d2", "k")
    later = units.join(fresh, ["d1", "d2"]).where("doc_id <> k.doc_id or version <> k.version or start <> k.start")
    span = F.struct("start", "length", "n_words", F.col("k.doc_id").alias("first_doc_id"), F.col("k.start").alias("first_start"))
    return cut(later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(span)).alias("cuts")))


def removed(docs: DataFrame, found: DataFrame, how: str = "left", told: str | None = None) -> DataFrame:
    """The documents with the cuts taken out of ``text``; ``kept`` has (start, length) of what stays, in the original,
    and a column named ``told`` those of the cuts.  ``how``: ``left`` for all documents, ``inner`` for those that lose something.  Cuts grow with the documents and meet
    them in a shuffle join, whose sides adaptive execution may split."""
    docs = docs.drop("kept")  # a column of that name is replaced
    kept_type = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("length", T.IntegerType()))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", kept_type), *([T.StructField(told, kept_type)] if told else [])])
    at, width = docs.columns.index("text"), len(docs.columns)
    key, cuts = (free(docs.columns, c) for c in ("key", "cuts"))
    side = found.select(F.struct("doc_id", "version").alias(key), F.col("cuts").alias(cuts))
    mine = F.struct(docs["doc_id"].cast("long").alias("doc_id"), _version(docs["text"]).alias("version"))
    joined = docs.join(side, mine == F.col(key), how)
    joined = joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.transform(cuts, lambda x: F.struct(x["start"], x["length"])).alias(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, kept = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                stay, end = [], 0
                for c in gone or ():
                    start, length = c.values()
                    if start > end:
                        stay.append({"start": end, "length": start - end})
                    end = max(end, min(len(text), start + length + 1))
                if text and end < len(text):
                    stay.append({"start": end, "length": len(text) - end})
                texts.append(None if text is None else "".join(text[s["start"] : s["start"] + s["length"]] for s in stay))
                kept.append(None if text is None else stay)
            cols = [batch.column(i) for i in range(width)]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            more = [batch.column(width).cast(kind)] if told else []
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, kind), *more], names=[f.name for f in schema])

    return in_arrow(joined, run, schema)


def substring_dedup(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """All documents, without the later occurrences of their units, and ``kept``."""
    return removed(docs, repeats(docs, unit, min_words))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["length"].cast("string"))), " ")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses a repeated line, or sentence of a line, of ``MIN_WORDS`` words or more: the digest of
    what is left of its text, and the kept and removed spans (``start+length``, in code points of the original) in
    order; a removed sentence may lie in a removed line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = removed(docs, repeats(docs, "line+sentence", MIN_WORDS), "inner", "cuts")
    return left.select("doc_id", F.md5("text").alias("text_md5"), _told(F.col("kept")).alias("kept"), F.size("cuts").cast("long").alias("n_removed"), _told(F.col("cuts")).alias("removed"))


_B = "[ \\t\\x0b\\x0c\\r]"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
s AS (SELECT rid, doc_id, 1 AS kind, string_split(regexp_replace(replace(text, chr(10), chr(31)), '([.!?]){_B}', '\\1' || chr(31), 'g'), chr(31)) AS p FROM d UNION ALL SELECT rid, doc_id, 2, string_split(text, chr(10)) FROM d),
u0 AS (SELECT rid, doc_id, kind, unnest(p) AS part, unnest(range(len(p))) AS unit FROM s),
u1 AS (SELECT rid, doc_id, part, (sum(length(part) + 1) OVER (PARTITION BY rid, kind ORDER BY unit) - length(part) - 1)::INT AS start FROM u0),
u2 AS (SELECT DISTINCT rid, doc_id, start, length(part)::INT AS size, trim(regexp_replace(lower(part), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS n FROM u1),
u AS (SELECT * FROM u2 WHERE n <> '' AND len(string_split(n, ' ')) >= {MIN_WORDS} QUALIFY row_number() OVER (PARTITION BY n ORDER BY doc_id, rid, start) > 1),
g AS (SELECT rid, count(*) AS n_removed, string_agg(start || '+' || size, ' ' ORDER BY start, size) AS removed FROM u GROUP BY rid),
b AS (SELECT rid, start AS here, least(length(text), start + size + 1) AS next FROM u JOIN d USING (rid) UNION ALL SELECT rid, length(text), length(text) FROM d SEMI JOIN g USING (rid)),
k AS (SELECT rid, coalesce(max(next) OVER (PARTITION BY rid ORDER BY here, next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, here FROM b),
h AS (SELECT rid, string_agg(k.start || '+' || (here - k.start), ' ' ORDER BY k.start) AS kept, string_agg(substr(text, k.start + 1, here - k.start), '' ORDER BY k.start) AS rest FROM k JOIN d USING (rid) WHERE here > k.start GROUP BY rid),
c AS (SELECT doc_id, text, count(*) AS copies FROM documents GROUP BY ALL)
SELECT d.doc_id, g.n_removed, g.removed, coalesce(h.kept, '') AS kept, md5(coalesce(h.rest, '')) AS text_md5 FROM g JOIN d USING (rid) LEFT JOIN h USING (rid) JOIN c ON c.doc_id = d.doc_id AND c.text = d.text, unnest(range(copies))"""
