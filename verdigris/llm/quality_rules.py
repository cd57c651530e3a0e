"""Quality rules: a hashed n-gram log-likelihood ratio with deterministic thresholds.

Two multinomials over ``BUCKETS`` hashed word uni- and bigrams are counted over whole texts: the raw corpus (every
document) and a trusted target (documents whose id is among the target ids).  A document's score is the mean log ratio
target : raw of its n-grams, so it does not grow with length.  A document is kept if the base rules hold and its
score is at least ``threshold``.

Defined results: a null text counts as empty (no words: base rules fail, score 0); texts of any length are read
whole; repeated rows are counted and returned as often as they occur; without target documents every score is 0;
an empty table gives an empty result; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import BASE, chunks, small, sum_by, Words
from .tables import few, in_arrow, table

BUCKETS = 1 << 16
#: Multipliers of a word's hash, and of the two words of a bigram; the bucket is the product's top 16 bits.
K1, K2, K3 = 0x1B873593CC9E2D51, 0x27220A9585EBCA6B, 0x165667B19E3779F9
ALPHA = 1.0
THRESHOLD = -0.18
SYMBOLS = np.array(sorted(map(ord, "#*$%&|<>")), np.uint32)
_SHIFT = np.uint64(48)


def ngram_buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every unigram and bigram."""
    uni = (w.hash * np.uint64(K1)) >> _SHIFT
    same = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    bi = (w.hash[same] * np.uint64(K2) + w.hash[same + 1] * np.uint64(K3)) >> _SHIFT
    return np.concatenate([uni, bi]).astype(np.int64), np.concatenate([w.doc, w.doc[same]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in small(batches):
        texts = [t or "" for t in batch.column(0).to_pylist()]
        trusted = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
        for lo, hi in chunks(texts):
            bucket, doc = ngram_buckets(Words(texts[lo:hi]))
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[lo:hi][doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Log ratio of each bucket.  The driver receives at most ``BUCKETS`` rows whatever the input; target ids are sent
    to the executors if they are few, and meet the documents in a shuffle join otherwise."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_id")).where("_id is not null").distinct()
    joined = docs.select("doc_id", "text").join(few(ids).withColumn("_trusted", F.lit(True)), F.col("doc_id") == F.col("_id"), "left")
    parts = joined.select("text", "_trusted").mapInArrow(_counts, "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column(0).to_numpy()
    raw[at], target[at] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def repeated_words(w: Words) -> np.ndarray:
    """For each text, words that lie in a 3-word window found twice or more in it."""
    gram, at = w.grams(3)
    key = gram ^ (w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    mark = np.zeros(len(w.hash), bool)
    hit = at[count[inverse] > 1]
    for k in range(3):
        mark[hit + k] = True
    return sum_by(w.doc[mark], None, w.n_docs)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def _measures(texts: list[str], ratio: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` after doc_id."""
    cols: list[list[np.ndarray]] = [[] for _ in range(8)]
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        n = w.count
        chars = sum_by(w.doc, (w.end - w.start).astype(float), w.n_docs).astype(np.int64)
        symbol = np.concatenate([[0], np.cumsum(np.isin(w.cp, SYMBOLS))])
        symbols = np.diff(symbol[w.doc_start])
        dup = np.array([duplicate_lines(t) for t in texts[lo:hi]], np.int64)
        repeat = repeated_words(w).astype(np.int64)
        bucket, doc = ngram_buckets(w)
        total = sum_by(doc, None, w.n_docs)
        llr = sum_by(doc, ratio[bucket], w.n_docs) / np.maximum(total, 1)
        failed = (n < 50) | (100 * repeat > 50 * n)
        for c, x in zip(cols, (n, chars, symbols, dup, repeat, failed, llr, ~failed & (llr >= threshold)), strict=True):
            c.append(x)
    return [np.concatenate(c) for c in cols]


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict of every document.  ``ratio``: ``BUCKETS`` doubles (512 kB), sent to executors."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, _measures(texts, shared.value, threshold))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(_measures([t or "" for t in batch.column(at).to_pylist()], shared.value, threshold)[-1]))

    return in_arrow(docs, run, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of good quality and without toxicity."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, trusted_ids(labels)), threshold)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def oracle(threshold: float = THRESHOLD) -> str:
    m = "18446744073709551616::HUGEINT"
    ws = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT rid, doc_id, text, regexp_extract_all(text, {ws}) AS w FROM d),
pos AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM ws),
vocab AS (SELECT word, list_reduce(list_prepend(0::HUGEINT, list_transform(list_reverse(string_split(word, '')), lambda c: unicode(c)::HUGEINT + 1)),
    lambda h, c: (h * {BASE}::HUGEINT + c) % {m}) AS h FROM (SELECT DISTINCT word FROM pos)),
hp AS (SELECT rid, doc_id, i, h, lead(h) OVER o AS h2, word AS w1, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pos JOIN vocab USING (word) WINDOW o AS (PARTITION BY rid ORDER BY i)),
grams AS (SELECT rid, doc_id, ((h * {K1}::HUGEINT) % {m} // 281474976710656)::BIGINT AS b FROM hp
  UNION ALL SELECT rid, doc_id, (((h * {K2}::HUGEINT) % {m} + (h2 * {K3}::HUGEINT) % {m}) % {m} // 281474976710656)::BIGINT FROM hp WHERE h2 IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
cnt AS (SELECT b, count(*) AS r, count(*) FILTER (g.doc_id IS NOT NULL) AS t FROM grams LEFT JOIN good g USING (doc_id) GROUP BY b),
tot AS (SELECT sum(r) AS r, sum(t) AS t FROM cnt),
llr AS (SELECT b, CASE WHEN tot.t = 0 THEN 0 ELSE ln((cnt.t + {ALPHA}) / (tot.t + {ALPHA * BUCKETS})) - ln((cnt.r + {ALPHA}) / (tot.r + {ALPHA * BUCKETS})) END AS v FROM cnt, tot),
sc AS (SELECT rid, avg(v) AS score FROM grams JOIN llr USING (b) GROUP BY rid),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS c FROM hp WHERE w3 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) AS ks(k) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {ws}) GROUP BY rid),
base AS (SELECT ws.rid, ws.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM ws LEFT JOIN ln ON ln.rid = ws.rid LEFT JOIN rep ON rep.rid = ws.rid),
v AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(score, 0) AS score FROM base LEFT JOIN sc ON sc.rid = base.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {threshold} AS kept FROM v"""
