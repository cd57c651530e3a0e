"""Line dedup by site-relative frequency.

Pages are grouped by host.  The share of a host's pages that contain a line (trimmed of blanks; a page counts once
however often it has the line) is compared with ``ratio``; lines above it, found on at least ``min_pages`` pages,
are boilerplate of that host and are dropped from its pages.  Other lines stay untouched, in order.  Pages of one
host with the same text count as one page, so that copies of a page do not make its lines boilerplate.

Defined results: a null text stays null (no lines); blank lines are never dropped; a null host is a host of its own;
repeated rows count once and are all returned; very long texts are read whole, a line at a time; a line exactly at the
ratio stays; an empty table gives an empty result; ``drop_lines`` returns all input columns, of any names, with the text
replaced (``n_lines`` and ``n_dropped`` of the input are replaced too).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import small
from .tables import free, in_arrow, named, table

RATIO = 0.05
MIN_PAGES = 3
#: Boilerplate lines (16-byte digests) sent to executors up to this many; beyond it a shuffle join does the same.
BROADCAST_LINES = 200_000
BLANKS = " \t\n\x0b\x0c\r"


def _site(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("-"))


def _lines(text: Column) -> Column:
    """Digests of a page's distinct lines that are not blank."""
    return F.transform(F.filter(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)))), lambda x: x != ""), lambda x: F.unhex(F.md5(x)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line digest) of every boilerplate line: counted over all distinct pages of a host, combined before each shuffle."""
    src = pages.select(_site(named(host)).alias("site"), named(text).alias("body"))
    src = src.groupBy("site", F.md5("body").alias("digest")).agg(F.first(_lines(F.col("body"))).alias("lines"))
    totals = src.groupBy("site").agg(F.count("*").alias("pages"))
    found = src.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    found = found.where(F.col("n") >= min_pages)
    return found.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("site", "line")


def drop_lines(pages: DataFrame, found: DataFrame, host: str = "source", text: str = "text", broadcast_lines: int = BROADCAST_LINES, counts: bool = True) -> DataFrame:
    """The pages without their host's boilerplate, with ``n_lines`` and ``n_dropped`` (long) appended if ``counts``.

    The lines of all hosts are sent to the executors if they are few.  Otherwise each page's own ones are joined to it
    by host and text, which are the same for copies of a page, so that the join needs no row numbers.
    """
    spark = pages.sparkSession
    extra = ["n_lines", "n_dropped"] if counts else []
    pages = pages.drop(*extra)  # columns of these names are replaced
    rows = found.limit(broadcast_lines + 1).toArrow()
    schema = T.StructType([*pages.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)])
    at, site_at = pages.columns.index(text), len(pages.columns)
    site, key = (free(pages.columns, c) for c in ("site", "key"))
    if rows.num_rows <= broadcast_lines:
        sites = defaultdict(set)
        for batch in rows.to_batches():
            for s, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sites[s].add(line)
        del rows
        shared = spark.sparkContext.broadcast(dict(sites))
        src = pages.select("*", _site(named(host)).alias(site))
    else:
        shared = None
        body = pages.select(_site(named(host)).alias("site"), named(text).alias("body")).where("body is not null")
        lines = body.groupBy("site", F.md5("body").alias("digest")).agg(F.first(_lines(F.col("body"))).alias("lines")).select("site", "digest", F.explode("lines").alias("line"))
        hits = lines.join(found, ["site", "line"], "left_semi").groupBy("site", "digest").agg(F.collect_set("line").alias("lines"))
        hits = hits.select(F.struct("site", "digest").alias(key), F.col("lines").alias(site))
        mine = F.struct(_site(named(host)).alias("site"), F.md5(named(text)).alias("digest"))
        src = pages.join(hits, mine == F.col(key), "left").select(*[pages[f"`{c}`"] for c in pages.columns], site)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, totals, drops = [], [], []
            for body, mine in zip(batch.column(at).to_pylist(), batch.column(site_at).to_pylist(), strict=True):
                bad = shared.value.get(mine, ()) if shared is not None else set(mine or ())
                lines = [] if body is None else body.split("\n")
                kept = [x for x in lines if not (y := x.strip(BLANKS)) or hashlib.md5(y.encode()).digest() not in bad] if bad else lines
                texts.append(None if body is None else "\n".join(kept))
                totals.append(len(lines))
                drops.append(len(lines) - len(kept))
            cols = [batch.column(i) for i in range(site_at)]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            cols += [pa.array(totals, pa.int64()), pa.array(drops, pa.int64())][: len(extra)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return in_arrow(src, run, schema)


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    return drop_lines(pages, boilerplate(pages, host, text, ratio, min_pages), host, text, counts=counts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, text, i, line, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t
  FROM (SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
n AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS pages FROM d GROUP BY source),
b AS (SELECT l.source, t FROM l JOIN n ON n.source IS NOT DISTINCT FROM l.source WHERE t <> '' GROUP BY l.source, t, pages HAVING count(DISTINCT l.text) >= {MIN_PAGES} AND count(DISTINCT l.text) > {RATIO} * pages),
k AS (SELECT l.*, b.t IS NOT NULL AS bad FROM l LEFT JOIN b ON b.source IS NOT DISTINCT FROM l.source AND b.t = l.t),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS text_md5 FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, text_md5 FROM d LEFT JOIN g USING (rid)"""
