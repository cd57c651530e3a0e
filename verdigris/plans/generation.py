"""From system prompts to suites: searches, pages, questions and cloze tests, for all prompts in one run.

Where prompts are worked on one after another, each takes its searches in turn, leaves out hosts that it has read from,
crawls what is left, and stops at its number of pages.  Here a round takes the next search of every prompt that still
needs pages, so there are as many rounds as a prompt has searches, whatever the number of prompts.  Questions and tests
are made of each page once, however many prompts read it, and dealt to the prompts by a join.

Windows by prompt hold the pages of a prompt and what is made of them: ``max_pages`` pages of some forty rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..operators import generate, html, prompts
from ..sources.store import keep

PRIORITY = ("serp", "brave", "duck")
#: Results of a search that are looked at beyond those that are read, pages below which the fallback is read, and its addresses.
SPARE, FEW, FALLBACK = 2, 3, 5


def sources(analysed: DataFrame, results: DataFrame, pages: DataFrame, edges: DataFrame, max_pages: int = 20, depth: int = 2, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """The pages that each prompt reads: (prompt_id, search, rank, url), search from 0; the fallback comes last.

    ``analysed``: (prompt_id, domain, queries); ``results``: (query, provider, rank, url); ``pages``: (url), those that can
    be read; ``edges``: (url, link, place).  Of each search the first provider with a valid result counts."""
    per_query = F.greatest(F.lit(2), F.floor(F.lit(max_pages) / F.greatest(F.size("queries"), F.lit(1)))).cast("int")
    heads = keep(analysed.select("prompt_id", "domain", "queries", per_query.alias("most")))
    picked = html.pick_provider(results, list(priority), max_pages + SPARE)
    picked = keep(picked.select("query", "url", F.row_number().over(Window.partitionBy("query").orderBy("rank", "url")).alias("rank")).withColumn("host", urls.authority(F.col("url"))))
    rounds = heads.agg(F.max(F.size("queries"))).first()[0] or 0
    out = None
    for k in range(rounds):
        now = heads.where(F.size("queries") > k).select("prompt_id", "most", F.get("queries", F.lit(k)).alias("query"))
        if out is not None:
            done = out.groupBy("prompt_id").agg(F.count("*").alias("had")).where(F.col("had") >= max_pages)
            now = now.join(done.select("prompt_id"), "prompt_id", "left_anti")
        offered = now.join(picked, "query").where(F.col("rank") <= F.col("most") + SPARE)
        if out is not None:
            read = out.select("prompt_id", urls.authority(F.col("url")).alias("host")).distinct()
            offered = offered.join(read, ["prompt_id", "host"], "left_anti")
        place = F.row_number().over(Window.partitionBy("prompt_id").orderBy("rank", "url"))
        starts = keep(offered.withColumn("n", place).where("n <= most").select("prompt_id", "url", "rank", "most"))
        if starts.isEmpty():
            continue
        found = html.crawl(starts, pages, edges, "most", depth, by=("prompt_id",)).select("prompt_id", F.lit(k).alias("search"), "rank", "url")
        out = found if out is None else keep(out.unionByName(found))
    none = heads.select("prompt_id", F.lit(0).alias("search"), F.lit(0).alias("rank"), F.lit("").alias("url")).limit(0)
    out = none if out is None else out
    enough = out.groupBy("prompt_id").agg(F.count("*").alias("had")).where(F.col("had") >= FEW)
    scarce = heads.join(enough.select("prompt_id"), "prompt_id", "left_anti")
    starts = keep(scarce.select("prompt_id", F.posexplode(F.slice(prompts.fallback_urls(F.col("domain")), 1, FALLBACK)).alias("rank", "url")).withColumn("most", F.lit(max_pages)))
    if starts.isEmpty():
        return out
    last = html.crawl(starts, pages, edges, "most", depth, by=("prompt_id",)).select("prompt_id", F.lit(rounds).alias("search"), "rank", "url")
    return out.unionByName(last)


def _dealt(read: DataFrame, made: DataFrame, heads: DataFrame, key: str, most: int) -> DataFrame:
    """What was made of pages, for the prompts that read them: of equal keys the first, of those the first ``most``, numbered."""
    rows = read.join(made, "url").join(heads, "prompt_id")
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "prompt_id"]), F.struct("search", "rank", "position"))
    once = rows.groupBy("prompt_id", t.strip(F.lower(F.col(key))).alias("_key")).agg(first.alias("r")).select("prompt_id", "r.*")
    n = F.row_number().over(Window.partitionBy("prompt_id").orderBy("search", "rank", "position"))
    return once.withColumn("n", n).where(F.col("n") <= most)


def suites(analysed: DataFrame, read: DataFrame, contents: DataFrame, target: int = 50, kinds: str = "all", seed: int = 0) -> DataFrame:
    """One suite for each prompt: (prompt_id, position, id, prompt, expected, assertions, tags).

    ``read``: (prompt_id, search, rank, url) as ``sources`` gives it; ``contents``: (url, text).  Questions and cloze tests
    have the shares of ``generate.shares``, ids are numbered within the prompt, and the order follows from a hash of seed
    and id.  A prompt whose pages give nothing has no rows."""
    read = keep(read.groupBy("prompt_id", "url").agg(F.min(F.struct("search", "rank")).alias("at")).select("prompt_id", "url", "at.*"))
    heads = analysed.select("prompt_id", F.col("domain").alias("_domain"))
    used = contents.join(read.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("text").alias("text"))
    share_qa, share_cloze = generate.shares(target, kinds)
    slug, low = F.replace(F.lower("_domain"), F.lit(" "), F.lit("-")), F.lower("_domain")
    parts = []
    if share_qa:
        qa = _dealt(read, generate.qa_pairs(used, ""), heads, "question", share_qa)
        parts.append(qa.select("prompt_id", F.concat(slug, F.lit("-qa-"), "n").alias("id"), F.col("question").alias("prompt"), F.col("answer").alias("expected"), F.array(generate.answer_check(F.col("answer"))).alias("assertions"), F.concat(F.array(low), F.slice("tags", 2, 9)).alias("tags")))
    if share_cloze:
        cloze = _dealt(read, generate.cloze_tests(used, "", seed=seed), heads, "masked_text", share_cloze)
        parts.append(cloze.select("prompt_id", F.concat(slug, F.lit("-cloze-"), "n").alias("id"), generate.blank_prompt(F.col("masked_text")).alias("prompt"), F.col("answer").alias("expected"), F.array(generate.word_check(F.col("answer"))).alias("assertions"), F.concat(F.array(low), F.slice("tags", 2, 9)).alias("tags")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id"))), "id"))
    return every.withColumn("position", place).select("prompt_id", "position", "id", "prompt", "expected", "assertions", "tags")


def from_prompts(rows: DataFrame, results: DataFrame, contents: DataFrame, edges: DataFrame, target: int = 50, kinds: str = "all", max_pages: int = 20, seed: int = 0) -> DataFrame:
    """The whole way for system prompts (prompt_id, prompt): analysis, searches, pages and suites."""
    analysed = keep(prompts.analyse(rows).select("prompt_id", "domain", "queries"))
    return suites(analysed, sources(analysed, results, contents, edges, max_pages), contents, target, kinds, seed)
