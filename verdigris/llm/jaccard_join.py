"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct n-word shingles (64-bit hashes); two link if their Jaccard similarity reaches
``num / den``.  Similar sets x, y share at least l tokens among the first ``|x| - ceil(t |x|) + l`` of x and the
like of y, in any order common to all and for any l.

1. Documents with the same set form a class; its smallest id stands for it.
2. Prefixes in hash order, lengthened to l = a tenth of the document (``LEVELS`` at least): tokens that only one
   document has there are dropped, and a document stays if l of its own are left.  Tokens that several documents of a
   sample have are known to be shared; their rows are spread over all tasks, so no frequent token is one task's.
3. For those that stay, exact frequencies among themselves give the order (rare tokens first).  A token that nobody
   else has lessens what a document can share, which bounds the length of its partners or rules it out; done twice,
   as those ruled out change the frequencies.
4. Each document is verified against one hub for a few rounds: the most central document with which it shares most
   prefix tokens.  Links merge components, and only tokens that join two components go on.
5. Every pair left, of different components, meets on its prefix tokens.  Each document lengthens its prefix to the l
   of least estimated cost (entries read, plus ``VERIFY_COST`` for each of at most entries / l candidates), asks for l
   shared tokens; each pair comes up once, at its first shared token, and what passes is verified.  Entries meet by
   token and band of sizes, which parts the documents of a frequent token.

So a group of m copies needs about m verifications, no link between different components is lost, and nothing is
capped: hub rounds only save work.

Defined results: null texts and texts without words are empty sets, linked with nothing; a text of fewer than n
words is one shingle; rows without doc_id are left out; rows with the same doc_id are one document, linked through
each of its texts (its size is the largest); an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import chunks, mix, small, Words
from .components import relabel
from .tables import cut, few, free, table

LEVELS = 6
#: One document in so many is looked at for frequent tokens, of which so many at most are spread (8 bytes each are
#: broadcast).  Neither changes the result: a token that is spread or not is shared all the same.
SAMPLE, SPREAD = 64, 10_000
#: Texts with copies that are broadcast at most (28 bytes each).
CLASSES = 100_000
HUB_ROUNDS = 3
VERIFY_COST = 20.0
_U = np.uint64


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct n-word shingles of each text, by text and hash."""
    w = Words(texts, fold=True)
    h, at = w.grams(n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = []
        for d in short.tolist():
            x = np.ones(1, _U)
            for y in mix(w.hash[w.first[d] : w.first[d + 1]]):
                x = mix(x * _U(0x9E3779B97F4A7C15) + y)
            extra.append(x)
        h, doc = np.concatenate([h, *extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in chunks(texts):
                h, doc = shingle_sets(texts[lo:hi], n)
                size = np.bincount(doc, minlength=hi - lo)
                edge = np.concatenate([[0], np.cumsum(size)])
                cols[0].append(size)
                for c, salt in zip(cols[1:], (0x1656667B19E3779F, 0x27D4EB2F165667C5), strict=True):
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(salt)))])
                    c.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], ["doc_id", "n", "d1", "d2"])

    return run


def _tokens(n: int, num: int, den: int, whole: bool):
    """Tokens of each text: all of them, or those of its lengthened prefix in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts):
                h, doc = shingle_sets(texts[lo:hi], n)
                size = np.bincount(doc, minlength=hi - lo)
                length = size[doc]
                if not whole:
                    place = np.arange(len(h)) - np.concatenate([[0], np.cumsum(size)])[doc]
                    need = -(-num * length // den)
                    stay = place < length - need + np.minimum(np.maximum(LEVELS, length // 10), need)
                    h, doc, length = h[stay], doc[stay], length[stay]
                for a in range(0, len(h), 100_000):
                    b = a + 100_000
                    yield pa.RecordBatch.from_arrays([pa.array(h[a:b].view(np.int64)), pa.array(ids[lo + doc[a:b]]), pa.array(length[a:b].astype(np.int32))], ["token", "rep", "n"])

    return run


TOKENS = "token long, rep long, n int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, rep, n, sure) sorted by token, those that are sure or whose token has a neighbour row."""
    held: pa.RecordBatch | None = None  # the last row, not yet decided
    matched = False
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        same = token[1:] == token[:-1]
        keep = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        keep[1:] |= same
        keep[:-1] |= same
        batch = batch.select([0, 1, 2])
        if held is not None and held.column(0)[0].as_py() == token[0]:
            keep[0] = matched = True
        if held is not None and matched:
            yield held
        last = len(token) - 1
        held, matched = batch.slice(last), bool(keep[last])
        if last:
            yield batch.slice(0, last).filter(pa.array(keep[:last]))
    if held is not None and matched:
        yield held


def _fresh(df: DataFrame, key: str) -> DataFrame:
    """The same rows, whose partitioning by ``key`` the planner does not take over: both sides of a join are then
    dealt out anew, which lets adaptive execution split a hot key."""
    return df.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def _ceil(num: int, den: int, n: Column) -> Column:
    return F.floor((F.lit(num) * n + (den - 1)) / den).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("o") * den >= (F.col("na") + F.col("nb") - F.col("o")) * num).select("a", "b")


def _mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their components, of the tokens that two components or more have."""
    named = entries.join(labels.select(F.col("id").alias("rep"), "comp"), "rep")
    two = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return cut(named.join(_fresh(two, "token"), "token"))


def _reach(a: str, b: str) -> Column:
    """Whether both lengths lie in the other's bounds."""
    return (F.col(f"{a}.n") <= F.col(f"{b}.most")) & (F.col(f"{b}.n") <= F.col(f"{a}.most")) & (F.col(f"{a}.n") >= F.col(f"{b}.least")) & (F.col(f"{b}.n") >= F.col(f"{a}.least"))


def _hub_pairs(live: DataFrame, turn: int) -> DataFrame:
    """One pair for each document: it and the hub with which it shares most tokens.  A token's hub is its document
    with the fewest tokens of its own, ties by a hash that changes with the turn."""
    order = F.struct("alone" if turn % 2 == 0 else F.xxhash64("rep", F.lit(turn)), F.xxhash64("rep", F.lit(turn)), "rep", "n", "comp", "least", "most")
    hubs = live.groupBy("token").agg(F.min(order).alias("h")).select("token", "h.*").select("token", *[F.col(c).alias(f"h_{c}") for c in ("rep", "n", "comp", "least", "most")])
    met = live.join(_fresh(hubs, "token"), "token").where("comp <> h_comp and n <= h_most and h_n <= most and n >= h_least and h_n >= least")
    count = met.groupBy("rep", "h_rep").agg(F.count("*").alias("c"))
    return count.groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("c", "h_rep")).alias("m")).select("a", F.col("m.h_rep").alias("b"))


def _pairs(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Every pair of different components that its longer document's adaptive prefix cannot rule out, once: at the
    first token that both prefixes have, if places there leave room for enough shared tokens."""
    f = live.groupBy("token").agg(F.count("*").alias("f"))
    read = [F.sum(F.when(F.col("level") <= k, F.col("f") - 1).otherwise(0)).alias(f"r{k}") for k in range(1, LEVELS + 1)]
    cost = live.join(_fresh(f, "token"), "token").groupBy("rep").agg(F.max("need").alias("need"), *read)
    best = F.array_min(F.array(*[F.struct(F.when(F.col("need") >= k, F.col(f"r{k}") * (1 + VERIFY_COST / k)).otherwise(float("inf")).alias("c"), F.lit(k).alias("k")) for k in range(1, LEVELS + 1)]))["k"]
    heads = sets.select("rep", F.slice("tokens", F.lit(1), F.greatest(F.col("n") - F.col("need") + LEVELS - F.col("alone"), F.lit(0))).alias("head"))
    side = cut(live.join(cost.select("rep", best.alias("l")).join(heads, "rep"), "rep"))
    most = side.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m")).select("token", F.col("m.comp").alias("main"))
    side = side.join(_fresh(most, "token"), "token")
    # Similar sizes lie in the same band or in neighbours; so a token's documents only meet those of about their size.
    width = max(math.log(den / num), 1e-6) * (1 + 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    near = F.explode(F.array(*[band + d for d in (-1, 0, 1)]))
    x, y = _fresh(side.where("comp <> main").withColumn("band", near), "token").alias("x"), _fresh(side.withColumn("band", band), "token").alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    l = F.when(F.struct("x.n", "x.rep") > F.struct("y.n", "y.rep"), F.col("x.l")).otherwise(F.col("y.l"))
    at = lambda d: F.col(f"{d}.place") + F.col(f"{d}.alone")
    room = F.least(at("x"), at("y")) + 1 + F.least(F.col("x.n") - 1 - at("x"), F.col("y.n") - 1 - at("y"))
    enough = room * (num + den) >= num * (F.col("x.n") + F.col("y.n"))
    before = lambda d: F.slice(F.col(f"{d}.head"), F.lit(1), F.col(f"{d}.place"))
    head = lambda d: F.slice(F.col(f"{d}.head"), F.lit(1), F.greatest(F.col(f"{d}.n") - F.col(f"{d}.need") + l - F.col(f"{d}.alone"), F.lit(0)))
    first = ~F.arrays_overlap(before("x"), before("y"))
    matched = F.size(F.array_intersect(head("x"), head("y"))) >= l
    met = x.join(y, on & _reach("x", "y") & (F.greatest("x.level", "y.level") <= l) & enough & first & matched)
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _ranked(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Documents with the tokens that they share with another of these documents, rare ones first; those whose other
    tokens are too many to link with anyone are left out."""
    frequency = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = tokens.join(_fresh(frequency, "token"), "token")
    ranked = shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
    need = _ceil(num, den, F.col("n"))
    ranked = ranked.select("rep", "n", need.alias("need"), (F.col("n") - F.size("s")).alias("alone"), F.col("s.token").alias("tokens"))
    ranked = ranked.where(F.size("tokens") >= F.col("need"))
    most = F.floor(F.size("tokens") * F.lit(num + den) / num - F.col("n") + 1e-6).cast("int")
    return ranked.withColumn("least", need).withColumn("most", most)


def frequent(reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The tokens that most documents of a sample have in their prefixes, of those that three rows and two documents have."""
    some = reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    count = some.mapInArrow(_tokens(n, num, den, False), TOKENS).groupBy("token").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    return cut(count.where("c > 2 and lo < hi").orderBy(F.desc("c"), "token").limit(SPREAD).select("token"))


def candidates(reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Ids of documents that may link, by prefixes in hash order (step 2)."""
    rows = reps.mapInArrow(_tokens(n, num, den, False), TOKENS)
    known = frequent(reps, n, num, den).withColumn("sure", F.lit(True))
    rows = rows.join(F.broadcast(known), "token", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))  # of SPREAD rows
    dealt = rows.withColumn("deal", F.when(F.col("sure"), F.xxhash64("token", "rep")).otherwise(F.col("token"))).repartition("deal")
    live = dealt.select("token", "rep", "n", "sure").sortWithinPartitions("token").mapInArrow(_shared, TOKENS)
    need = _ceil(num, den, F.col("n"))
    shared = F.least(F.greatest(F.lit(LEVELS), F.floor(F.col("n") / 10)), need)
    return live.groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= shared).select("rep")


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component ids are the smallest doc_id of each group."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    profile = cut(src.mapInArrow(_profile(n), "doc_id long, n long, d1 long, d2 long").distinct())
    full = profile.where("n > 0")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # One row for each text that has copies: few even where they are most of the rows, and then no copies meet in a task.
    classes = cut(classes.where("copies > 1").drop("copies"))
    same = cut(full.join(few(classes, CLASSES), ["d1", "d2", "n"]).where("doc_id <> rep").select("doc_id", "rep"))
    reps = src.join(few(same.select("doc_id").distinct()), "doc_id", "left_anti")
    ids = cut(candidates(reps, n, num, den))
    chosen = src.join(few(ids.distinct().withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    every = chosen.mapInArrow(_tokens(n, num, den, True), TOKENS)
    sets = cut(_ranked(every, num, den))
    sets = cut(_ranked(sets.select(F.explode("tokens").alias("token"), "rep", "n"), num, den))
    head = F.col("n") - F.col("need") + F.least(F.lit(LEVELS), F.col("need")) - F.col("alone")
    entries = sets.select("rep", "n", "need", "alone", "least", "most", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(head, F.lit(0)))).alias("place", "token"))
    entries = entries.withColumn("level", F.greatest(F.lit(1), F.col("place") + F.col("alone") - (F.col("n") - F.col("need")) + 1))
    labels = cut(sets.select(F.col("rep").alias("id"), F.col("rep").alias("comp")).distinct())
    live = _mixed(entries, labels)
    for turn in range(HUB_ROUNDS):
        if live.isEmpty():
            break
        links = cut(_verified(_hub_pairs(live, turn), sets, num, den))
        if links.isEmpty():
            continue
        labels = relabel(labels, links)
        live = _mixed(live.drop("comp"), labels)
    if not live.isEmpty():
        labels = relabel(labels, cut(_verified(_pairs(live, sets, num, den), sets, num, den)))
    moved = labels.where("id <> comp")
    ends = same.join(moved.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    ends = ends.unionByName(moved.select(F.col("id").alias("doc_id"), "comp"))
    return _assembled(profile, ends)


def _assembled(profile: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends``: (doc_id, comp) of documents that are not the smallest of their group; a document with several texts
    may occur more than once, and then ties its groups together."""
    sizes = cut(profile.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.count("*").alias("texts")))
    once = ends.distinct()
    if sizes.where("texts > 1").isEmpty():
        groups = once
    else:
        ids = sizes.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"))
        groups = relabel(ids, cut(once.select(F.col("doc_id").alias("a"), F.col("comp").alias("b")))).withColumnRenamed("id", "doc_id")
    out = sizes.join(groups, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that link, over any path, to one of smaller id."""
    groups = cut(similar_components(docs, n, num, den))
    name = free(docs.columns, "out")
    out = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name))
    return docs.join(few(out), docs["doc_id"] == F.col(name), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
k AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
c AS (SELECT g, n, min(doc_id) AS rep FROM k WHERE n > 0 GROUP BY g, n),
t AS (SELECT rep, n, unnest(g) AS token FROM c),
f AS (SELECT token, count(*) AS f FROM t GROUP BY token),
u AS (SELECT rep, n, t.token, row_number() OVER (PARTITION BY rep ORDER BY f, t.token) AS r, f FROM t JOIN f USING (token)),
p AS (SELECT rep, n, token FROM u WHERE f > 1 AND r <= n - ceil(0.9 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.token = b.token AND a.rep < b.rep AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90),
l AS (SELECT a, b FROM q JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 100 * len(list_intersect(x.g, y.g)) >= 90 * (x.n + y.n - len(list_intersect(x.g, y.g)))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, rep FROM c),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(component_id, k.doc_id) AS component_id FROM k LEFT JOIN c ON c.g = k.g AND k.n > 0 LEFT JOIN m USING (rep)"""
