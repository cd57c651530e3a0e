"""Prefix trie of conversations by preorder intervals.

Conversations are ranked as sequences of turns, copies alike: turns are named by their digests, and blocks of ``BLOCK``
names in a row are ranked among all blocks and renamed by their rank, until one name is left for each conversation.  So
no task ever holds more than a block of a conversation, however long it is.

In the order of ranks, a conversation begins new nodes beyond the turns that it shares with the one before it, and the
conversations of a node are an interval of ranks.  At one depth, the rows of a node follow each other, so a distributed
prefix sum of beginnings numbers the nodes.  Sorted by (first rank, depth) nodes stand in preorder; a node's subtree ends
where the nodes of its last rank end, and leaves and savings of a subtree are differences of prefix sums at its two ends.

Prefix sums add up the rows of each sorted part in its task and give the driver one row for each part.  Sorted rows are
checkpointed, so a part that is read again is the same part.

Defined results: rows without conv_id take no part; turns are ordered by turn (null first), ties by the digests of role
and text, repeated rows each count; a null role or text is empty; an empty table gives an empty result; only named
columns are read.  Turns are held to be equal if their SHA-256 digests are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import small
from .tables import cut, in_arrow, table

#: Names that are ranked together, and conv_ids that are joined to a string at a time.
BLOCK, IDS = 16, 4096
#: Of a contract that rebuilds conversations: each begins with turns of the first of its family.
FAMILY, MOST = 5, 9


def sorted_parts(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in order, in parts that stay as they are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))


def prefix_sums(parts: DataFrame, **sums: str) -> DataFrame:
    """Adds, for each name, the sum of a long column over all rows up to this one.  ``parts``: from ``sorted_parts``."""
    names, columns = list(sums), list(sums.values())
    totals = parts.groupBy(F.spark_partition_id().alias("part")).agg(*(F.sum(c).alias(c) for c in dict.fromkeys(columns))).collect()
    n = max((r["part"] for r in totals), default=-1) + 1
    before = {c: np.zeros(n + 1, np.int64) for c in columns}
    for r in totals:
        for c in before:
            before[c][r["part"] + 1] = r[c]
    before = {c: np.cumsum(x) for c, x in before.items()}
    places = [parts.columns.index(c) for c in columns]
    schema = T.StructType([*parts.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = [before[c][part] if part <= n else 0 for c in columns]
        for batch in small(batches, 1 << 16):
            added = []
            for k, place in enumerate(places):
                x = at[k] + np.cumsum(batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64))
                at[k] = x[-1] if len(x) else at[k]
                added.append(pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return in_arrow(parts, run, schema)


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Rows with their place, from 1, in the order."""
    return prefix_sums(sorted_parts(rows.withColumn("one_", F.lit(1).cast("long")), *order), **{name: "one_"}).drop("one_")


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, token, bytes): turns with their places from 1, digests and the bytes of their texts.  Places are
    counted over all rows and the first of the conversation is taken off, so that no conversation is one task's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("token"), F.octet_length(text).cast("long").alias("bytes"))
    all_ = numbered(rows, "n", "conv_id", F.col("turn").asc_nulls_first(), "token")
    return cut(all_).select("conv_id", "n", "token", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first: (conv_id) and (conv_id, depth, token, bytes)."""
    first = turns.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("n_turns"))
    first = first.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST)
    base = first.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"), F.col("n_turns").alias("base_turns"))
    convs = cut(first.join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0)))))
    own = turns.join(convs.select("conv_id", "first", "h", "lent"), "conv_id").withColumn("place", F.col("n") - F.col("first") + 1)
    own = own.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "token", "bytes")
    wanted = convs.where("lent > 0").select("conv_id", F.explode(F.sequence(F.lit(1), F.col("lent"))).alias("depth"), "base_first")
    wanted = wanted.select("conv_id", F.col("depth").cast("long").alias("depth"), (F.col("base_first") + F.col("depth") - 1).alias("n"))
    lent = wanted.join(turns.select("n", "token", "bytes"), "n").select("conv_id", "depth", "token", "bytes")
    return convs.select("conv_id"), own.unionByName(lent)


def ranked(rows: DataFrame) -> DataFrame:
    """(conv_id, rank): 1 and on, in the lexicographic order of (conv_id, depth, token); equal sequences share a rank."""
    names = rows.select("conv_id", F.col("depth").alias("place"), F.col("token").alias("name"))
    while True:
        block = F.floor((F.col("place") - 1) / BLOCK)
        keys = names.groupBy("conv_id", (block + 1).alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("key"))  # of BLOCK names at most
        keys = cut(keys)
        distinct = numbered(keys.select("key").distinct(), "name", "key")
        names = cut(keys.join(distinct, "key").select("conv_id", "place", "name"))
        if names.where("place > 1").isEmpty():
            return names.select("conv_id", F.col("name").alias("rank"))


def hashes(members: DataFrame) -> DataFrame:
    """(rank, ends_sha256) of the conv_ids (conv_id, rank), numerically ascending.  Sorted parts write them to strings of
    ``IDS`` ids at most; a task hashes the strings of a rank one after another, holding one of them."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for rank, ids in batch.groupby("rank", sort=False)["conv_id"]:
                ids = ids.tolist()
                for lo in range(0, len(ids), IDS):
                    rows.append((rank, part, serial, ",".join(map(str, ids[lo : lo + IDS]))))
                    serial += 1
            yield pd.DataFrame(rows, columns=["rank", "part", "serial", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for rank, ids in zip(batch["rank"], batch["ids"], strict=True):
                if rank != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = rank, sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["rank", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["rank", "ends_sha256"])

    parts = sorted_parts(members.select("rank", "conv_id"), "rank", "conv_id").mapInPandas(strings, "rank long, part int, serial long, ids string")
    return parts.repartition("rank").sortWithinPartitions("rank", "part", "serial").mapInPandas(hashed, "rank long, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id) with turns (conv_id, depth, token, bytes), depths from 1 without
    gaps.  Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder,
    subtree_end): conv_id is the node's smallest member; its subtree are the nodes of preorder to subtree_end."""
    rows = cut(rows)
    ranks = ranked(rows)
    members = convs.join(ranks, "conv_id", "left").select("conv_id", F.coalesce("rank", F.lit(0)).alias("rank"))  # 0: turnless
    members = cut(members)
    distinct = cut(members.groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
    paths = cut(rows.join(distinct, "conv_id").select("rank", "depth", "token", "bytes", "conv_id", "n"))  # one conversation for each rank

    # Turns shared with the rank before; a row begins a node if it lies beyond them.
    before = paths.select((F.col("rank") + 1).alias("rank"), "depth", F.col("token").alias("other"))
    differ = paths.join(before, ["rank", "depth"], "left").where("other is null or other <> token")
    shared = differ.groupBy("rank").agg((F.min("depth") - 1).alias("shared"))
    flagged = paths.join(shared, "rank").withColumn("begins", (F.col("depth") > F.col("shared")).cast("long"))
    levels = cut(prefix_sums(sorted_parts(flagged.select("rank", "depth", "bytes", "conv_id", "n", "begins"), "depth", "rank"), node="begins"))

    nodes = levels.groupBy("node").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    parents = levels.where("begins = 1").select("node", "rank", "depth").join(levels.select("rank", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")), ["rank", "depth"], "left").select("node", "parent")
    children = parents.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(parents, "node").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    named = nodes.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")

    # Preorder, and prefix sums along it.
    named = named.withColumns({"one_": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    order = cut(prefix_sums(sorted_parts(named, "first", "depth"), preorder="one_", leaves="leaf", savings="saved"))
    ends = order.groupBy(F.col("first").alias("last")).agg(F.max("preorder").alias("subtree_end"), F.max("leaves").alias("end_leaves"), F.max("savings").alias("end_savings"))
    whole = order.agg(F.count("*").alias("subtree_end"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum((F.col("depth") == 1).cast("long")).alias("n_children"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    [root] = top.crossJoin(whole).collect()  # one row
    smallest = root["conv_id"]  # null without conversations
    ended = paths.groupBy("rank").agg(F.max("depth").alias("depth")).join(hashes(members), "rank").select(F.col("rank").alias("first_"), F.col("depth").alias("depth_"), "ends_sha256")
    out = order.join(ends, "last").join(ended, (F.col("first") == F.col("first_")) & (F.col("depth") == F.col("depth_")), "left")
    none = sha256(b"").hexdigest()
    out = out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(smallest)).cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "preorder", "subtree_end",
    )
    if smallest is None:
        return out
    turnless = hashes(members.where("rank = 0")).select("ends_sha256")
    facts = [(smallest, 0, None, root["n_convs"], root["n_children"] or 0, root["n_leaves"] or 1, root["saved_tokens"] or 0, 0, root["subtree_end"])]
    head = out.sparkSession.createDataFrame(facts, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, preorder long, subtree_end long")
    head = head.join(turnless, F.lit(True), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))  # one row each
    return out.unionByName(head)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations."""
    out = trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))
    return out.drop("preorder", "subtree_end")


#: The same in SQL: every node against all its ancestors.  CRC-32 is worked out bit by bit.
ORACLE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS token
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, token, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS place FROM turns),
sums AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
        xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) % 9 AS h
    FROM placed GROUP BY conv_id),
convs AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS lent FROM sums AS s LEFT JOIN sums AS b ON s.base = b.conv_id),
rebuilt AS (
    SELECT c.conv_id, p.place - c.h + c.lent AS depth, p.token, p.bytes FROM convs AS c JOIN placed AS p ON c.conv_id = p.conv_id AND p.place > c.h
    UNION ALL SELECT c.conv_id, p.place, p.token, p.bytes FROM convs AS c JOIN placed AS p ON c.base = p.conv_id AND p.place <= c.h),
paths AS (SELECT c.conv_id, coalesce(list(r.token ORDER BY r.depth) FILTER (r.token IS NOT NULL), []) AS tokens, list(r.bytes ORDER BY r.depth) AS bytes FROM convs AS c LEFT JOIN rebuilt AS r USING (conv_id) GROUP BY c.conv_id),
prefixes AS MATERIALIZED (
    SELECT conv_id, depth, len(tokens) AS turns, sha256(array_to_string(list_slice(tokens, 1, depth), ',')) AS node, CASE WHEN depth > 0 THEN bytes[depth] ELSE 0 END AS bytes
    FROM (SELECT *, unnest(generate_series(0, len(tokens))) AS depth FROM paths)),
nodes AS MATERIALIZED (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth),
links AS MATERIALIZED (SELECT DISTINCT p.node, p.depth, q.node AS above, q.depth AS above_depth FROM prefixes AS p JOIN prefixes AS q ON p.conv_id = q.conv_id AND q.depth <= p.depth),
kids AS (SELECT above AS node, above_depth AS depth, count(*) AS n_children FROM links WHERE depth = above_depth + 1 GROUP BY ALL),
below AS (
    SELECT l.above AS node, l.above_depth AS depth, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
    FROM links AS l JOIN nodes AS n ON l.node = n.node AND l.depth = n.depth LEFT JOIN kids AS k ON l.node = k.node AND l.depth = k.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN below AS b ON n.node = b.node AND n.depth = b.depth LEFT JOIN kids AS k ON n.node = k.node AND n.depth = k.depth
    LEFT JOIN links AS l ON l.node = n.node AND l.depth = n.depth AND l.above_depth = n.depth - 1 LEFT JOIN nodes AS up ON l.above = up.node AND l.above_depth = up.depth
"""
