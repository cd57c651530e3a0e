"""Hierarchical multi-length packing of tokenised documents.

Whole windows are cut off long documents; what is left is routed to the smallest context-size tier that holds it.
Each tier is packed from its longest document down: a window takes the best-fitting whole documents of its own and
then of shorter tiers, and the last gap is filled by cutting one document, whose rest is routed again.  So windows of
all tiers are exactly full.  What remains when a partition ends is put into the longest windows in order; only the
very last of those can be short.  Sequences are dealt to step groups of equal token budgets, a tier at a time.

Every input partition is packed by itself: no shuffle, memory bounded by ``BUFFER_TOKENS`` and one document, and a
repeated task gives the same sequences.  Sequence and step ids are (partition << 32) + counter.

Defined results: a null text is empty, a document of only the end id; repeated rows are packed as often as they
occur; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chars import give_back, small
from .tables import table
from .wordcache import CachedTokenizer

CONTEXT = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
BUFFER_TOKENS = 2_000_000
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

Piece = tuple[int, int, int, int]  # length, serial number (to break ties), document, start


class Packer:
    """Takes (document, ids) one by one; ``emit`` gets each sequence: its tier and its pieces (document, start, length)."""

    def __init__(self, emit: Callable[[int, list[tuple[int, int, int]]], None], tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers, self.context = emit, tiers, tiers[-1]
        self.pool: list[Piece] = []  # by length
        self.serial = 0

    def add(self, doc: int, length: int) -> None:
        start = 0
        while length - start >= self.context:
            self.emit(self.context, [(doc, start, self.context)])
            start += self.context
        self._put(doc, start, length - start)

    def _put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.serial += 1
            insort(self.pool, (length, self.serial, doc, start))

    def pack(self) -> None:
        """Fills windows, each of the tier of the longest piece left, as long as the pieces left can fill it."""
        left = sum(p[0] for p in self.pool)
        while self.pool:
            tier = next(t for t in self.tiers if t >= self.pool[-1][0])
            if left < tier:
                return
            left -= tier
            gap, window = tier, []
            while gap and self.pool:
                k = bisect_right(self.pool, (gap, self.serial + 1, 0, 0)) - 1
                length, _, doc, start = self.pool.pop(max(k, 0))
                take = min(gap, length)
                window.append((doc, start, take))
                gap -= take
                self._put(doc, start + take, length - take)
            self.emit(tier, window)

    def finish(self) -> None:
        self.pack()
        gap, window = self.context, []
        for length, _, doc, start in reversed(self.pool):
            while length:
                take = min(gap, length)
                window.append((doc, start, take))
                start, length, gap = start + take, length - take, gap - take
                if not gap:
                    self.emit(self.context, window)
                    gap, window = self.context, []
        if window:
            self.emit(self.context, window)
        self.pool = []


class Steps:
    """Deals sequences to step groups of a token budget; each tier has an open group, so a group's windows are alike."""

    def __init__(self, base: int, tokens: int = STEP_TOKENS):
        self.next, self.tokens, self.open = base, tokens, {}

    def of(self, tier: int) -> int:
        group, used = self.open.get(tier, (None, self.tokens))
        if used + tier > self.tokens:
            group, used = self.next, 0
            self.next += 1
        self.open[tier] = (group, used + tier)
        return group


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece (columns of ``SCHEMA``); the ids themselves follow from (doc_id, start, length)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        tokenizer = CachedTokenizer.shared(tokenizer_path)
        steps = Steps(base, step_tokens)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        rows: list[tuple] = []
        sequence = base

        def emit(tier: int, window: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset, group = 0, steps.of(tier)
            for doc, start, length in window:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, offset, tier, group))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        packer, serial, buffered = Packer(emit, tiers), 0, 0
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(texts, END_ID), strict=True):
                held[serial] = (doc_id, ids)
                packer.add(serial, len(ids))
                serial, buffered = serial + 1, buffered + len(ids)
                if buffered >= BUFFER_TOKENS:
                    packer.pack()
                    used = {p[2] for p in packer.pool}
                    held = {k: v for k, v in held.items() if k in used}
                    buffered = 0
                if len(rows) >= 20_000:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()
        held.clear()
        tokenizer.old = {}  # the worker lives on
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
