"""Byte-level BPE by dynamic programming over prefixes.

Each prefix of a piece (a match of the pattern) has exactly one token that its encoding can end with: the one that ends
there, that follows the last token of the shorter prefix it leaves, and that merging would not join with that token in
another way.  For a row of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of
theirs: before the first merge across a border, merging goes on inside tokens just as it would in the pair alone.

The table of last tokens gives the encoding of every prefix, walked from its end.  It has one number for each byte of a
text; the first byte of a piece is marked by ``FIRST``.  So a text can be lengthened or changed by working anew only on
the pieces near the place: ``append`` and ``replace``.

Defined results: a null text is empty, with no ids; repeated rows are encoded each; an empty table gives an empty
result; only named columns are read; unknown or null ids decode to null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import CHUNK_CHARS, chunks, small
from .tables import in_arrow, table

#: Marks the first byte of a piece in a table of last tokens.
FIRST = 1 << 31
#: Pieces remembered by a worker, in two generations of this size, and pairs of tokens.
GENERATION, PAIRS = 200_000, 1_000_000
#: Bytes of pieces that are worked on side by side; longer ones go one by one.
SIDE_BY_SIDE = 64
#: Endings after an apostrophe that the pattern takes as pieces.
SHORT, LONG = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, BLANK, OTHER, EDGE = range(5)
CUT = re.compile(r"(?<=\S)\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def trie_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of inner nodes by byte, the row of each node in that table (leaves share an empty one), and the token
    that ends at each node; -1 for none.  The root is 0."""
    edges, token_at = {}, [-1]
    for token, i in ranks.items():
        node = 0
        for byte in token:
            key = node << 8 | byte
            if (to := edges.get(key)) is None:
                to = edges[key] = len(token_at)
                token_at.append(-1)
            node = to
        token_at[node] = i
    keys, to = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
    inner = np.unique(keys >> 8)
    row = np.full(len(token_at), len(inner), np.int32)
    row[inner] = np.arange(len(inner))
    child = np.full((len(inner) + 1, 256), -1, np.int32)
    child[row[keys >> 8], keys & 255] = to
    return child, row, np.array(token_at, np.int32)


class Vocabulary:
    """Tokens and their ranks; tables of last tokens."""

    _shared: dict[str, Vocabulary] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.size = np.zeros(max(self.tokens) + 1, np.int64)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.child, self.row, self.token_at = trie_of(ranks)
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str, pattern: str) -> Vocabulary:
        """One for each Python worker."""
        key = f"{path}\n{pattern}"
        if key not in cls._shared:
            cls._shared[key] = cls(read_ranks(path), pattern)
        return cls._shared[key]

    def merged(self, raw: bytes) -> list[int]:
        """Tokens that merging by rank ends with; for strings as short as two tokens."""
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], FIRST), i) for i in range(len(parts) - 1))
            if rank == FIRST:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether the two stand as they are when merging is done; ``before`` is -1 where nothing does."""
        key = (before << 32) + token
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.tokens[token] if before < 0 else self.tokens[before] + self.tokens[token]
            if before < 0:
                known = self.merged(both) == [token]
            else:  # two that are a token together would be merged
                known = both not in self.ranks and self.merged(both) == [before, token]
            self.pairs[key] = known
        return known

    def last_tokens(self, piece: str, have: list[int] | None = None) -> list[int]:
        """The last token of each prefix of a piece (its bytes as Latin-1), given those of its first prefixes."""
        last = list(have or ())
        done, get, follows = len(last), self.pairs.get, self.follows
        last += [-1] * (len(piece) - done)
        last.append(-1)  # that of the empty prefix, at place -1
        for end, (token, size) in self.ends.iter(piece, max(0, done - self.longest)):
            if last[end] < 0:
                before = last[end - size]
                known = get((before << 32) + token)
                if follows(before, token) if known is None else known:
                    last[end] = token
        last.pop()
        return last

    def walk(self, last: list[int]) -> list[int]:
        """Tokens of the longest prefix of a piece, from its table."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def matches(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each token begins in the bytes, its length and the token; ``room``: bytes to the end of the piece."""
        at, node, size, found = np.arange(len(flat)), np.zeros(len(flat), np.int32), 0, []
        while len(at):
            node = self.child[self.row[node], flat[at + size]]
            size += 1
            at, node = at[node >= 0], node[node >= 0]
            token = self.token_at[node]
            hit = token >= 0
            found.append((at[hit], np.full(hit.sum(), size), token[hit]))
            more = room[at] > size
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode_many(self, raws: list[bytes]) -> list[bytes]:
        """Ids of pieces as little-endian 32-bit numbers: their tables are filled side by side, a byte at a time."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        piece = np.repeat(np.arange(len(raws)), size)
        begin = np.cumsum(size) - size
        offset = np.arange(len(flat)) - begin[piece]
        start, length, token = self.matches(flat, size[piece] - offset)
        # A piece of n bytes has n + 1 places, that of its empty prefix first.
        before, after, end = start + piece[start], start + piece[start] + length, offset[start] + length
        order = np.argsort(end, kind="stable")
        before, after, token = before[order], after[order], token[order].astype(np.int64)
        steps = np.searchsorted(end[order], np.arange(1, size.max() + 2))
        last, get = np.full(len(flat) + len(raws), -1, np.int64), self.pairs.get
        for lo, hi in zip(steps, steps[1:], strict=False):
            left = last[before[lo:hi]]
            known = list(map(get, ((left << 32) + token[lo:hi]).tolist()))
            if None in known:
                known = [self.follows(a, b) if k is None else k for k, a, b in zip(known, left.tolist(), token[lo:hi].tolist(), strict=True)]
            right = np.array(known, bool)
            last[after[lo:hi][right]] = token[lo:hi][right]
        own = np.arange(len(raws))
        place, first, out = begin + own + size, begin + own, []
        while len(own):
            t = last[place[own]]
            out.append((own, t))
            place[own] -= self.size[t]
            own = own[place[own] > first[own]]
        whose = np.concatenate([p for p, _ in out])
        step = np.repeat(np.arange(len(out)), [len(p) for p, _ in out])
        ids = np.concatenate([t for _, t in out])[np.lexsort((-step, whose))].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(whose, minlength=len(raws))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids of pieces.  One that is a token itself is that token, whatever merging gives."""
        short = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.new[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SIDE_BY_SIDE:
                short.append((piece, raw))
            else:
                self.new[piece] = np.array(self.walk(self.last_tokens(raw.decode("latin-1"))), "<u4").tobytes()
        if short:
            self.new.update(zip((p for p, _ in short), self.encode_many([r for _, r in short]), strict=True))

    def table_of(self, piece: str, have: list[int] | None = None) -> list[int]:
        """``last_tokens`` of a piece with its first byte marked; a piece that is a token itself ends with it."""
        raw = piece.encode("utf-8", "surrogatepass")
        last = self.last_tokens(raw.decode("latin-1"), have)
        if raw in self.ranks:
            last[-1] = self.ranks[raw]
        return [last[0] | FIRST, *last[1:]]

    def remember(self, pieces: set[str]) -> None:
        """Puts the pieces into ``new``; those seen lately are not worked out again."""
        if len(self.new) > GENERATION:
            self.old, self.new = self.new, {}
        missing = pieces.difference(self.new)
        known = {p: ids for p in missing if (ids := self.old.get(p))}
        self.new.update(known)
        self.learn(missing.difference(known))


_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space, other."""
    global _kinds
    if _kinds is None:
        import regex

        every = "".join(map(chr, range(0xD800))) + "\ud800" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(runs, every):
                out[m.start() : m.end()] = kind
        _kinds = out
    return _kinds


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts, each followed by a mark, as one string; the places at which pieces and marks begin; the marks' places.

    Pieces are those of ``public_tokenizers.PATTERN``: runs of letters, of numbers and of other signs, each with one
    space before it if there is one; white space up to the last before a sign; endings after a lone apostrophe.
    """
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = kinds()[cp]
    kind[marks] = EDGE
    first = np.empty(len(cp) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:-1])
    first[marks] = first[marks + 1] = True
    last_blank = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] < EDGE) & (kind[1:] != BLANK))
    first[last_blank] = True
    first[last_blank[cp[last_blank] == 32] + 1] = False
    lone = np.flatnonzero((cp[:-1] == 39) & (kind[1:] == LETTER) & first[:-2])
    for at in lone.tolist():
        size = 2 if joined[at + 1] in SHORT else 3 if joined[at + 1 : at + 3] in LONG else 0
        if size:
            first[at + 1 : at + size] = False
            first[at + size] = True
    return joined, np.flatnonzero(first), marks


def parts_of(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the text, part): long texts are cut before white space that follows another sign, where a piece begins."""
    for i, text in enumerate(texts):
        lo = 0
        while len(text) - lo > 2 * CHUNK_CHARS and (m := CUT.search(text, lo + CHUNK_CHARS)):
            yield i, text[lo : m.start()]
            lo = m.start()
        yield i, text[lo:]


def pieces_of(texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
    """(number of the text, pieces in a row), some at a time."""
    numbers, parts = zip(*parts_of(texts), strict=True) if texts else ((), ())
    for lo, hi in chunks(parts):
        joined, starts, marks = split(parts[lo:hi])
        at = starts.tolist()
        every = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
        ends = np.searchsorted(starts, marks).tolist()
        yield [(i, every[a:b]) for i, a, b in zip(numbers[lo:hi], [0, *(e + 1 for e in ends)], ends, strict=False)]


def splitter(vocabulary: Vocabulary, pattern: str) -> Callable[[list[str]], Iterator[list[tuple[int, list[str]]]]]:
    """The vectorised split for the pattern that it stands for; the pattern itself for any other."""
    import public_tokenizers

    if pattern == public_tokenizers.PATTERN:
        return pieces_of
    return lambda texts: ([(i, vocabulary.pattern.findall(text))] for i, text in enumerate(texts))


def encode(docs: DataFrame, ranks_path: str, pattern: str, prefixes: bool = False) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit numbers; with ``prefixes`` also the table ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(ranks_path, pattern)
        pieces = splitter(vocabulary, pattern)
        for batch in small(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids, last = [b""] * len(texts), [b""] * len(texts)
            for some in pieces(texts):
                vocabulary.remember(set().union(*(own for _, own in some)))
                for i, own in some:
                    ids[i] += b"".join(map(vocabulary.new.__getitem__, own))
                    if prefixes:
                        last[i] += np.array([x for p in own for x in vocabulary.table_of(p)], "<u4").tobytes()
            out = [batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), *([pa.array(last, pa.binary())] if prefixes else [])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "last"][: len(out)])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary" + ", last binary" * prefixes)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Vocabulary.shared(ranks_path, pattern).tokens.get
        for batch in small(batches):
            out = []
            for ids in batch.column(1).to_pylist():
                parts = None if ids is None or len(ids) % 4 else list(map(get, np.frombuffer(ids, "<u4").tolist()))
                out.append(None if parts is None or None in parts else b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary()), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def changed(vocabulary: Vocabulary, text: str, last: np.ndarray, start: int, length: int, more: str) -> tuple[str, np.ndarray, int]:
    """The text with ``length`` characters from ``start`` replaced, its table, and the bytes that were worked on anew.

    A piece is settled by its own characters and the two after it, so pieces that end two before the change stay.  Then
    the pattern goes on from there until a piece begins behind the change where one began before: from there the old
    table holds.  A piece that keeps its beginning keeps the last tokens of the bytes before the change.
    """
    start = max(0, min(start, len(text)))
    stop = max(start, min(start + length, len(text)))
    out = text[:start] + more + text[stop:]
    firsts = np.flatnonzero(last & FIRST)
    settled = len(text[: max(0, start - 2)].encode("utf-8", "surrogatepass"))
    same = len(text[:start].encode("utf-8", "surrogatepass"))
    k = max(0, int(np.searchsorted(firsts, settled, "right")) - 1)
    begin = int(firsts[k]) if len(firsts) else 0
    at = len(text.encode("utf-8", "surrogatepass")[:begin].decode("utf-8", "surrogatepass"))
    behind, shift = start + len(more), len(out.encode("utf-8", "surrogatepass")) - len(last)
    parts, place, old_firsts, anew = [last[:begin]], begin, set(firsts[k:].tolist()), 0
    for m in vocabulary.pattern.finditer(out, at):
        if m.start() >= behind and place - shift in old_firsts:
            parts.append(last[place - shift :])
            break
        raw = m.group().encode("utf-8", "surrogatepass")
        have = []
        if place < same and place in old_firsts:
            nearest = firsts[np.searchsorted(firsts, place, "right") :][:1]
            end = min([same, place + len(raw), *nearest.tolist(), len(last)])
            have = (last[place:end] & (FIRST - 1)).tolist()
            if have and end in (*nearest.tolist(), len(last)):
                have.pop()  # of a whole piece, which may be a token that merging does not give
        parts.append(np.array(vocabulary.table_of(m.group(), have), "<u4"))
        anew += len(raw) - len(have)
        place += len(raw)
    return out, np.concatenate(parts).astype("<u4"), anew


def ids_of_table(vocabulary: Vocabulary, last: np.ndarray) -> bytes:
    """Ids of a text, from its table."""
    firsts = [*np.flatnonzero(last & FIRST).tolist(), len(last)]
    plain = (last & (FIRST - 1)).tolist()
    return np.array([t for a, b in zip(firsts, firsts[1:], strict=False) for t in vocabulary.walk(plain[a:b])], "<u4").tobytes()


def replace(edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``edits``: (doc_id, text, last, start, length, more), the table being that of the text.  Returns (doc_id, text,
    ids, last, anew) of each text with ``length`` characters from ``start`` replaced by ``more``; ``anew`` counts the
    bytes that were worked on.  Null places are the end, null lengths zero; places beyond the end are the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(ranks_path, pattern)
        for batch in small(batches):
            rows = []
            for text, last, start, length, more in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                text = text or ""
                out, tab, anew = changed(vocabulary, text, np.frombuffer(last or b"", "<u4"), len(text) if start is None else start, length or 0, more or "")
                rows.append((out, ids_of_table(vocabulary, tab), tab.tobytes(), anew))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds_ = (pa.string(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds_, strict=True))], ["doc_id", "text", "ids", "last", "anew"])

    return in_arrow(edits.select("doc_id", "text", "last", "start", "length", "more"), run, "doc_id long, text string, ids binary, last binary, anew long")


def append(edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``replace`` at the end: (doc_id, text, last, more)."""
    return replace(edits.select("doc_id", "text", "last", F.lit(None).cast("long").alias("start"), F.lit(0).alias("length"), "more"), ranks_path, pattern)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
