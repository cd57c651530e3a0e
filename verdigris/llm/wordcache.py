"""A tokenizer whose ids of blank-delimited chunks are remembered.

Exact for tokenizers that treat blank-delimited chunks apart from each other, as word-level BPE does that drops white
space and whose words never cross it: the ids of a text are those of its chunks in order.  A tokenizer that is not known
to be one of these by its normaliser and pre-tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np

#: Chunks remembered by a worker, in two generations of this size.
GENERATION = 200_000
#: Of the private use area: a word of its own.
MARK = "\ue000"
#: In UTF-8: a run of a-z and of small letters of Latin-1, none of which the normaliser changes, and marks of ASCII after
#: it, which are a word of their own.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Normalisers, and the words, of tokenizers whose chunks stand apart: lower case, no white space in a word.
APART = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts and characters that are encoded at a time where they are not.
TEXTS, CHARS = 64, 1 << 20


def apart(spec: dict) -> bool:
    parts = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    words = [s["pattern"].get("Regex") for s in splits if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    rest = [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in splits if s["type"] != "Split"]
    blanks = all(p["pattern"] == {"Regex": r"\s+"} and p["content"] == " " for p in parts if p["type"] == "Replace")
    return [p["type"] for p in parts] == APART[0] and blanks and words == [APART[1]] and rest == [("ByteLevel", False, False)] and spec["model"].get("end_of_word_suffix") == "</w>"


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1, where Python's lower case is the tokenizer's and nothing composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class CachedTokenizer:
    _shared: dict[str, CachedTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.apart = apart(spec)
        #: The same model for runs of small letters, which need no normaliser and part at blanks.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Added tokens are found before the normaliser, so only as they are written.
        self.added = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @classmethod
    def shared(cls, path: str) -> CachedTokenizer:
        """One for each Python worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _plain(self, words: list[bytes]) -> None:
        """Runs of small letters: each is one word, so its last id, and no other, ends a word."""
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                self._each(part)
                continue
            raw, lo_byte = ids.tobytes(), 0
            for word, hi_byte in zip(part, (cut * 4).tolist(), strict=True):
                self.new[word] = raw[lo_byte:hi_byte]
                lo_byte = hi_byte

    def _each(self, chunks: list[bytes]) -> None:
        """Chunks of any kind, many in one text: between each two stands a mark that no other chunk holds."""
        for lo in range(0, len(chunks), 1000):
            part = chunks[lo : lo + 1000]
            texts = [c.decode("utf-8", "surrogatepass") for c in part]
            joined = f" {MARK} ".join(texts)
            if joined.count(MARK) == len(part) - 1:
                ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32)
                width = len(self.mark)
                at = np.flatnonzero(ids == self.mark[0])
                at = at[at <= len(ids) - width]
                for k in range(1, width):
                    at = at[ids[at + k] == self.mark[k]]
                if len(at) == len(part) - 1:
                    raw = ids.tobytes()
                    for chunk, a, b in zip(part, [0, *((at + width) * 4).tolist()], [*(at * 4).tolist(), len(raw)], strict=True):
                        self.new[chunk] = raw[a:b]
                    continue
            for chunk, e in zip(part, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                self.new[chunk] = np.array(e.ids, np.uint32).tobytes()

    def _learn(self, chunks: Iterable[bytes]) -> None:
        new, old = self.new, self.old
        plain, other, ending = set(), set(), []
        for c in chunks:
            if (ids := old.get(c)) is not None:
                new[c] = ids
            elif c.isalpha():  # of ASCII, and those are in lower case
                plain.add(c)
            elif not (m := _WORD.fullmatch(c)):
                other.add(c)
            elif m[2]:
                ending.append((c, m[1], m[2]))
            else:
                plain.add(c)
        for _, *parts in ending:
            for kind, c in zip((plain, other), parts, strict=True):
                if c not in new:
                    if (ids := old.get(c)) is not None:
                        new[c] = ids
                    else:
                        kind.add(c)
        self._plain(list(plain))
        self._each(list(other))
        for c, word, marks in ending:
            new[c] = new[word] + new[marks]

    def _chunks(self, text: str) -> list[bytes]:
        """Chunks between blanks, in lower case where that is sure to change no id."""
        raw = text.encode("utf-8", "surrogatepass")
        low = raw.lower()  # A-Z only
        added = [t for t in self.added if t in low]
        if not added and raw.isascii():
            return low.split()
        if not added and _latin(text):
            return text.lower().encode().split()
        return [c.lower() if c.isascii() and not any(t in c.lower() for t in added) else c for c in raw.split()]

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text, then ``end_id``."""
        end = np.array([end_id], np.uint32).tobytes()
        if not self.apart:
            lo, size = 0, 0
            for i, text in enumerate([*texts, None]):
                if i > lo and (i == len(texts) or i - lo >= TEXTS or size + len(text or "") > CHARS):
                    for e in self.tokenizer.encode_batch([x or "" for x in texts[lo:i]], add_special_tokens=False):
                        yield np.array([*e.ids, end_id], np.uint32)
                    lo, size = i, 0
                size += len(text or "")
            return
        for lo in range(0, len(texts), 256):
            part = [self._chunks(text or "") for text in texts[lo : lo + 256]]
            if len(self.new) > GENERATION:
                self.old, self.new = self.new, {}
            wanted = set().union(*part)
            self._learn(list(filterfalse(self.new.__contains__, wanted)))
            get = self.new.__getitem__
            for chunks in part:
                yield np.frombuffer(b"".join(map(get, chunks)) + end, np.uint32)
