"""Byte-level BPE against the public library, and tables of last tokens against encoding anew."""

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F

from verdigris.llm import byte_bpe, tables

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SIGNS = "aab's tredmlv'  \n\té1٣!?ll  中文🙂"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.shared(PATH, PATTERN)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def ids(row):
    return np.frombuffer(row["ids"], "<u4").tolist()


def test_whole_documents_against_the_library(spark, plain):
    got = {r["doc_id"]: r for r in byte_bpe.op13_byte_bpe(spark, str(SF)).collect()}
    docs = tables.table(spark, str(SF), "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d["text"] or "")
        digest = sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len(want), digest, sha256((d["text"] or "").encode()).hexdigest())


def test_every_code_point_and_mixed_signs(spark, plain):
    r = random.Random(1)
    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    spaced = "".join(f"a{chr(c)} " for c in range(1, 0x3000))
    mixed = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    long = ["x" * 20_000, "é" * 20_000, "ab" * 9_000, "-" * 20_000, "'s" * 9_000, " " * 9_000 + "a", "\n \t" * 9_000, "word, " * 90_000]
    values = [every, spaced, *mixed, *long]
    got = byte_bpe.encode(texts(spark, *values).repartition(3), PATH, PATTERN).collect()
    assert len(got) == len(values)
    assert all(ids(row) == plain(values[row["doc_id"]]) for row in got)


def test_long_texts_are_cut_where_pieces_begin(vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 7)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 90)))
        assert [p for some in byte_bpe.pieces_of([text]) for _, own in some for p in own] == vocabulary.pattern.findall(text)


def test_last_tokens_are_those_of_every_prefix(plain, vocabulary):
    for piece in ("hello", " antidisestablishmentarianism", "日本語のテキスト", "aaaaaaaaaaaaaaaaaaaaaaa", "!?!?!?!?----====", "\n\n\n\n \n"):
        raw = piece.encode()
        table = vocabulary.last_tokens(raw.decode("latin-1"))
        assert table == [vocabulary.merged(raw[: i + 1])[-1] for i in range(len(raw))]
        assert all(vocabulary.walk(table[: i + 1]) == vocabulary.merged(raw[: i + 1]) for i in range(len(raw)))


def test_edits_equal_encoding_anew(spark, plain):
    r = random.Random(3)
    make = lambda n: "".join(r.choice(SIGNS) for _ in range(r.randint(0, n)))
    values = [make(80) for _ in range(1500)]
    change = [(i, r.randint(0, 90), r.randint(0, 8), make(8)) for i in range(len(values))]
    edits = byte_bpe.encode(texts(spark, *values), PATH, PATTERN, prefixes=True).join(texts(spark, *values), "doc_id").join(spark.createDataFrame(change, "doc_id long, start long, length long, more string"), "doc_id")
    for row in byte_bpe.replace(edits, PATH, PATTERN).collect():
        _, start, length, more = change[row["doc_id"]]
        want = values[row["doc_id"]][:start] + more + values[row["doc_id"]][start + length :]
        assert row["text"] == want and ids(row) == plain(want)
    for row in byte_bpe.append(edits, PATH, PATTERN).collect():
        assert ids(row) == plain(values[row["doc_id"]] + change[row["doc_id"]][3])


def test_a_change_works_on_what_is_near(spark, plain):
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    edits = byte_bpe.encode(texts(spark, text), PATH, PATTERN, prefixes=True).withColumns({"text": F.lit(text), "start": F.lit(40_000), "length": F.lit(3), "more": F.lit("XYZ's")})
    [row] = byte_bpe.replace(edits, PATH, PATTERN).collect()
    assert ids(row) == plain(text[:40_000] + "XYZ's" + text[40_003:]) and row["anew"] < 60
    run = byte_bpe.encode(texts(spark, "ab" * 20_000), PATH, PATTERN, prefixes=True).withColumns({"text": F.lit("ab" * 20_000), "more": F.lit("a")})
    [row] = byte_bpe.append(run, PATH, PATTERN).collect()
    assert ids(row) == plain("ab" * 20_000 + "a") and row["anew"] < 10  # one piece, whose table goes on


def test_tables_go_on_from_changed_texts(spark, plain):
    first = byte_bpe.encode(texts(spark, None, "a b", ""), PATH, PATTERN, prefixes=True).withColumns({"text": F.element_at(F.array(F.lit(None), F.lit("a b"), F.lit("")), F.col("doc_id").cast("int") + 1), "more": F.lit(" It's")})
    second = byte_bpe.append(first, PATH, PATTERN).withColumn("more", F.lit("'re here"))
    got = {r["doc_id"]: r for r in byte_bpe.append(second, PATH, PATTERN).collect()}
    assert {i: r["text"] for i, r in got.items()} == {0: " It's're here", 1: "a b It's're here", 2: " It's're here"}
    assert all(ids(r) == plain(r["text"]) for r in got.values())


def test_a_vocabulary_whose_tokens_merging_does_not_give():
    """Tokens out of the reach of merging stand only for whole pieces."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"cd": 258, b"abcd": 301, b"xyz": 302}
    own = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = byte_bpe.Vocabulary(ranks, PATTERN)
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice("abcdxyz ") for _ in range(r.randint(0, 12)))
        pieces = v.pattern.findall(text)
        v.remember(set(pieces))
        assert np.frombuffer(b"".join(v.new[p] for p in pieces), "<u4").tolist() == own.encode_ordinary(text)
        table = np.array([x for p in pieces for x in v.table_of(p)], "<u4")
        more = "".join(r.choice("abcdxyz ") for _ in range(r.randint(0, 4)))
        out, table, _ = byte_bpe.changed(v, text, table, len(text), 0, more)
        assert np.frombuffer(byte_bpe.ids_of_table(v, table), "<u4").tolist() == own.encode_ordinary(out)
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, PATTERN)


def test_another_pattern(spark):
    pattern = r"\w+|\W+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    [row] = byte_bpe.encode(texts(spark, "Some words, isn't it?  Yes!"), PATH, pattern).collect()
    assert ids(row) == own.encode_ordinary("Some words, isn't it?  Yes!")


def test_odd_rows(spark, plain):
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, ""), (3, "same"), (3, "same")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "last", "decoded", "c0", "dotted.name")})
    encoded = byte_bpe.encode(odd, PATH, PATTERN)
    got = sorted(((r["doc_id"], ids(r)) for r in encoded.collect()), key=repr)
    assert got == sorted([(None, plain("a")), (1, []), (1, []), (2, []), (3, plain("same")), (3, plain("same"))], key=repr)
    assert byte_bpe.encode(odd.limit(0), PATH, PATTERN).count() == byte_bpe.decode(encoded.limit(0), PATH, PATTERN).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xff\xff\xff")), (3, bytearray(b"\1")), (4, bytearray(b"\0\0\0\0"))], "doc_id long, ids binary")
    assert [r["decoded"] for r in byte_bpe.decode(broken, PATH, PATTERN).orderBy("doc_id").collect()] == [None, None, None, bytearray(b"!")]
