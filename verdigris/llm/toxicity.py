"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

The lexicon is learned from labelled rows outside the held-out fold: words whose document frequency is far higher in
toxic than in other texts, beside a short list of seeds.  Its trie is intersected with the Levenshtein automaton of
distance one, two neighbours that change places being one edit (for terms of ``FUZZY_LENGTH`` letters or more whose near
spellings do not occur in clean texts), and the product is made deterministic, so that all words of a batch walk one table in step.  Each hit is put in a context by
the ``WINDOW`` characters on each side: quoted (inside quotation marks or beside a word of reporting), directed
(beside a second person) or plain.  A logistic model over sums by context gives the score.

At most ``TRAIN_ROWS`` labelled rows (the smallest by a hash of their id) are learned from.  Every word of theirs is a
candidate, and thresholds on support and log odds alone decide.  A term stands in two in a thousand of the toxic rows
or more, so their texts bound the lexicon.

Defined results: null and empty texts have no hits and get the score of none; texts are read whole; repeated rows are
scored as often as they occur; with one class labelled the score is the prior; an empty table gives an empty result;
only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import chunks, small
from .subword import held_out, training_ids
from .tables import table

TRAIN_ROWS = 20_000
MIN_LOG_ODDS = 3.0
#: The least lower end of a term's log odds: 1.64 standard errors below them.
MIN_LOWER = 1.6
#: Weight of a near spelling against the exact one.
NEAR_WEIGHT = 0.8
FUZZY_LENGTH = 4
WINDOW = 48
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting")
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTING = re.compile(r"\b(said|says|quote[ds]?|quoting|wrote|writes|called|word|term|phrase|sagte|schrieb|zitat|wort|dit|écrit|cite|mot|dijo|escribió|cita|palabra)\b")
DIRECTED = re.compile(r"\b(you|your|you're|yourself|du|dich|dein|deine|ihr|euch|tu|toi|vous|votre|tú|te|usted|vosotros)\b")
#: Characters of words: ASCII letters and digits and what lies beyond Latin-1 punctuation and general punctuation.
_LETTER = "0-9a-zÀ-ÖØ-öø-῿⁰-⿿぀-\U0010ffff"
TOKEN = re.compile(f"[{_LETTER}]+")


def _token_table() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    for lo, hi in (("0", "9"), ("a", "z"), ("À", "Ö"), ("Ø", "ö"), ("ø", "῿"), ("⁰", "⿿"), ("぀", "\U0010ffff")):
        t[ord(lo) : ord(hi) + 1] = True
    return t


class Automaton:
    """The deterministic product of a lexicon's trie and the Levenshtein automaton of distance at most one, swaps included.

    ``fuzzy[i]`` says whether term i may be met with one edit.  ``accept[state]`` is 2 * term + edits, or -1.  A state
    holds (node, edits, None), and (node, 1, c) where c has been passed over and must come next.
    """

    def __init__(self, terms: list[str], fuzzy: list[bool]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[int | None] = [None]
        soft = [False]
        for i, term in enumerate(terms):
            node = 0
            soft[0] |= fuzzy[i]
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(None)
                    soft.append(False)
                node = children[node][c]
                soft[node] |= fuzzy[i]
            ends[node] = i
        alphabet = sorted({c for t in terms for c in t})
        self.classes = {c: k + 1 for k, c in enumerate(alphabet)}  # 0: any other character

        def closed(pairs: set[tuple[int, int, str | None]]) -> frozenset:
            more = {(child, 1, None) for node, e, _ in pairs if not e for child in children[node].values() if soft[child]}
            every = pairs | more
            return frozenset(p for p in every if not p[1] or p[2] is not None or (p[0], 0, None) not in every)

        def step(state: frozenset, c: str | None) -> frozenset:
            out: set[tuple[int, int, str | None]] = set()
            for node, e, due in state:
                if due is not None:
                    if c == due:
                        out.add((node, 1, None))
                    continue
                if c in children[node] and (not e or soft[children[node][c]]):
                    out.add((children[node][c], e, None))
                if not e:
                    if soft[node]:
                        out.add((node, 1, None))
                    for d, child in children[node].items():
                        if soft[child]:
                            out.add((child, 1, None))
                            if c != d and c in children[child] and soft[children[child][c]]:
                                out.add((children[child][c], 1, d))
            return closed(out)

        start = closed({(0, 0, None)})
        index, queue, moves = {start: 0}, [start], []
        for state in queue:
            row = []
            for c in [None, *alphabet]:
                to = step(state, c)
                if not to:
                    row.append(-1)
                    continue
                if to not in index:
                    index[to] = len(queue)
                    queue.append(to)
                row.append(index[to])
            moves.append(row)
        self.moves = np.array(moves, np.int32).reshape(len(queue), len(alphabet) + 1)
        self.accept = np.full(len(queue), -1, np.int32)
        for k, state in enumerate(queue):
            found = [(e, ends[n]) for n, e, due in state if due is None and ends[n] is not None and (not e or fuzzy[ends[n]])]
            if found:
                e, i = min(found)
                self.accept[k] = 2 * i + e
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hits in lower-case texts: text index, start and end in the text, and 2 * term + edits; and tokens per text."""
        if self._tables is None:
            cls = np.zeros(0x110000, np.uint8 if len(self.classes) < 255 else np.int16)
            for c, k in self.classes.items():
                cls[ord(c)] = k
            self._tables = _token_table(), cls
        letters, cls = self._tables
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.flatnonzero(np.diff(letters[cp], prepend=False))
        start, end = edge[::2], edge[1::2]
        doc_start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        tokens = np.diff(np.searchsorted(start, doc_start))
        longest = max((len(t) for t in self.terms), default=0) + 1
        alive = np.flatnonzero(end - start <= longest)
        at, state = start[alive], np.zeros(len(alive), np.int32)
        hits, codes = [], []
        while len(alive):
            state = self.moves[state, cls[cp[at]]]
            at = at + 1
            live = state >= 0
            alive, at, state = alive[live], at[live], state[live]
            over = at == end[alive]
            code = self.accept[state[over]]
            hits.append(alive[over][code >= 0])
            codes.append(code[code >= 0])
            alive, at, state = alive[~over], at[~over], state[~over]
        hit = np.concatenate([np.zeros(0, np.int64), *hits])
        code = np.concatenate([np.zeros(0, np.int32), *codes])
        order = np.argsort(hit)
        hit, code = hit[order], code[order]
        doc = np.searchsorted(doc_start, start[hit], "right") - 1
        return doc, start[hit] - doc_start[doc], end[hit] - doc_start[doc], code, tokens


def context(text: str, start: int, end: int) -> int:
    """0 plain, 1 directed, 2 quoted."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if QUOTES.search(before) and QUOTES.search(after) or REPORTING.search(before) or REPORTING.search(after):
        return 2
    return 1 if DIRECTED.search(before) or DIRECTED.search(after) else 0


N_FEATURES = 6


def doc_features(texts: list[str], automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """One row for each text: sums of hit weights by context, distinct terms, density, any."""
    out = np.zeros((len(texts), N_FEATURES))
    lower = [t.lower() for t in texts]
    for lo, hi in chunks(lower):
        doc, start, end, code, tokens = automaton.scan(lower[lo:hi])
        terms: dict[int, set[int]] = {}
        for d, s, e, c in zip(doc.tolist(), start.tolist(), end.tolist(), code.tolist(), strict=True):
            row = out[lo + d]
            row[context(lower[lo + d], s, e)] += weights[c]
            row[4] += 1 / max(int(tokens[d]), 1)
            row[5] = 1
            terms.setdefault(lo + d, set()).add(c >> 1)
        for d, found in terms.items():
            out[d, 3] = len(found)
    out[:, :4] = np.log1p(out[:, :4])
    out[:, 4] = np.log1p(100 * out[:, 4])
    return out


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps; ``n`` says how often each row stands."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _vocabulary(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): rows of either class with each word; summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = list(count[0].keys() | count[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in count)], ["word", "n0", "n1"])
            for c in count:
                c.clear()
            return out

        count = (Counter(), Counter())
        for batch in small(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[y].update(set(TOKEN.findall((text or "").lower())))
            if len(count[0]) + len(count[1]) > 200_000:
                yield flush()
        yield flush()

    return rows.select("text", "_y").mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def lexicon(train: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """Log odds of the words that pass the thresholds."""
    support = max(3, round(0.002 * n1))
    ours, theirs = F.col("n1"), F.col("n0")
    odds = F.log((ours + 0.5) / (n1 - ours + 0.5)) - F.log((theirs + 0.5) / (n0 - theirs + 0.5))
    error = F.sqrt(1 / (ours + 0.5) + 1 / (theirs + 0.5) + 1 / (n1 - ours + 0.5))
    words = _vocabulary(train).where((F.length("word") > 2) & (ours >= support)).withColumn("odds", odds)
    words = words.where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("odds") - 1.64 * error >= MIN_LOWER))
    return dict(words.select("word", "odds").collect())


class Model:
    def __init__(self, automaton: Automaton, term_weights: np.ndarray, weights: np.ndarray):
        self.automaton, self.term_weights, self.weights = automaton, term_weights, weights

    def score(self, texts: list[str]) -> np.ndarray:
        z = doc_features(texts, self.automaton, self.term_weights) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, target: Column, rows: int = TRAIN_ROWS) -> Model:
    ids = training_ids(labels, target, rows)
    train = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "_y")
    sizes = dict(train.groupBy("_y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    log_odds = {s: MIN_LOG_ODDS for s in SEEDS}
    if n1 and n0:
        log_odds |= lexicon(train, n0, n1)
    terms = sorted(log_odds)
    weights = np.array([log_odds[t] * f for t in terms for f in (1.0, NEAR_WEIGHT)])
    fuzzy = [len(t) >= FUZZY_LENGTH for t in terms]
    if not (n1 and n0):
        prior = np.zeros(N_FEATURES + 1)
        prior[-1] = np.log((n1 + 0.5) / (n0 + 0.5))
        return Model(Automaton(terms, fuzzy), weights, prior)
    wide = Automaton(terms, fuzzy)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(terms), 2), np.int64)
        for batch in small(batches):
            texts = [(t or "").lower() for t in batch.column(0).to_pylist()]
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for lo, hi in chunks(texts):
                doc, _, _, code, _ = wide.scan(texts[lo:hi])
                pairs = np.unique(np.stack([doc[code & 1 == 1], code[code & 1 == 1] >> 1], 1), axis=0)
                np.add.at(count, (pairs[:, 1], y[lo:hi][pairs[:, 0]]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(count[:, 0]), pa.array(count[:, 1])], ["t", "clean", "toxic"])

    spelled = {r[0]: (r[1], r[2]) for r in train.mapInArrow(near, "t long, clean long, toxic long").groupBy("t").agg(F.sum("clean"), F.sum("toxic")).collect()}
    for i in range(len(terms)):
        clean, toxic = spelled.get(i, (0, 0))
        fuzzy[i] = fuzzy[i] and (toxic + 0.5) / n1 >= 10 * (clean + 0.5 * (clean > 0)) / n0
    automaton = Automaton(terms, fuzzy)

    def rowwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = doc_features([t or "" for t in batch.column(0).to_pylist()], automaton, weights)
            yield pa.RecordBatch.from_arrays([batch.column(1), _pack(x)], ["y", "x"])

    # Equal rows meet before they reach the driver, and of different ones no more than ``rows`` do.
    met = train.mapInArrow(rowwise, "y int, x binary").groupBy("y", "x").agg(F.count("*").alias("n")).orderBy(F.xxhash64("x", "y"), "x", "y").limit(rows).toArrow()
    x = np.frombuffer(b"".join(met.column(1).to_pylist()), float).reshape(-1, N_FEATURES)
    y, n = (np.array(met.column(c).to_pylist(), float) for c in ("y", "n"))
    return Model(automaton, weights, logistic(x, y, n))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learned only from rows that are not held out.

    The model that executors receive, terms and their automaton, is bounded by the rows that are learned from.
    """
    model = learn(docs, labels, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            score = shared.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, term, edits, context) of every hit, in code points of the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t or "").lower() for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            rows = []
            for lo, hi in chunks(texts):
                doc, start, end, code, _ = shared.value.scan(texts[lo:hi])
                for d, s, e, c in zip(doc.tolist(), start.tolist(), end.tolist(), code.tolist(), strict=True):
                    rows.append((ids[lo + d], s, e, shared.value.terms[c >> 1], c & 1, context(texts[lo + d], s, e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "start", "end", "term", "edits", "context"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, term string, edits long, context long")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
