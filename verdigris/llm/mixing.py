"""Mixing sources to target weights by soft membership.

A classifier learned from the labelled table gives every document posteriors p over domains.  Document rates r >= 0
are then fitted by projected gradient descent on the weighted least squares
``sum_k (sum_d r_d n_d p_dk - T_k)**2 / S_k``, with n_d the tokens (words) of a document, S_k the domain's expected
tokens at rate one and T_k = weight_k * total.  In the metric of token counts a step is
``r_d <- max(0, r_d - p_d . g)`` with ``g_k = (sum_d r_d n_d p_dk - T_k) / S_k``; its step size one is safe, as the
matrix D^-1 M of that problem is stochastic.  Momentum, dropped where the squares would grow, speeds it up.  A rate
follows from p_d and the list of all g so far, so each round is one aggregate over a compact table, and nothing of
documents' size is kept between rounds.

For a draw without repeats (``slack``) the total follows from the domain of the greatest weight: it is to be used up,
``slack`` times over.  No rate and no domain's target is then above ``slack`` times what there is, and no rate of a
document that this domain fits best is below one, so that a scarce domain falls short of its share instead of thinning
the others.

Defined results: a null text counts as empty (no tokens; its rate follows from the prior); repeated rows count as
often as they occur; a domain without expected tokens is left out of the fit; a fit that does not meet its
targets says by how much (``residual``); without labels all rates are equal; an
empty table gives an empty result; only named columns are read, and ``draw`` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subword
from .chars import small
from .tables import cut, few, free, in_arrow, named, table

#: Domains of the labelled table, in the order of the classes.
DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
ROUNDS = 100
TOLERANCE = 1e-4


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The class of a labelled row; null if it has neither label."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 0)


def rates_of(p: np.ndarray, steps: np.ndarray, slack: float | None = None, main: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next gradient) after the steps, each of which is g and, last, the momentum that follows it.
    With ``slack``: at most that, and at least one for documents that ``main`` fits best."""
    r = y = np.ones(len(p))
    least = 0.0 if slack is None else (p.argmax(1) == main).astype(float)
    for *g, momentum in steps:
        r, last = np.clip(y - p @ np.array(g), least, slack), r
        y = r + momentum * (r - last)
    return r, y


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


class Fit(NamedTuple):
    """Steps (g and the momentum after each), the tokens asked of each domain, the tokens that the rates give, and the largest difference of the two as
    a share of the total: what the fit could not meet, or had not met after ``ROUNDS`` rounds."""

    steps: np.ndarray
    goal: np.ndarray
    reached: np.ndarray
    residual: float


def fit_rates(members: DataFrame, weights: list[float], total: float | None = None, slack: float | None = None) -> Fit:
    """``members``: ``p`` (array) and ``n_words``.  ``total``: tokens to draw, by default as many as there are; with
    ``slack``, that factor (one at least) times what uses up the domain of the greatest weight, and no rate is above it."""
    k, main = len(weights), int(np.argmax(weights))

    def sums(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain at the rates, and at the point of the next gradient."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros((2, k))
            for batch in small(batches):
                p = _matrix(batch.column(0), k)
                got += np.stack([(r * batch.column(1).to_numpy()) @ p for r in rates_of(p, steps, slack, main)])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got.ravel()], names=[f"s{i}" for i in range(2 * k)])

        out = members.select("p", "n_words").mapInArrow(run, ", ".join(f"s{i} double" for i in range(2 * k)))
        return tuple(np.array([x or 0.0 for x in out.agg(*[F.sum(f"s{i}") for i in range(2 * k)]).first()]).reshape(2, k))

    steps = np.zeros((0, k + 1))
    now, ahead = sums(steps)
    base = now
    live = base > 1e-9 * max(base.sum(), 1e-300)
    share = np.array(weights, float) * live
    if not live.any() or not share.sum():
        return Fit(steps, base, base, 0.0)
    share /= share.sum()
    whole = base.sum() if total is None else total
    if slack is not None:
        whole = slack * base[share.argmax()] / share.max()
    goal = whole * share if slack is None else np.minimum(whole * share, slack * base)
    cost = lambda x: (np.square(x - goal)[live] / base[live]).sum()
    speed = 1.0
    for _ in range(ROUNDS):
        if np.abs(now - goal)[live].max() <= TOLERANCE * whole:
            break
        g = np.where(live, (ahead - goal) / np.where(live, base, 1), 0.0)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        before = now
        now, ahead = sums(steps_ := np.vstack([steps, [*g, (speed - 1) / faster]]))
        if cost(now) > cost(before):  # the momentum has gone too far: start anew from here
            faster, steps_[-1, -1] = 1.0, 0.0
            ahead = now
        steps, speed = steps_, faster
        if slack is not None and np.abs(now - before).max() <= TOLERANCE * whole:
            break  # rates at their bounds: a goal that documents of mixed domains cannot meet
    return Fit(steps, goal, now, float(np.abs(now - goal).max() / whole))


def with_rates(members: DataFrame, steps: np.ndarray, keep: list[str], slack: float | None = None, main: int = 0) -> DataFrame:
    """Columns ``keep``, ``p``, ``n_words`` and ``rate``."""
    k, width = len(DOMAINS), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rate, _ = rates_of(_matrix(batch.column(width), k), steps, slack, main)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate, pa.float64())], names=[*batch.schema.names, "rate"])

    schema = T.StructType([*(members.schema[c] for c in keep), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("n_words", T.LongType()), T.StructField("rate", T.DoubleType())])
    return in_arrow(members.select(*map(named, keep), "p", "n_words"), run, schema)


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that follows from the id."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS, slack: float | None = None) -> DataFrame:
    """(doc_id, p, n_words, rate, residual) of every document; ``residual`` is that of the fit."""
    model = subword.fit(docs, labels, domain(), len(DOMAINS))
    members = cut(subword.posteriors(docs, model, ["doc_id"]))
    shares = [weights[d] for d in DOMAINS]
    fit = fit_rates(members, shares, slack=slack)
    return with_rates(members, fit.steps, ["doc_id"], slack, int(np.argmax(shares))).withColumn("residual", F.lit(fit.residual))


def draw(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Each document at most once: surely if its rate is one or more, else with its rate as the chance."""
    name = free(docs.columns, "out")
    out = rated.where((F.col("rate") < 1) & (chance(F.col("doc_id")) >= F.col("rate"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(few(out), docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and number of copies of every document: the whole part of its rate, and one more with the
    fraction as the chance; and the residual of the fit.  A token is a word, a run without blanks."""
    rated = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id",
        F.col("n_words").alias("n_tokens"),
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        "rate",
        "residual",
        F.floor(F.col("rate") + chance(F.col("doc_id"))).alias("copies"),
    )
