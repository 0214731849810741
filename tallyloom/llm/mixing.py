"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains.  Distributed projected-gradient least squares
then finds nonnegative rates r for the documents so that the expected tokens of each domain, the sum of r * tokens * posterior, match
the targets.  A step moves each document's rate by the inner product of its posterior with one vector y of a number a domain:
the gradient of the squares, with the documents weighted by 1 / tokens and the step scaled by the Gram matrix of those with positive
rates.  The rates follow from the vectors so far, so that only these, some numbers each, go to the executors; a pass over the
documents' posteriors returns sums of a few numbers.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, cut, keep_columns, sliced
from .ftrl import dense, fit, scores
from .kernels import encode

PASSES = 200
TOLERANCE = 1e-4
#: Rates are rounded to a multiple of this before copies are drawn.
GRID = 0.05


def rates(p: np.ndarray, steps: np.ndarray, ahead: float = 0.0) -> np.ndarray:
    """The rates of documents with posteriors p after the steps so far, from 1. A step is a vector y and a momentum; ahead extends the
    last move by such a momentum, without a step."""
    r = before = np.ones(len(p))
    for *y, momentum in steps:
        r, before = np.maximum(0.0, r + momentum * (r - before) - p @ np.array(y)), r
    return r + ahead * (r - before)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """docs: doc_id, text. labelled: doc_id, domain (others than `domains` and nulls are left out; of several the first by name counts).
    Returns doc_id, th (md5 of the text), n_tokens (words), p (array<double>, one a domain, in sum 1)."""
    known = keep_columns(labelled, "doc_id", "domain").where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    y = F.array(*((F.col("domain") == d).cast("double") for d in domains))
    model = fit(keep_columns(docs, "doc_id", "text"), known.select("doc_id", y.alias("y")), len(domains), gaps=True)

    def run(batches):
        bias, w = dense(model.value)
        used = w.any(1)
        for batch in sliced(batches):
            p, words = scores([encode(t) for t in column(batch, "text").to_pylist()], bias, w, used, gaps=True)
            yield {"doc_id": column(batch, "doc_id"), "th": column(batch, "th"), "n_tokens": words, "p": list(p / p.sum(1, keepdims=True))}

    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return arrow_map(keyed, run, "doc_id long, th string, n_tokens long, p array<double>")


def _stack(batch) -> np.ndarray:
    return np.stack(column(batch, "p").to_numpy(zero_copy_only=False)) if len(batch) else np.zeros((0, 1))


def fit_rates(members: DataFrame, targets: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """members: n_tokens, p. The steps whose rates bring the domains' expected tokens as near to the targets as can be.

    Steps scaled by the Gram matrix of the positive rates solve the squares at once where no rate meets its bound; when one does not
    bring them down, plain projected gradient steps with momentum follow, whose limit is the least of the squares, and then another. That
    `passes` do not suffice is warned of.
    """
    d = len(targets)

    def total(steps: np.ndarray, ahead: float = 0.0):
        def run(batches):
            here, there, gram = np.zeros(d), np.zeros(d), np.zeros((d, d))
            for batch in batches:
                if len(batch):
                    p, t = _stack(batch), column(batch, "n_tokens").to_numpy(zero_copy_only=False).astype(float)
                    r = rates(p, steps)
                    here += (r * t) @ p
                    there += (rates(p, steps, ahead) * t) @ p if ahead else (r * t) @ p
                    on = r > 0
                    gram += (p[on] * t[on, None]).T @ p[on]
            yield {"here": [here], "there": [there], "gram": [gram.ravel()]}

        rows = arrow_map(members, run, "here array<double>, there array<double>, gram array<double>")
        names = [F.col(c)[i] for c, n in (("here", d), ("there", d), ("gram", d * d)) for i in range(n)]
        x = np.array([0.0 if v is None else v for v in rows.agg(*map(F.sum, names)).first()])
        return x[:d], x[d : 2 * d], x[2 * d :].reshape(d, d)

    steps, scale = np.zeros((0, d + 1)), max(1.0, np.abs(targets).max())
    here, there, gram = total(steps)
    bound = np.linalg.eigvalsh(gram)[-1]  # of the curvature, with all documents in
    curvature, momentum, age = bound, 0.0, 1.0
    rest = 0  # plain steps until the next scaled one is tried
    for _ in range(passes):
        gap = here - targets
        loss = gap @ gap
        if np.abs(gap).max() <= TOLERANCE * scale or bound <= 0:
            break
        rest -= 1
        if rest < 0:
            y = np.linalg.solve(gram + 1e-3 * max(np.linalg.eigvalsh(gram)[-1], 1e-9 * bound) * np.eye(d), gap)
            trial = np.vstack([steps, [*y, 0.0]])
            after = total(trial)
            if np.sum((after[0] - targets) ** 2) < 0.7 * loss:
                steps, (here, there, gram) = trial, after
                momentum, age = 0.0, 1.0
                continue
            rest = 6
        older, next_age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        trial = np.vstack([steps, [*((there - targets) / curvature), momentum]])
        after = total(trial, (older - 1) / next_age)
        now = np.sum((after[0] - targets) ** 2)
        if now < loss:
            steps, (here, there, gram) = trial, after
            momentum, age = (older - 1) / next_age, next_age
            curvature = min(bound, 1.2 * np.linalg.eigvalsh(gram)[-1])  # of those with positive rates: the others stay where they are
            if loss - now < 1e-6 * loss:
                break
        elif momentum:  # start the momentum anew
            momentum, age, there = 0.0, 1.0, here
        elif curvature < bound:
            curvature = min(bound, 4 * curvature)
        else:
            break
    else:
        warnings.warn(f"{passes} passes did not bring the domains' tokens to their targets or to the least of the squares", stacklevel=2)
    return steps


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep_whole: str | None = None, grid: float = GRID) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns doc_id, th (md5 of the text), n_tokens, p, rate (double) and copies (int),
    a row for each row.

    weights: the domains' shares of the mixture's tokens. Its size is that at which the domain keep_whole keeps its expected tokens (no
    domain named: the documents' own size). copies is the rate, rounded to `grid`, with its fraction drawn by a hash of doc_id and text,
    so that equal rows get equal copies and every run draws alike. Null texts have no tokens and the bias's posterior. Targets that
    no rates reach are met as nearly as the squares allow. Empty tables give an empty result.
    """
    domains = sorted(weights)
    members = cut(posteriors(keep_columns(docs, "doc_id", "text"), labelled, domains))
    sums = members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(len(domains)))).first()
    own = np.array([float(v or 0) for v in sums])
    shares = np.array([weights[x] for x in domains]) / sum(weights.values())
    size = own.sum() if keep_whole is None else own[domains.index(keep_whole)] / shares[domains.index(keep_whole)]
    steps = fit_rates(members, shares * size)

    def run(batches):
        for batch in batches:
            yield {c: column(batch, c) for c in ("doc_id", "th", "n_tokens", "p")} | {"rate": rates(_stack(batch), steps) if len(batch) else []}

    rated = arrow_map(members, run, "doc_id long, th string, n_tokens long, p array<double>, rate double")
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "th"), F.lit(1 << 20)) / (1 << 20)
    return rated.withColumn("copies", F.floor(F.round(F.col("rate") / grid) * grid + chance).cast("int"))


def take_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix() says; all columns, of whatever name."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    chosen = mixed.select(key.alias("id"), "th", "copies").dropDuplicates(["id", "th"]).where("copies > 0")
    rows = docs.select(key.alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(chosen, ["id", "th"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
