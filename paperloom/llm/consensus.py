"""Consensus of several annotators' labels: mean-field variational confusion model.

Each item has a hidden class, each annotator a confusion matrix with a Dirichlet prior on
every row, and each collection a Dirichlet prior on its class shares, centred on the
corpus's shares. The updates are group-bys: an annotator's expected counts, and from them
digamma expectations of the log confusion; an item's sum of those over its labels, and
from it the posterior of its class. ``digamma`` is a Column expression, so every round
runs in the JVM. Rounds go on until the bound of the variational objective stands still.

The labels are hash-partitioned and sorted by item once and kept; a round is one job: it joins the
annotators' expectations, sums them over the item in a window that needs neither shuffle nor sort,
and combines on the map side to one row per annotator and one per collection. While those are at
most ``DRIVER_ROWS`` they pass through the driver and are broadcast; beyond, they are written to the
checkpoint folder and joined by hash. An item has at most one row per annotator.

Defined results: an annotator's current label is the latest by time (of equal times the
greater label, in the order include, exclude, maybe, none); a current label without an
answer does not count; rows with a null collection, item or annotator are left out;
repeated rows count once; items below ``min_raters`` inform the annotators' matrices but
get no consensus; an empty table gives no rows; equal posteriors go to the earlier class.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import durable, release, task_target

CLASSES = ("include", "exclude", "maybe")
DRIVER_ROWS = 100_000
DRAWS = 4_000

#: Dirichlet priors: on a confusion row's diagonal and off it, and the weight of the corpus's shares in a collection's.
DIAGONAL, OFF_DIAGONAL, COLLECTION_WEIGHT = 6.0, 1.0, 30.0


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: the recurrence up to x + 6, then the asymptotic series."""
    y = x + 6.0
    inv2 = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    for i in range(6):
        series = series - 1.0 / (x + float(i))
    return series


def normal_decision(raw: Column) -> Column:
    """The class number of a spelling, null for no answer."""
    bare = F.lower(F.regexp_replace(raw, "[^A-Za-z]", ""))
    return (
        F.when(bare.rlike("^incl?(u(d(e[ds]?)?)?)?$|^yes$"), 0)
        .when(bare.rlike("^excl?(u(d(e[ds]?)?)?)?$|^no$"), 1)
        .when(bare.rlike("^may ?be$|^unsure$|^uncertain$|^unclear$"), 2)
    )


def current_labels(screenings: DataFrame) -> DataFrame:
    """(c, p, u, y): each annotator's latest answer for an item; rows without one are gone."""
    s = screenings.select(
        F.col("collection_id").alias("c"),
        F.col("paper_id").alias("p"),
        F.col("user_id").alias("u"),
        F.struct(F.col("decided_at").alias("at"), F.coalesce(normal_decision(F.col("decision")), F.lit(3)).alias("y")).alias("said"),
    ).where("c is not null and p is not null and u is not null")
    return s.groupBy("c", "p", "u").agg(F.max("said").alias("said")).select("c", "p", "u", F.col("said.y").alias("y")).where("y < 3")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: the recurrence up to x + 6, then Stirling's series."""
    y = x + 6.0
    inv2 = 1.0 / (y * y)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680))) / y
    for i in range(6):
        series = series - F.log(x + float(i))
    return series


@dataclass
class Consensus:
    items: DataFrame  # c, p, raters, decision, confidence, agreement
    annotators: DataFrame  # u, labels, reliability, low, high
    converged: bool
    rounds: int


def _each(values: list[Column], function) -> Column:
    """An array of ``function`` of values; the expression stands once in the plan, whatever their number."""
    return F.transform(F.array(*values), function)


def _divergence(n: list[Column], prior: list[Column]) -> tuple[list[Column], Column]:
    """Expected logs under Dirichlet(prior + n), and its divergence from Dirichlet(prior)."""
    a = [x + y for x, y in zip(n, prior, strict=True)]
    total, total0 = sum(a[1:], a[0]), sum(prior[1:], prior[0])
    psi = _each([*a, total], digamma)
    expected = [psi[k] - psi[len(a)] for k in range(len(a))]
    gammas = _each([total, *prior, total0, *a], log_gamma)
    m = len(a)
    kl = gammas[0] - gammas[m + 1] + sum((gammas[1 + k] - gammas[m + 2 + k] + n[k] * expected[k] for k in range(m)), F.lit(0.0))
    return expected, kl


def fit_consensus(labels: DataFrame, max_rounds: int = 200, tolerance: float = 1e-6, min_raters: int = 3) -> Consensus:
    """Rounds until the bound changes by at most ``tolerance`` of itself; a fit that is cut off by ``max_rounds`` warns and says so in ``converged``."""
    spark = labels.sparkSession
    ratings = labels.repartition(task_target(spark, 1), "c", "p").sortWithinPartitions("c", "p").persist()
    item = Window.partitionBy("c", "p")
    raters = F.count(F.lit(1)).over(item).alias("raters")

    def first_guess() -> DataFrame:
        votes = ratings.select("c", "p", "u", "y", raters, *[F.sum((F.col("y") == k).cast("double")).over(item).alias(f"v{k}") for k in range(3)])
        return votes.select("c", "p", "u", "y", "raters", *[((F.col(f"v{k}") + 0.2) / (F.col("raters") + 0.6)).alias(f"q{k}") for k in range(3)], F.lit(0.0).alias("bound"))

    # every expression is built once and used in each round
    summed = [(F.sum(F.get("e", F.col("y") * 3 + k)).over(item) + F.col("prior")[k]).alias(f"z{k}") for k in range(3)]
    raised = [F.exp(F.col(f"z{k}") - F.col("m")).alias(f"x{k}") for k in range(3)]
    chances = [(F.col(f"x{k}") / F.col("t")).alias(f"q{k}") for k in range(3)]
    top, weight, part = F.greatest("z0", "z1", "z2"), F.col("x0") + F.col("x1") + F.col("x2"), (F.col("m") + F.log("t")).alias("bound")
    sums = [F.sum(F.when(F.col("y") == j, F.col(f"q{k}")).otherwise(0.0)).alias(f"n{k}{j}") for k in range(3) for j in range(3)]
    sums += [F.sum(F.col(f"q{k}") / F.col("raters")).alias(f"w{k}") for k in range(3)] + [F.sum(F.col("bound") / F.col("raters")).alias("bound")]
    rows = [_divergence([F.col(f"n{k}{j}") for j in range(3)], [F.lit(DIAGONAL if j == k else OFF_DIAGONAL) for j in range(3)]) for k in range(3)]
    confusion, confusion_kl = F.array(*[rows[k][0][j] for j in range(3) for k in range(3)]).alias("e"), (rows[0][1] + rows[1][1] + rows[2][1]).alias("kl")
    shares, shares_kl = _divergence([F.col(f"w{k}") for k in range(3)], [F.col(f"a{k}") for k in range(3)])
    shares, shares_kl = F.array(*shares).alias("prior"), shares_kl.alias("kl")

    def posterior(annotators: DataFrame, collections: DataFrame) -> DataFrame:
        """The labels, each with the chances of its item's classes and the item's part of the bound."""
        met = ratings.join(sized(annotators.select("u", "e")), "u").join(sized(collections.select("c", "prior")), "c")
        said = met.select("c", "p", "u", "y", raters, *summed).withColumn("m", top)
        return said.select("*", *raised).withColumn("t", weight).select("c", "p", "u", "y", "raters", *chances, part)

    def maximise(said: DataFrame) -> DataFrame:
        """One row per annotator (n{class}{label}: expected counts) and one per collection (w{class}: items, bound)."""
        return said.groupingSets([["u"], ["c"]], "u", "c").agg(*sums)

    def expect(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(u, e, kl): expected log confusions, three classes for each label; (c, prior, kl): expected log shares."""
        held = counts.where("c is not null")
        share = totals(held, "w0", "w1", "w2")
        prior = [F.lit(COLLECTION_WEIGHT * (w + 1) / (sum(share) + 3)).alias(f"a{k}") for k, w in enumerate(share)]
        return settle(counts.where("u is not null").select("u", confusion, confusion_kl)), settle(held.select("c", "w0", "w1", "w2", *prior).select("c", shares, shares_kl))

    counts = durable(maximise(first_guess()))
    few = counts.count() <= DRIVER_ROWS
    sized = F.broadcast if few else (lambda d: d)

    def settle(df: DataFrame) -> DataFrame:
        return spark.createDataFrame(df.toArrow()) if few else durable(df)

    def totals(df: DataFrame, *columns: str) -> list[float]:
        held = df.select(*columns).collect() if few else [df.agg(*[F.sum(c) for c in columns]).first()]
        return [float(sum(r[i] or 0.0 for r in held)) for i in range(len(columns))]

    first = counts
    if few:
        counts = settle(counts)
    before, converged, done = None, False, 0
    while not converged and done < max_rounds:
        annotators, collections = expect(counts)
        counts, old = settle(maximise(posterior(annotators, collections))), counts
        bound = totals(counts.where("c is not null"), "bound")[0] - totals(annotators, "kl")[0] - totals(collections, "kl")[0]
        converged = before is not None and abs(bound - before) <= tolerance * max(1.0, abs(bound))
        before, done = bound, done + 1
        if not converged and done < max_rounds:
            for table in (annotators, collections, old):
                release(table)
    if not converged:
        warnings.warn(f"the bound still moves after {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    # the posterior under which ``counts`` were summed
    votes = [F.count_if(F.col("y") == k).alias(f"v{k}") for k in range(3)]
    held = posterior(annotators, collections).groupBy("c", "p").agg(F.first("raters").alias("raters"), *[F.first(f"q{k}").alias(f"q{k}") for k in range(3)], *votes)
    best = F.greatest("q0", "q1", "q2")
    decision = F.when(F.col("q0") >= best, CLASSES[0]).when(F.col("q1") >= best, CLASSES[1]).otherwise(CLASSES[2])
    same = sum((F.col(f"v{k}") * (F.col(f"v{k}") - 1) for k in range(1, 3)), F.col("v0") * (F.col("v0") - 1))
    items = durable(
        held.where(F.col("raters") >= min_raters).select("c", "p", "raters", decision.alias("decision"), best.alias("confidence"), (same / (F.col("raters") * (F.col("raters") - 1))).alias("agreement"))
    )
    ratings.unpersist()
    release(first)
    return Consensus(items, _reliability(counts.where("u is not null")), converged, done)


def _reliability(annotators: DataFrame) -> DataFrame:
    """Posterior mean and 95 % quantiles of an annotator's chance to be right, over the classes seen.

    The chance is a weighted sum of one Beta variable per class; its quantiles come from ``DRAWS`` draws, seeded by the annotator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b[[f"n{k}{j}" for k in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
            row, right = n.sum(2), n[:, range(3), range(3)]
            weight = row / np.maximum(row.sum(1, keepdims=True), 1e-300)
            a, c = right + DIAGONAL, row - right + 2 * OFF_DIAGONAL
            ends = np.empty((len(b), 2))
            for i, u in enumerate(b["u"]):
                draws = np.random.default_rng(abs(hash(int(u)))).beta(a[i], c[i], (DRAWS, 3)) @ weight[i]
                ends[i] = np.quantile(draws, [0.025, 0.975])
            yield pd.DataFrame({"u": b["u"], "labels": row.sum(1), "reliability": (weight * a / (a + c)).sum(1), "low": ends[:, 0], "high": ends[:, 1]})

    return annotators.drop("c").mapInPandas(run, "u long, labels double, reliability double, low double, high double")


def krippendorff(labels: DataFrame) -> DataFrame:
    """(c, items, values, alpha): nominal agreement per collection, over items with two labels or more."""
    votes = labels.groupBy("c", "p").agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("y") == k).alias(f"v{k}") for k in range(3)]).where("m > 1")
    same = sum((F.col(f"v{k}") * (F.col(f"v{k}") - 1) for k in range(1, 3)), F.col("v0") * (F.col("v0") - 1)) / (F.col("m") - 1)
    totals = votes.groupBy("c").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("m").alias("values"),
        F.sum(F.col("m") - same).alias("apart"),
        *[F.sum(f"v{k}").alias(f"v{k}") for k in range(3)],
    )
    n = F.col("values")
    chance = (n * n - sum((F.col(f"v{k}") * F.col(f"v{k}") for k in range(1, 3)), F.col("v0") * F.col("v0"))) / (n - 1)
    return totals.select("c", "items", "values", F.when(chance > 1e-12, 1 - F.col("apart") / chance).alias("alpha"))
