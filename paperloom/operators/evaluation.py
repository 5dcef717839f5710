"""Retrieval and match quality: recall, percentiles with gates, weighted scores, kappa, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_at_k(exact: DataFrame, found: DataFrame, k: int, slack: float = 1e-9) -> DataFrame:
    """(query_id, recall): found ids among the exact k, or as near as its last; divided by k in any case."""
    edge = exact.where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("edge"))
    got = found.where(F.col("rank") <= k).join(edge, "query_id", "left")
    hit = got.join(exact.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("in_exact")), ["query_id", "id"], "left")
    good = F.col("in_exact").isNotNull() | F.col("edge").isNull() | (F.col("score") >= F.col("edge") - slack)
    by = hit.groupBy("query_id").agg((F.count_if(good) / F.lit(k)).alias("recall"))
    return exact.select("query_id").distinct().join(by, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def percentiles(samples: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99), beyond: int = 5) -> DataFrame:
    """(by, p, n, value): the nearest-rank percentile, null where fewer than ``beyond`` samples lie past it."""
    w = Window.partitionBy(*by)
    rows = samples.where(F.col(value).isNotNull()).withColumns({"at": F.row_number().over(w.orderBy(value)), "n": F.count(F.lit(1)).over(w)})
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.ceil(F.lit(p) * F.col("n")).alias("want")) for p in points]))
    picked = rows.select(*by, value, "at", "n", wanted.alias("w")).where(F.col("at") == F.col("w.want"))
    enough = F.round(F.col("n") * (1 - F.col("w.p")), 6) >= beyond
    return picked.select(*by, F.col("w.p").alias("p"), "n", F.when(enough, F.col(value)).alias("value"))


def stability(runs: DataFrame, value: str, by: list[str], most: float = 1.3) -> DataFrame:
    """(by, low, high, point): the median of runs that agree within ``most``, else null."""
    agg = runs.groupBy(*by).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(F.col(value).isNull()).alias("lost"), F.expr(f"percentile({value}, 0.5)").alias("mid")
    )
    ok = (F.col("lost") == 0) & (F.col("high") <= most * F.col("low"))
    return agg.select(*by, "low", "high", F.when(ok, F.col("mid")).alias("point"))


def paired_ratio(samples: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ratio): the median of the paired ratios."""
    r = samples.where((F.col(a) > 0) & (F.col(b) > 0)).select((F.col(a) / F.col(b)).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(r, 0.5)").alias("ratio"))


def weighted_prf(labels: DataFrame, population: DataFrame) -> DataFrame:
    """(precision, recall, f1) of (stratum, merged, same) labels weighted by each stratum's population per label."""
    n = labels.where(F.col("same").isNotNull()).groupBy("stratum").agg(F.count(F.lit(1)).alias("labelled"))
    w = n.join(population, "stratum").select("stratum", (F.col("population") / F.col("labelled")).alias("w"))
    rows = labels.where(F.col("same").isNotNull()).join(w, "stratum")
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    s = rows.agg(total(F.col("merged") & F.col("same")).alias("tp"), total(F.col("merged") & ~F.col("same")).alias("fp"), total(~F.col("merged") & F.col("same")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return s.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when((p > 0) & (r > 0), 2 * p * r / (p + r)), 6).alias("f1"))


def binary_kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(n, both, only_a, only_b, neither, kappa) of two yes-no columns."""
    rows = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    t = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(a) & F.col(b)).alias("both"),
        F.count_if(F.col(a) & ~F.col(b)).alias("only_a"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_b"),
        F.count_if(~F.col(a) & ~F.col(b)).alias("neither"),
    )
    n = F.col("n")
    po = (F.col("both") + F.col("neither")) / n
    ya, yb = (F.col("both") + F.col("only_a")) / n, (F.col("both") + F.col("only_b")) / n
    pe = ya * yb + (1 - ya) * (1 - yb)
    return t.select("*", F.when((n > 0) & (F.abs(1 - pe) >= 1e-12), F.round((po - pe) / (1 - pe), 4)).alias("kappa"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson's interval, rounded to four places; (0, 0) without trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), 4)).otherwise(0.0)
    high = F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), 4)).otherwise(0.0)
    return F.struct(low.alias("low"), high.alias("high"))


def convergence(lists: DataFrame, reference: DataFrame) -> DataFrame:
    """(depth, overlap, identical) of (depth, query_id, id) lists against one reference list per query."""
    ref = reference.select("query_id", "id").withColumn("hit", F.lit(1))
    size = reference.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    by = lists.join(ref, ["query_id", "id"], "left").groupBy("depth", "query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")).join(size, "query_id")
    return by.groupBy("depth").agg(F.avg(F.col("hits") / F.col("size")).alias("overlap"), F.avg(((F.col("hits") == F.col("size")) & (F.col("n") == F.col("size"))).cast("double")).alias("identical"))


def bootstrap_ratio(samples: DataFrame, a: str, b: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """(low, high): a 95 % interval of the mean paired ratio by the Poisson bootstrap, whose weights come from a hash."""
    r = samples.where((F.col(a) > 0) & (F.col(b) > 0)).select("id", (F.col(a) / F.col(b)).alias("r"))
    many = r.select("id", "r", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = F.pmod(F.xxhash64("id", "rep", F.lit(seed)), F.lit(1_000_000)) / 1e6
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)
    means = many.groupBy("rep").agg((F.sum(F.col("r") * weight) / F.sum(weight)).alias("m"))
    return means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def recall_by_group(exact: DataFrame, found: DataFrame, group: DataFrame, k: int) -> DataFrame:
    """(grp, wanted, hits, recall): the exact top k split by a property of the papers, and how much of each was found."""
    want = exact.where(F.col("rank") <= k).join(group, "id")
    got = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    by = want.join(got, ["query_id", "id"], "left").groupBy("grp").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
    return by.select("grp", "wanted", "hits", (F.col("hits") / F.col("wanted")).alias("recall"))


def bootstrap_precision(labels: DataFrame, population: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """(low, high): a 95 % interval of the weighted precision, labels drawn again within their stratum by hashed Poisson weights.

    ``labels`` are judged by people (stratum, merged, same), a bounded table; a stratum counts with its share of ``population``.
    """
    known = labels.where(F.col("same").isNotNull() & F.col("merged")).withColumn("row", F.xxhash64("stratum", "merged", "same", F.monotonically_increasing_id()))
    many = known.select("stratum", "same", "row", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = F.pmod(F.xxhash64("row", "rep", F.lit(seed)), F.lit(1_000_000)) / 1e6
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)
    by = many.groupBy("rep", "stratum").agg(F.sum(weight).alias("n"), F.sum(F.when(F.col("same"), weight).otherwise(0)).alias("hits")).where("n > 0")
    share = by.join(population, "stratum").groupBy("rep").agg((F.sum(F.col("hits") / F.col("n") * F.col("population")) / F.sum("population")).alias("p"))
    return share.agg(F.expr("percentile(p, 0.025)").alias("low"), F.expr("percentile(p, 0.975)").alias("high"))
