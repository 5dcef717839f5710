"""Pairwise matches consolidated into groups by alternating star rewrites.

Large-star: every vertex links each larger neighbour to the smallest vertex of its
neighbourhood. Small-star: every vertex links its smaller neighbours and itself to the
smallest of them. Both keep connectivity; alternated until the edges stop changing they
leave each component as a star around its smallest identifier.

Each rewrite is one aggregation (smallest neighbour per vertex, combined on the map
side) and one join. A hub may own a third of all edges: vertices above ``hub_share`` of
the edges are at most 2 / ``hub_share``, so their labels are broadcast under that proven
bound and their edges are never shuffled by the hub's key; all others are joined by hash.
After every round the edges are written to the checkpoint folder.

Defined results: edges with a null end, self-links and repeated or reversed edges add
nothing; an empty input gives no rows; vertices need not exist in any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import durable, release

#: A vertex with more than this share of the edges is a hub; at most 2 / HUB_SHARE vertices can be.
HUB_SHARE = 1e-3
#: So few edges fit any one task even if they share one vertex.
ONE_TASK_EDGES = 1_000_000
MAX_ROUNDS = 60


def _relabel(directed: DataFrame, labels: DataFrame, n_edges: int, hub_share: float) -> DataFrame:
    """(u, v, m): each directed edge with its source's label, hubs apart."""
    if n_edges <= ONE_TASK_EDGES and hub_share >= HUB_SHARE:
        return directed.join(labels.select("u", "m"), "u")
    cut = max(1000, int(n_edges * hub_share))
    hubs = labels.where(F.col("degree") > cut).select("u", "m")
    rest = labels.where(F.col("degree") <= cut).select("u", "m")
    flagged = directed.join(F.broadcast(hubs.withColumnRenamed("m", "hub_m")), "u", "left")
    hot = flagged.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m"))
    cold = flagged.where(F.col("hub_m").isNull()).select("u", "v").join(rest, "u")
    return hot.unionByName(cold)


def _labels(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree")).select(
        "u", F.least("u", "low").alias("m"), "degree"
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame, n_edges: int, hub_share: float = HUB_SHARE) -> DataFrame:
    """Link every larger neighbour to the neighbourhood's smallest vertex."""
    directed = _both_ways(edges)
    out = _relabel(directed, _labels(directed), n_edges, hub_share)
    return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, n_edges: int, hub_share: float = HUB_SHARE) -> DataFrame:
    """Link the smaller neighbours and the vertex itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    labels = _labels(down)
    out = _relabel(down, labels, n_edges, hub_share).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(labels.select("u", F.col("m").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
    ).first()
    return row["n"], row["s"], row["x"]


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", hub_share: float = HUB_SHARE) -> DataFrame:
    """(id, group_id) for every vertex with at least one link to another one."""
    edges = durable(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    seen = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        grown = large_star(edges, seen[0], hub_share).where(F.col("u") != F.col("v")).distinct()
        shrunk = small_star(grown, seen[0], hub_share).where(F.col("u") != F.col("v")).distinct()
        edges, old = durable(shrunk), edges
        release(old)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return members.unionByName(roots)


def strong_links(pairs: DataFrame, threshold: float, similarity: str = "similarity") -> DataFrame:
    """The pairs whose score is a number at or above ``threshold``."""
    score = F.col(similarity)
    return pairs.where(score.isNotNull() & ~F.isnan(score) & (score >= threshold))
