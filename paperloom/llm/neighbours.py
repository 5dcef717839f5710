"""The k most similar vectors of every vector, through a hierarchical k-means tree.

1. A tree of unit centroids is fitted on a bounded sample (``fit_rows``; at most
   ``fit_rows * dim * 4`` bytes on the driver) by splitting nodes with spherical k-means,
   and broadcast.
2. One pass over all rows walks the tree best bin first: a priority queue holds the
   unopened nodes by similarity, leaves are visited in the order they are popped. The pass
   counts rows and visits per leaf, and scores every row against ``calibration_rows``
   sample queries, so that it also yields their exact neighbours.
3. The number of leaves a query visits is widened until the calibration queries'
   recall reaches ``recall_target``; past ``max_visits`` the pass is repeated with more.
4. Every row is stored in its first leaf and sent as a query to the leaves it visits;
   a (leaf, block) task compares exactly, by one matrix product, and keeps the best k of
   each query. A second small aggregation merges a query's leaves. Leaves above
   ``block_rows`` stored rows or ``query_rows`` visits are split into blocks of known
   size, so no task holds an unbounded group.

Exact copies of a vector are collapsed first to one representative with its k + 1
smallest ids (salted, two stages), so a group of copies holding a third of all rows
stays one indexed row.

Defined results: a vector that is null, of another length, all zero or not finite is not
indexed and has no neighbours; vectors are compared at unit length; equal similarities
rank by the smaller id; repeated ids count once; fewer than k other rows give fewer
neighbours; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import durable, spread

BROADCAST_ROWS = 200_000


class VectorTree:
    """Centroids in levels; ``first``/``count`` give a node's children, leaves have none."""

    def __init__(self, centroids: np.ndarray, first: np.ndarray, count: np.ndarray, roots: int):
        self.centroids, self.first, self.count, self.roots = centroids, first, count, roots
        self.leaf_no = np.cumsum(count == 0) - 1
        self.n_leaves = int((count == 0).sum())

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, fanout: int = 32, seed: int = 7) -> VectorTree:
        rng = np.random.default_rng(seed)
        nodes: list[np.ndarray] = []
        first: list[int] = []
        count: list[int] = []

        def add(centroids: np.ndarray) -> int:
            start = len(nodes)
            nodes.extend(centroids)
            first.extend([0] * len(centroids))
            count.extend([0] * len(centroids))
            return start

        def split(rows: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
            k = max(1, min(want, len(rows)))
            centre = rows[rng.choice(len(rows), k, replace=False)].copy()
            for _ in range(8):
                of = (rows @ centre.T).argmax(1)
                order = np.argsort(of, kind="stable")
                used, starts = np.unique(of[order], return_index=True)
                total = np.add.reduceat(rows[order], starts)
                centre[used] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            return centre, (rows @ centre.T).argmax(1)

        todo: list[tuple[int, np.ndarray, int]] = []
        centre, of = split(sample, min(fanout, leaves))
        start = add(centre)
        roots = len(centre)
        share = leaves / max(1, len(sample))
        for i in range(len(centre)):
            todo.append((start + i, sample[of == i], round(share * int((of == i).sum()))))
        while todo:
            node, rows, want = todo.pop()
            if want <= 1 or len(rows) <= 1:
                continue
            centre, of = split(rows, min(want, fanout * 2))
            start = add(centre)
            first[node], count[node] = start, len(centre)
            if want > fanout * 2:
                for i in range(len(centre)):
                    n = int((of == i).sum())
                    todo.append((start + i, rows[of == i], round(want * n / len(rows))))
        return cls(np.array(nodes, np.float32).reshape(len(nodes), -1), np.array(first), np.array(count), roots)

    def visit(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves of each vector, best bin first; -1 where there are fewer."""
        out = np.full((len(vectors), visits), -1, np.int32)
        top = -(vectors @ self.centroids[: self.roots].T)
        first, count, leaf_no, centroids = self.first.tolist(), self.count.tolist(), self.leaf_no.tolist(), self.centroids
        for r, x in enumerate(vectors):
            heap = [(s, n) for n, s in enumerate(top[r].tolist())]
            heapq.heapify(heap)
            found = 0
            while heap and found < visits:
                _, node = heapq.heappop(heap)
                if not count[node]:
                    out[r, found] = leaf_no[node]
                    found += 1
                    continue
                lo = first[node]
                for i, s in enumerate((centroids[lo : lo + count[node]] @ x).tolist()):
                    heapq.heappush(heap, (-s, lo + i))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    m = flat.reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the rows whose vector has ``dim`` finite entries, not all zero."""
    v = F.col(vec_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(
        F.col(id_col).isNotNull() & (F.size(v) == dim) & sound & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vec"))


def copy_groups(vectors: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """(h1, h2, n, members): groups of equal vectors with their ``keep`` smallest ids."""
    hashed = vectors.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(salts))
    )
    within = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    sizes = hashed.groupBy("h1", "h2", "salt").agg(F.count_distinct("id").alias("n"))
    repeated = sizes.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1")
    low = hashed.distinct().withColumn("at", F.row_number().over(within)).where(F.col("at") <= keep)
    members = (
        low.join(repeated, ["h1", "h2"])
        .groupBy("h1", "h2", "n")
        .agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("members"))  # at most salts * keep ids
    )
    return members


def nearest_neighbours(
    rows: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    dim: int = 384,
    k: int = 5,
    recall_target: float = 0.99,
    fit_rows: int = 20_000,
    leaf_rows: int = 192,
    calibration_rows: int = 256,
    max_visits: int = 8,
    block_rows: int = 8192,
    query_rows: int = 32_768,
) -> DataFrame:
    """(id, neighbour, similarity, rank): the k nearest other rows of every row."""
    spark = rows.sparkSession
    vectors = usable_vectors(rows, id_col, vec_col, dim)
    groups = durable(copy_groups(vectors, k + 1))
    n_groups = groups.count()
    sized = (lambda d: F.broadcast(d)) if n_groups <= BROADCAST_ROWS else (lambda d: d)
    base = vectors
    if n_groups:
        keyed = vectors.withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")})
        marked = keyed.join(sized(groups), ["h1", "h2"], "left")
        base = marked.where(F.col("members").isNull() | (F.col("id") == F.col("members")[0])).select("id", "vec")
        base = base.dropDuplicates(["id"])
    total = base.count()
    out_schema = "id long, neighbour long, similarity float, rank int"
    if total == 0:
        return spark.createDataFrame([], out_schema)

    def sample(n: int, seed: int) -> np.ndarray:
        share = min(1.0, (1.3 * n + 50) / total)
        chosen = F.xxhash64("id", F.lit(seed))  # by hash, so that any partitioning gives the same sample in the same order
        picked = base.where(F.pmod(chosen, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(chosen, "id").limit(n)
        t = picked.select("id", "vec").toArrow().combine_chunks()
        return t["id"].to_numpy(), _matrix(t["vec"].combine_chunks(), dim)

    _, fit = sample(fit_rows, 1)
    tree = VectorTree.fit(fit, leaves=max(1, min(total // leaf_rows, len(fit) // 8)))
    query_ids, queries = sample(calibration_rows, 2)
    shared = spark.sparkContext.broadcast((tree, query_ids, queries))
    wide = spread(base)

    def survey(visits: int) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, qids, q = shared.value
            stored = np.zeros(tree.n_leaves, np.int64)
            seen = np.zeros((visits, tree.n_leaves), np.int64)
            best_s = np.full((len(q), k), -9, np.float32)
            best_leaf = np.full((len(q), k), -1, np.int64)
            for b in batches:
                ids, m = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
                if not len(m):
                    continue
                leaves = tree.visit(m, visits)
                np.add.at(stored, leaves[:, 0], 1)
                for r in range(visits):
                    np.add.at(seen[r], leaves[leaves[:, r] >= 0, r], 1)
                s = q @ m.T
                s[qids[:, None] == ids[None, :]] = -9
                s = np.concatenate([best_s, s], 1)
                of = np.concatenate([best_leaf, np.broadcast_to(leaves[:, 0], (len(q), len(m)))], 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_leaf = np.take_along_axis(s, top, 1), np.take_along_axis(of, top, 1)
            n = np.arange(tree.n_leaves)
            for kind, a, c, x in [
                (-1, n, stored, stored * 0.0),
                *[(r, n, seen[r], seen[r] * 0.0) for r in range(visits)],
                (1000, np.repeat(np.arange(len(q)), k), best_leaf.ravel(), best_s.ravel()),
            ]:
                keep = c > 0 if kind < 1000 else x > -9
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(keep.sum()), kind, np.int32)), pa.array(a[keep].astype(np.int64)), pa.array(c[keep].astype(np.int64)), pa.array(x[keep].astype(np.float64))],
                    names=["kind", "a", "c", "x"],
                )

        raw = wide.mapInArrow(run, "kind int, a long, c long, x double")
        raw = durable(raw)
        counts = raw.where("kind < 1000").groupBy("kind", "a").agg(F.sum("c").alias("c"), F.lit(0.0).alias("x"))
        w = Window.partitionBy("a").orderBy(F.desc("x"))
        exact = raw.where("kind = 1000").withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).drop("at")
        return counts.unionByName(exact).toPandas()  # at most visits * leaves + calibration_rows * k rows

    while True:
        max_visits = min(max_visits, tree.n_leaves)
        facts = survey(max_visits)
        truth = facts[facts.kind == 1000]
        order = tree.visit(queries, max_visits)
        hit = order[truth.a.to_numpy()] == truth.c.to_numpy()[:, None]
        recall = hit.cumsum(1).mean(0) if len(truth) else np.ones(max_visits)
        enough = np.flatnonzero(recall >= recall_target)
        if len(enough) or max_visits >= tree.n_leaves:
            visits = int(enough[0]) + 1 if len(enough) else max_visits
            break
        max_visits *= 4
    stored = np.zeros(tree.n_leaves, np.int64)
    seen = np.zeros(tree.n_leaves, np.int64)
    here = facts[facts.kind == -1]
    stored[here.a] = here.c
    here = facts[(facts.kind >= 0) & (facts.kind < visits)]
    np.add.at(seen, here.a.to_numpy(), here.c.to_numpy())
    s_blocks, q_blocks = -(-stored // block_rows), np.maximum(1, -(-seen // query_rows))
    plan = spark.sparkContext.broadcast((np.maximum(1, s_blocks), q_blocks))
    mix = np.uint64(0x9E3779B97F4A7C15)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        s_of, q_of = plan.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                ids, m = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim)
                leaves = tree.visit(m, visits)
                with np.errstate(over="ignore"):
                    h = (ids.astype(np.uint64) * mix) >> np.uint64(33)
                cell, row, is_q, is_s = [], [], [], []
                for r in range(len(m)):
                    for i in range(visits):
                        leaf = int(leaves[r, i])
                        if leaf < 0:
                            break
                        ns, nq = int(s_of[leaf]), int(q_of[leaf])
                        sb, qb = int(h[r]) % ns, int(h[r] // 7) % nq
                        for s in range(ns):
                            mine = i == 0 and s == sb
                            cell.append((leaf << 40) | (s << 20) | qb)
                            row.append(r), is_q.append(True), is_s.append(mine)
                        if i == 0 and nq > 1:
                            for q in range(nq):
                                if q != qb:
                                    cell.append((leaf << 40) | (sb << 20) | q)
                                    row.append(r), is_q.append(False), is_s.append(True)
                row = np.array(row, np.int64)
                raw = [v.tobytes() for v in m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(cell, np.int64)), pa.array(ids[row].astype(np.int64)), pa.array(is_q), pa.array(is_s), pa.array([raw[r] for r in row], pa.binary())],
                    names=["cell", "id", "is_q", "is_s", "v"],
                )

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        m = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(-1, dim)
        is_q, is_s = t["is_q"].to_numpy(), t["is_s"].to_numpy()
        s_ids, s = ids[is_s], m[is_s]
        order = np.argsort(s_ids, kind="stable")
        s_ids, s = s_ids[order], s[order]
        q_ids, q = ids[is_q], m[is_q]
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q) if len(s) else 0, 1024):
            sim = q[lo : lo + 1024] @ s.T
            mine = q_ids[lo : lo + 1024]
            sim[mine[:, None] == s_ids[None, :]] = -9
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k] if sim.shape[1] <= 64 else _top(sim, k)
            best = np.take_along_axis(sim, top, 1)
            ok = best > -9
            out.append((np.repeat(mine, ok.sum(1)), s_ids[top][ok], best[ok]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        return pa.table({"id": pa.array(cols[0].astype(np.int64)), "neighbour": pa.array(cols[1].astype(np.int64)), "similarity": pa.array(cols[2].astype(np.float32))})

    near = wide.mapInArrow(route, "cell long, id long, is_q boolean, is_s boolean, v binary")
    near = near.groupBy("cell").applyInArrow(compare, "id long, neighbour long, similarity float")
    if n_groups:
        near = _with_copies(near, groups, vectors, sized, k)
    ranked = (
        near.groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k).alias("best"))  # at most visits * k
        .select("id", F.posexplode("best").alias("at", "b"))
    )
    return ranked.select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.s")).alias("similarity"), (F.col("at") + 1).alias("rank"))


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """The k best columns of each row, ties by the smaller column."""
    part = np.argpartition(-sim, k, axis=1)[:, : k + 1]
    kth = -np.sort(-np.take_along_axis(sim, part, 1), axis=1)[:, k - 1 : k]
    tied = (sim >= kth).sum(1)
    out = np.empty((len(sim), k), np.int64)
    simple = tied == k
    rows = np.flatnonzero(simple)
    if len(rows):
        picked = np.sort(np.argpartition(-sim[rows], k - 1, axis=1)[:, :k], axis=1)
        order = np.argsort(-np.take_along_axis(sim[rows], picked, 1), axis=1, kind="stable")
        out[rows] = np.take_along_axis(picked, order, 1)
    for r in np.flatnonzero(~simple):
        out[r] = np.argsort(-sim[r], kind="stable")[:k]
    return out


def _with_copies(near: DataFrame, groups: DataFrame, vectors: DataFrame, sized, k: int) -> DataFrame:
    """Neighbour lists between representatives widened to the members of their groups.

    A copy in a group of more than k needs no neighbour from outside it.
    """
    by_first = groups.select(F.col("members")[0].alias("first"), "members")
    stored = near.join(sized(by_first.withColumnRenamed("members", "others")), near["neighbour"] == F.col("first"), "left").select(
        "id", F.explode(F.coalesce("others", F.array("neighbour"))).alias("neighbour"), "similarity"
    )
    keyed = vectors.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    mine = keyed.join(sized(groups), ["h1", "h2"]).select("id", "n", "members")
    inside = mine.select("id", F.explode("members").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity")).where(
        F.col("id") != F.col("neighbour")
    )
    few = mine.where(F.col("n") <= k).select(F.col("id").alias("copy"), F.col("members")[0].alias("id")).where(F.col("copy") != F.col("id"))
    outside = stored.join(few, "id").select(F.col("copy").alias("id"), "neighbour", "similarity")
    return stored.unionByName(inside).unionByName(outside)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the other's neighbours."""
    return near.select(
        F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()
