"""Keyword, vector and hybrid retrieval over a papers table.

Every filter is applied inside each arm before its top k, ids and scores are ranked first
and wide columns are fetched for the survivors only. ``orderBy().limit()`` plans as
TakeOrderedAndProject, so no arm sorts the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import STOP_WORDS, tokens
from paperloom.session import durable

TITLE_WEIGHT, ABSTRACT_WEIGHT = 1.0, 0.4
K1, B, RRF_K = 1.2, 0.75, 60


@dataclass
class KeywordQuery:
    """A parsed web-style query: terms and phrases all wanted, alternatives, exclusions."""

    groups: list[list[list[str]]] = field(default_factory=list)  # AND of ORs of phrases
    excluded: list[list[str]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(w for g in self.groups for p in g for w in p))


def parse_query(text: str) -> KeywordQuery:
    """Terms are ANDed, "phrases" quoted, OR joins neighbours, a minus excludes; anything parses."""
    out, join_next = KeywordQuery(), False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
        if word == "OR" and not minus:
            join_next = bool(out.groups)
            continue
        words = [w for w in re.split(r"[^\w]+", (quoted or word).lower()) if w and w not in STOP_WORDS]
        if not words:
            continue
        if minus:
            out.excluded.append(words)
        elif join_next:
            out.groups[-1].append(words)
        else:
            out.groups.append([words])
        join_next = False
    return out


def year_between(low: int | None = None, high: int | None = None, column: str = "year") -> Column:
    """The rows in the bounds; a null year is dropped once a bound is set."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col(column) >= low)
    if high is not None:
        keep = keep & (F.col(column) <= high)
    return keep


def analysed(papers: DataFrame) -> DataFrame:
    """Papers with their title and abstract words."""
    return papers.withColumns({"title_words": tokens(F.coalesce("title", F.lit(""))), "abstract_words": tokens(F.coalesce("abstract", F.lit("")))})


def _holds(words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains("title_words", words[0]) | F.array_contains("abstract_words", words[0])
    phrase = " " + " ".join(words) + " "
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return F.contains(padded("title_words"), F.lit(phrase)) | F.contains(padded("abstract_words"), F.lit(phrase))


def matches(query: KeywordQuery) -> Column:
    """Whether an analysed paper matches; a query without words matches nothing."""
    if not query.groups:
        return F.lit(False)
    keep = F.lit(True)
    for group in query.groups:
        one = F.lit(False)
        for words in group:
            one = one | _holds(words)
        keep = keep & one
    for words in query.excluded:
        keep = keep & ~_holds(words)
    return keep


def _count(c: str, term: str) -> Column:
    return F.size(F.filter(c, lambda w: w == term))


def weighted_frequency(query: KeywordQuery) -> Column:
    """Occurrences in the title count 1, in the abstract 0.4."""
    score = F.lit(0.0)
    for t in query.terms:
        score = score + TITLE_WEIGHT * _count("title_words", t) + ABSTRACT_WEIGHT * _count("abstract_words", t)
    return score


def keyword_matches(papers: DataFrame, text: str, low: int | None = None, high: int | None = None) -> DataFrame:
    return analysed(papers.where(year_between(low, high))).where(matches(parse_query(text)))


def keyword_weighted(papers: DataFrame, text: str, k: int = 20, low: int | None = None, high: int | None = None) -> DataFrame:
    query = parse_query(text)
    found = keyword_matches(papers, text, low, high).select("id", weighted_frequency(query).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k)


def bm25(papers: DataFrame, text: str, k: int = 20, low: int | None = None, high: int | None = None) -> DataFrame:
    """BM25 over title and abstract; document frequencies and the mean length come from the whole table in one pass."""
    query = parse_query(text)
    whole = analysed(papers).withColumn("words", F.concat("title_words", "abstract_words")).withColumn("length", F.size("words"))
    stats = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.array_contains("words", t)).alias(f"df{i}") for i, t in enumerate(query.terms)])
    scored = whole.where(year_between(low, high) & matches(query)).join(F.broadcast(stats))  # one row of figures
    score = F.lit(0.0)
    for i, t in enumerate(query.terms):
        tf = _count("words", t).cast("double")
        idf = F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cover_density(papers: DataFrame, text: str, k: int = 20) -> DataFrame:
    """Matches ranked by their covers: shortest spans of one field with a word of every group, worth the field's weight / their length.

    Alternatives joined by OR are one group, any word of which will do; a match without a cover in either field scores 0.
    """
    query = parse_query(text)
    groups = [{w for words in group for w in words} if len(group) > 1 else None for group in query.groups]
    parts = [g if g is not None else {w} for g, group in zip(groups, query.groups, strict=True) for w in ([None] if g is not None else group[0])]
    wanted = set().union(*parts) if parts else set()
    found = keyword_matches(papers, text).select("id", "title_words", "abstract_words")

    def covers(words: list[str]) -> float:
        last, score, begin = [-1] * len(parts), 0.0, -1
        for i, w in enumerate(words):
            if w in wanted:
                last = [i if w in part else at for part, at in zip(parts, last, strict=True)]
                low = min(last)
                if low > begin:
                    score += 1.0 / (i - low + 1)
                    begin = low
        return score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [TITLE_WEIGHT * covers(t) + ABSTRACT_WEIGHT * covers(a) for t, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return found.mapInArrow(run, "id long, score double").orderBy(F.desc("score"), "id").limit(k)


def sound_vectors(papers: DataFrame, dim: int) -> DataFrame:
    return papers.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))


def nearest_in(rows: DataFrame, query: np.ndarray, k: int) -> DataFrame:
    """(id, score) of the k nearest rows of (id, embedding) by cosine; each batch sends on its k best."""
    q = (query / max(np.linalg.norm(query), 1e-300)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            s = (m @ q) / np.sqrt(np.einsum("ij,ij->i", m, m))
            top = np.lexsort((ids, -s))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[top]), pa.array(s[top])], names=["id", "score"])

    return rows.select("id", "embedding").mapInArrow(run, "id long, score double").orderBy(F.desc("score"), "id").limit(k)


def vector_topk(papers: DataFrame, query: list[float], k: int = 20, low: int | None = None, high: int | None = None) -> DataFrame:
    """The exact k nearest by cosine; ties by id."""
    return nearest_in(sound_vectors(papers.where(year_between(low, high)), len(query)), np.array(query, np.float64), k)


def vector_batch_topk(papers: DataFrame, queries: DataFrame, dim: int, k: int = 10, block: int = 2000, most: int = 50_000) -> DataFrame:
    """(query_id, id, score, rank): a set of queries against all rows, in blocks of about ``most`` queries chosen by the hash of their id."""
    parts = -(-queries.count() // most)
    if parts <= 1:
        return _block_topk(papers, queries, dim, k, block)
    out = None
    for i in range(parts):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        top = durable(_block_topk(papers, part, dim, k, block))
        out = top if out is None else out.unionByName(top)
    return out


def _block_topk(papers: DataFrame, queries: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """One block of queries against all rows, one matrix product per batch.

    Each batch keeps its k best per query; a window over those merges them.
    """
    held = queries.select(F.col("id").alias("q"), "embedding").toArrow()
    ids = held["q"].to_numpy()
    m = held["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    shared = papers.sparkSession.sparkContext.broadcast((ids, m / np.linalg.norm(m, axis=1, keepdims=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, block):
                b = whole.slice(lo, block)
                own = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                s = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                order = np.argsort(own, kind="stable")
                top = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, top.shape[1])), pa.array(own[top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel())],
                    names=["query_id", "id", "score"],
                )

    best = sound_vectors(papers, dim).select("id", "embedding").mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(arm: DataFrame, depth: int) -> DataFrame:
    """(id, rank) of the first ``depth`` rows; the window sees no more than those."""
    top = arm.orderBy(F.desc("score"), "id").limit(depth)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(keyword: DataFrame, vector: DataFrame, depth: int = 200) -> DataFrame:
    """(id, keyword_rank, vector_rank, score, pool): reciprocal ranks of two arms over their union."""
    a = ranked(keyword, depth).withColumnRenamed("rank", "keyword_rank")
    b = ranked(vector, depth).withColumnRenamed("rank", "vector_rank")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    both = a.join(b, "id", "full")
    return both.select("id", "keyword_rank", "vector_rank", (part("keyword_rank") + part("vector_rank")).alias("score"), F.count(F.lit(1)).over(Window.partitionBy()).alias("pool"))


def hybrid(papers: DataFrame, text: str, query: list[float], k: int = 20, depth: int = 200, low: int | None = None, high: int | None = None) -> DataFrame:
    """The fused top k with the papers' columns and the arms each came from."""
    fused = fuse(bm25(papers, text, depth, low, high), vector_topk(papers, query, depth, low, high), depth)
    top = fused.orderBy(F.desc("score"), "id").limit(k)
    arms = F.array_compact(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")))
    wide = papers.select("id", "doi", "title", "year", "venue", "citation_count", "is_retracted")
    return F.broadcast(top).join(wide, "id").withColumn("sources", F.array_join(arms, "+"))


def mode_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, only_a, only_b) of two result lists."""
    both = a.select("id", F.lit(1).alias("in_a")).join(b.select("id", F.lit(1).alias("in_b")), "id", "full")
    return both.agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
    )


def fit_cells(rows: DataFrame, dim: int, k: int, lists: int = 16, fit_rows: int = 5000, least_recall: float = 0.95) -> tuple[np.ndarray, int]:
    """The centroids of ``lists`` cells, and the probes, four at least, that give ``least_recall`` at ``k`` within the fitted rows.

    They are fitted on at most ``fit_rows`` rows chosen by the hash of their id; at most 500 of those are the queries.
    """
    sample = rows.orderBy(F.xxhash64("id")).select("embedding").limit(fit_rows).toArrow()["embedding"].combine_chunks()
    if not len(sample):
        return np.empty((0, dim), np.float32), 0
    x = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(3)
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(10):
        of = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (of == c).any():
                m = x[of == c].sum(0)
                centre[c] = m / max(np.linalg.norm(m), 1e-9)
    q = x[:500]
    nearest = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centre.T), axis=1, kind="stable"), axis=1)  # of each cell in the query's order
    needed = np.take_along_axis(place, (x @ centre.T).argmax(1)[nearest], 1)
    recall = [(needed < p).mean() for p in range(1, len(centre) + 1)]
    return centre, max(4, 1 + next((i for i, r in enumerate(recall) if r >= least_recall), len(centre) - 1))


def in_cells(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(id, embedding, cell) of ``rows``."""
    dim = centre.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((m @ centre.T).argmax(1).astype(np.int32))], names=["id", "embedding", "cell"])

    return rows.select("id", "embedding").mapInArrow(run, "id long, embedding array<float>, cell int")


def ivf_topk(papers: DataFrame, query: list[float], k: int = 20, lists: int = 16, probes: int | None = None, fit_rows: int = 5000) -> DataFrame:
    """Approximate top k: the rows of the ``probes`` cells nearest to the query; cells are widened until k rows remain.

    Without ``probes`` there are as many as ``fit_cells`` found to be needed.
    """
    rows = sound_vectors(papers, len(query))
    centre, wanted = fit_cells(rows, len(query), k, lists, fit_rows)
    if not len(centre):
        return vector_topk(papers, query, k)
    q = np.array(query, np.float32)
    near = np.argsort(-(centre @ (q / np.linalg.norm(q))), kind="stable")
    placed = in_cells(rows, centre)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    taken, held = [], 0
    for c in near.tolist():
        if len(taken) >= (wanted if probes is None else probes) and held >= k:
            break
        taken.append(c)
        held += sizes.get(c, 0)
    return nearest_in(placed.where(F.col("cell").isin(taken)), np.array(query, np.float64), k)


def ivf_batch_topk(papers: DataFrame, queries: DataFrame, dim: int, k: int = 10, lists: int = 16, probes: int | None = None, fit_rows: int = 5000, most: int = 50_000) -> DataFrame:
    """(query_id, id, score, rank): ``ivf_topk`` of every row of ``queries``, with the cells fitted once.

    Each row is compared with the queries that probe its cell, in blocks of about ``most`` queries.
    """
    parts = -(-queries.count() // most)
    if parts > 1:
        out = None
        for i in range(parts):
            part = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
            top = durable(ivf_batch_topk(papers, part, dim, k, lists, probes, fit_rows, most=1 << 62))
            out = top if out is None else out.unionByName(top)
        return out
    rows = sound_vectors(papers, dim)
    centre, wanted = fit_cells(rows, dim, k, lists, fit_rows)
    if not len(centre):
        return vector_batch_topk(papers, queries, dim, k)
    placed = in_cells(rows, centre)
    sizes = np.zeros(len(centre), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        sizes[r["cell"]] = r["n"]
    held = queries.select(F.col("id").alias("q"), "embedding").toArrow()
    m = held["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    order = np.argsort(-(m.astype(np.float32) @ centre.T), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    take = np.zeros(order.shape, bool)
    np.put_along_axis(take, order, (np.arange(len(centre))[None, :] < (wanted if probes is None else probes)) | (before < k), 1)
    shared = papers.sparkSession.sparkContext.broadcast((held["q"].to_numpy(), m / np.linalg.norm(m, axis=1, keepdims=True), take))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, take = shared.value
        for b in batches:
            own, cell = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            for c in np.unique(cell):
                asking, rows = np.flatnonzero(take[:, c]), np.flatnonzero(cell == c)
                rows = rows[np.argsort(own[rows], kind="stable")]
                s = q[asking] @ v[rows].T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids[asking], top.shape[1])), pa.array(own[rows][top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel())],
                    names=["query_id", "id", "score"],
                )

    best = placed.mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
