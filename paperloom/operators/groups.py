"""Duplicate groups: components, caps, survivors, merges that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import set_similarity, trigrams
from paperloom.operators.pairs import attributed, block_join, record_marks, strategy_rank
from paperloom.session import durable, release

CAP, CAP_OF = 8, {"title_exact": 2}


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each vertex's component, by label propagation with hooking and pointer jumping.

    All vertices of one label take the lowest label that any of them meets, so whole trees are joined in a round
    and the rounds grow with the logarithm of the vertices, not with the length of a chain. Labels only fall: it ends.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = durable(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "id").select("id", "root", F.least("root", "near").alias("next"))
        lower = lower.join(lower.groupBy("root").agg(F.min("next").alias("hook")), "root").select("id", "root", F.col("hook").alias("next"))
        jumped = lower.join(labels.select(F.col("id").alias("next"), F.col("root").alias("far")), "next").select("id", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved"))
        step = durable(jumped)
        moved = step.agg(F.count_if("moved").alias("n")).first()["n"]
        release(labels)
        labels = step
        if not moved:
            release(both)
            return labels.select("id", "root")


def group_strategy(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(root, size, strategy, sim, strategies): a group's earliest strategy, that edge's sim, and all of them."""
    edges = attributed(pairs).join(members.withColumnRenamed("id", "a"), "a")
    by = edges.groupBy("root").agg(
        F.min(F.struct(strategy_rank(F.col("strategy")).alias("r"), "a", "b", "sim", "strategy")).alias("m"),
        F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"),
    )
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return by.join(size, "root").select("root", "size", F.col("m.strategy").alias("strategy"), F.col("m.sim").alias("sim"), "strategies")


def group_verdict(groups: DataFrame, members: DataFrame, held: DataFrame) -> DataFrame:
    """``groups`` with a verdict: flagged above its strategy's cap, withheld with a held member, else mergeable."""
    cap = F.lit(CAP)
    for s, n in CAP_OF.items():
        cap = F.when(F.col("strategy") == s, n).otherwise(cap)
    kept_back = members.join(held.select("id").distinct(), "id", "left_semi").select("root").distinct().withColumn("hold", F.lit(True))
    verdict = F.when(F.col("size") > cap, "flagged").when(F.col("hold"), "withheld").otherwise("mergeable")
    return groups.join(kept_back, "root", "left").withColumn("verdict", verdict).drop("hold")


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def chain_report(pairs: DataFrame, members: DataFrame, papers: DataFrame, least: int = 4) -> DataFrame:
    """(root, size, edges, density, mean_sim, min_sim): how alike the titles of all pairs of a group's records are.

    Equal titles count as often as they occur but are compared once, and large groups are compared in cells.
    Records without a paper or a title have no pairs.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    edges = attributed(pairs).join(members.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("edges"))
    titled = members.join(size.select("root"), "root").join(papers.select("id", "title_norm"), "id").where(F.col("title_norm").isNotNull())
    by = titled.groupBy("root", "title_norm").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).withColumn("g", trigrams(F.col("title_norm")))
    x, y = (by.select("root", F.col("low").alias(c), F.col("n").alias(f"n_{c}"), F.col("g").alias(f"g_{c}")) for c in ("x", "y"))
    other = block_join(x, y, ["root"], "x", "y").where("x < y").select("root", (F.col("n_x") * F.col("n_y")).alias("w"), set_similarity(F.col("g_x"), F.col("g_y")).alias("sim"))
    same = by.where("n > 1").select("root", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"), set_similarity(F.col("g"), F.col("g")).alias("sim"))
    alike = other.unionByName(same).groupBy("root").agg((F.sum(F.col("sim") * F.col("w")) / F.sum("w")).alias("mean_sim"), F.min("sim").alias("min_sim"))
    density = F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2)
    return size.join(edges, "root").join(alike, "root", "left").select("root", "size", "edges", density.alias("density"), "mean_sim", "min_sim")


def publication_rank(papers: DataFrame, records: DataFrame) -> DataFrame:
    """(id, rank): 0 a preprint, 1 without a venue, 2 published."""
    marked = papers.select("id", "venue", "doi").join(record_marks(records).withColumn("early", F.lit(True)), "id", "left")
    preprint = F.col("early").isNotNull() | F.coalesce(F.contains("doi", F.lit("/preprints.")), F.lit(False)) | F.coalesce(F.col("venue").rlike("(?i)arxiv|biorxiv|medrxiv|preprint"), F.lit(False))
    return marked.select("id", F.when(preprint, 0).when(F.col("venue").isNull(), 1).otherwise(2).alias("rank"))


def text_moved(papers: DataFrame, merged: DataFrame) -> DataFrame:
    """(id): the survivors whose title or abstract differs from what they had, so that their vector must be made again."""
    new = merged.select(F.col("survivor").alias("id"), F.col("title").alias("new_title"), F.col("abstract").alias("new_abstract"))
    both = papers.select("id", "title", "abstract").join(new, "id")
    return both.where(~F.col("title").eqNullSafe(F.col("new_title")) | ~F.col("abstract").eqNullSafe(F.col("new_abstract"))).select("id")


def survivors(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """(root, survivor): the highest rank of a group, then the smallest id."""
    best = F.max(F.struct("rank", (-F.col("id")).alias("low")))
    return members.join(ranks, "id").groupBy("root").agg(best.alias("m")).select("root", (-F.col("m.low")).alias("survivor"))


def merged_fields(papers: DataFrame, members: DataFrame, chosen: DataFrame) -> DataFrame:
    """One record per group: the survivor's text, the highest count, any retraction, identifiers of the first that has them."""
    own = F.col("id") == F.col("survivor")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((~own).alias("other"), "id", c)))[c].alias(c)
    mine = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    rows = papers.join(members, "id").join(chosen, "root")
    return rows.groupBy("root", "survivor").agg(
        mine("title"), mine("abstract"), mine("venue"), mine("year"),
        F.max("citation_count").alias("citation_count"), F.bool_or("is_retracted").alias("is_retracted"),
        first("doi"), first("arxiv_id"), first("pubmed_id"), first("authors"),
    )


def mapping(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, survivor) of every member."""
    return members.join(chosen, "root").select("id", "survivor")


def merge_screening_conflicts(screenings: DataFrame, members: DataFrame) -> DataFrame:
    """(root, collection_id, user_id, decisions): raters who decided differently on records of one group."""
    by = screenings.join(members.withColumnRenamed("id", "paper_id"), "paper_id").groupBy("root", "collection_id", "user_id")
    return by.agg(F.count_distinct("decision").alias("decisions")).where("decisions > 1")


def screening_collapse(screenings: DataFrame, links: DataFrame) -> DataFrame:
    """Screenings under their survivors; a rater's own decision on the survivor goes before others, then the latest."""
    moved = screenings.join(links.withColumnRenamed("id", "paper_id"), "paper_id", "left").withColumn("target", F.coalesce("survivor", "paper_id"))
    best = F.max(F.struct((F.col("paper_id") == F.col("target")).alias("own"), "decided_at", (-F.col("paper_id")).alias("low"), "decision"))
    return moved.groupBy("collection_id", F.col("target").alias("paper_id"), "user_id").agg(best.alias("m")).select("collection_id", "paper_id", "user_id", F.col("m.decision").alias("decision"), F.col("m.decided_at").alias("decided_at"))


def repoint(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with their paper replaced by its survivor."""
    return records.join(links.withColumnRenamed("id", "paper_id"), "paper_id", "left").withColumn("paper_id", F.coalesce("survivor", "paper_id")).drop("survivor")


FIELDS = ("title", "title_norm", "abstract", "year", "venue", "citation_count", "doi", "arxiv_id", "pubmed_id", "is_retracted", "authors", "created_at")


def merge_snapshot(papers: DataFrame, members: DataFrame, chosen: DataFrame, records: DataFrame | None = None, screenings: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """(kept_paper_id, survivor_before, deleted_papers, member_ids): what undoing a merge needs.

    What hangs on the papers is added where its table is given: ``records`` (id, paper_id) as source_record_map, ``screenings``, every row as it
    stands, as screening_map, and of ``merges`` (id, kept_paper_id) those that a deleted paper had survived as prior_merge_map.
    Groups that may be merged are capped in size, so what is collected is bounded.
    """
    whole = F.struct("id", *FIELDS)
    rows = papers.join(members, "id").join(chosen, "root")
    out = rows.groupBy(F.col("survivor").alias("kept_paper_id")).agg(
        F.max(F.when(F.col("id") == F.col("survivor"), whole)).alias("survivor_before"),
        F.array_sort(F.collect_list(F.when(F.col("id") != F.col("survivor"), whole))).alias("deleted_papers"),
        F.array_sort(F.collect_list("id")).alias("member_ids"),
    )
    live = mapping(members, chosen).join(papers.select("id"), "id").select(F.col("id").alias("paper_id"), F.col("survivor").alias("kept_paper_id"))
    lost = live.where("paper_id <> kept_paper_id")
    for name, table, under, fields in (
        ("source_record_map", records and records.select(F.col("id").alias("record_id"), "paper_id"), live, ("record_id", "paper_id")),
        ("screening_map", screenings, live, ("collection_id", "paper_id", "user_id", "decision", "note", "decided_at")),
        ("prior_merge_map", merges and merges.select(F.col("id").alias("merge_id"), F.col("kept_paper_id").alias("paper_id")), lost, ("merge_id", "paper_id")),
    ):
        if table is not None:
            by = table.join(under, "paper_id").groupBy("kept_paper_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
            out = out.join(by, "kept_paper_id", "left").withColumn(name, F.coalesce(name, F.array().cast(by.schema[name].dataType)))
    return out


def apply_merge(papers: DataFrame, merged: DataFrame, links: DataFrame) -> DataFrame:
    """The papers after merging: losers gone, survivors rewritten."""
    kept = papers.join(links.select("id").distinct(), "id", "left_anti").select("id", *FIELDS)
    base = papers.select(F.col("id").alias("survivor"), "title_norm", "created_at")
    rewritten = merged.join(base, "survivor").select(F.col("survivor").alias("id"), *FIELDS)
    return kept.unionByName(rewritten)


def roll_back(after: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The papers as they were before the merges of ``snapshots``."""
    untouched = after.join(snapshots.select(F.col("kept_paper_id").alias("id")), "id", "left_anti")
    restored = snapshots.select(F.explode(F.concat(F.array("survivor_before"), "deleted_papers")).alias("p")).select("p.*")
    return untouched.unionByName(restored)


def orphans(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Records whose paper does not exist."""
    return records.where(F.col("paper_id").isNotNull()).join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_anti")


def unwind_candidates(snapshots: DataFrame, more_than: int) -> DataFrame:
    return snapshots.where(F.size("member_ids") > more_than)
