"""The registry of named queries. Each has its SQL twin in ``oracle`` where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as ft
from paperloom.functions.encoder import HashingEncoder, embed
from paperloom.operators import evaluation, groups, index, pairs, screening, search, stats
from paperloom.operators.nested import child_table, flatten_records
from paperloom.plans.oracle import SQL
from paperloom.session import ensure_checkpoint_dir, read_table
from paperloom.sources import records as rec

Query = Callable[[SparkSession, str], DataFrame]

DIM = 384
TEXT = "citation triage"
LOW, HIGH = 2010, 2020


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read_table(spark, sf_dir, name)


papers, source_records, screenings, scored_pairs, collections = (_t(n) for n in ("papers", "source_records", "screenings", "pairs", "collections"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id that has one: the query of the vector examples."""
    row = search.sound_vectors(papers(spark, sf_dir), DIM).select("id", "embedding").orderBy("id").limit(1).collect()
    return [float(x) for x in row[0]["embedding"]] if row else [1.0] + [0.0] * (DIM - 1)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored pairs that count as links, as edges with their strategy."""
    p = scored_pairs(spark, sf_dir).where((F.col("similarity") >= pairs.GATE) & ~F.isnan("similarity"))
    return p.select("a", "b", F.col("similarity").alias("sim"), "strategy").where("a is not null and b is not null and a <> b")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.components(links(spark, sf_dir))


def chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = members(spark, sf_dir)
    return m, groups.survivors(m, groups.publication_rank(papers(spark, sf_dir), source_records(spark, sf_dir)))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# retrieval
def year_filter(s, d):
    return papers(s, d).where(search.year_between(LOW, HIGH)).select("id", "year")


def keyword_match(s, d):
    return search.keyword_matches(papers(s, d), '"citation triage" OR reranker -dental').select("id")


def keyword_total(s, d):
    return search.keyword_matches(papers(s, d), TEXT).agg(F.count(F.lit(1)).alias("total"))


def tokenize(s, d):
    return papers(s, d).select("id", F.array_join(ft.tokens(F.col("title")), " ").alias("words"))


def search_keyword_weighted(s, d):
    return rounded(search.keyword_weighted(papers(s, d), TEXT, 20), "score")


def search_bm25(s, d):
    return rounded(search.bm25(papers(s, d), TEXT, 20, LOW, HIGH), "score")


def search_cover_density(s, d):
    return search.cover_density(papers(s, d), TEXT, 20)


def vector_topk(s, d):
    return rounded(search.vector_topk(papers(s, d), query_vector(s, d), 20), "score")


def vector_topk_filtered(s, d):
    return rounded(search.vector_topk(papers(s, d), query_vector(s, d), 20, LOW, HIGH), "score")


def vector_total(s, d):
    return search.sound_vectors(papers(s, d), DIM).agg(F.count(F.lit(1)).alias("total"))


def vector_batch_topk(s, d):
    """The rows whose id divides by 20 against all rows."""
    p = papers(s, d)
    queries = search.sound_vectors(p, DIM).where("id % 20 = 0")
    return rounded(search.vector_batch_topk(p, queries, DIM, 10), "score")


def vector_ivf(s, d):
    return rounded(search.ivf_topk(papers(s, d), query_vector(s, d), 20), "score")


_INDEXES: dict[tuple, str] = {}


def index_path(s, d) -> str:
    """The folder of the indexes over a directory's papers, built once for a session in the shared folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = f"{ensure_checkpoint_dir(s).rstrip('/')}/index-{uuid.uuid4().hex}"
        index.build_postings(papers(s, d), path, buckets=32)
        index.build_cells(papers(s, d), path, DIM)
        _INDEXES[key] = path
    return _INDEXES[key]


def index_bm25(s, d):
    return rounded(index.search_postings(s, index_path(s, d), TEXT, 20, LOW, HIGH), "score")


def index_cells_filtered(s, d):
    return rounded(index.search_cells(s, index_path(s, d), query_vector(s, d), 20, None, LOW, HIGH), "score")


def search_facade(s, d):
    return rounded(index.search(s, index_path(s, d), papers(s, d), TEXT, query_vector(s, d), "hybrid"), "score", places=9)


def hybrid_rrf(s, d):
    out = search.hybrid(papers(s, d), TEXT, query_vector(s, d), 20, 200)
    return rounded(out.select("id", "doi", "title", "year", "keyword_rank", "vector_rank", "score", "pool", "sources"), "score", places=9)


def hybrid_sources(s, d):
    p, q = papers(s, d), query_vector(s, d)
    fused = search.fuse(search.bm25(p, TEXT, 200), search.vector_topk(p, q, 200), 200)
    arms = F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both")
    return fused.groupBy(arms.alias("arms")).agg(F.count(F.lit(1)).alias("n"))


def mode_overlap(s, d):
    p = papers(s, d)
    return search.mode_overlap(search.bm25(p, TEXT, 20), search.vector_topk(p, query_vector(s, d), 20))


# ingest
def record_upsert(s, d):
    return rec.latest_records(source_records(s, d)).select("source", "source_id", "id", "fetched_at", "paper_id", "query_name", "fetches")


def paper_owner(s, d):
    return rec.owners(source_records(s, d))


def paper_link(s, d):
    return rec.create_or_link(rec.papers_only(rec.derive_papers(source_records(s, d))), papers(s, d))


def paper_refresh(s, d):
    r = source_records(s, d)
    return rec.refresh(papers(s, d), rec.derive_papers(r), rec.owners(r)).select("id", "title", "title_norm", "citation_count")


def paper_refresh_all(s, d):
    """Every rewritten field, and whether the text changed."""
    r = source_records(s, d)
    return rec.refresh(papers(s, d), rec.derive_papers(r), rec.owners(r)).drop("embedding")


def ingest_derived(s, d):
    return rec.derive_papers(source_records(s, d)).drop("fetched_at")


def extract_venue(s, d):
    return rec.opened(source_records(s, d).where("source = 'openalex'")).select("id", rec.extract_venue().alias("venue"))


def extract_authors(s, d):
    return rec.derive_papers(source_records(s, d)).select(F.col("record_id").alias("id"), F.array_join("authors", "|").alias("authors"))


def ingest_outcomes(s, d):
    return rec.outcomes(source_records(s, d))


def junk_types(s, d):
    """The works of each type, and whether they become papers."""
    derived = rec.derive_papers(source_records(s, d))
    kept = rec.papers_only(derived).groupBy("source", "type").agg(F.count(F.lit(1)).alias("kept"))
    every = derived.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))
    return every.join(kept, every["source"].eqNullSafe(kept["source"]) & every["type"].eqNullSafe(kept["type"]), "left").select(every["source"], every["type"], "n", F.coalesce("kept", F.lit(0)).alias("kept"))


def deinvert_abstract(s, d):
    a = papers(s, d).where(F.col("abstract").isNotNull())
    return a.select("id", ft.deinvert(ft.invert_text(F.col("abstract"))).alias("abstract"))


def split_budget(s, d):
    w = papers(s, d).where("year is not null").groupBy(F.col("year").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rec.split_budget(w, 1000)


def year_slices(s, d):
    return rec.year_slices(papers(s, d))


def nested_departments(s, d):
    return child_table(source_records(s, d), "department")


# duplicates
def normalize_doi(s, d):
    return papers(s, d).select("id", ft.normalize_doi(F.col("doi")).alias("doi"))


def normalize_title(s, d):
    return papers(s, d).select("id", ft.normalize_title(F.col("title")).alias("title"))


def pairs_doi_exact(s, d):
    return pairs.doi_exact(papers(s, d))


def pairs_doi_transform(s, d):
    """A version suffix taken off: the first version of a preprint's DOI and the plain one."""
    return pairs.doi_transform(papers(s, d).withColumn("doi", ft.normalize_doi(F.col("doi"))), "/v1", "")


def pairs_id_exact(s, d):
    return pairs.id_exact(papers(s, d))


def pairs_abstract_hash(s, d):
    p = papers(s, d)
    return pairs.abstract_hash(p, pairs.boilerplate_seed(p))


def pairs_abstract_title(s, d):
    p = papers(s, d)
    return rounded(pairs.abstract_title(p, pairs.boilerplate_seed(p)), "sim")


def pairs_title_exact(s, d):
    return pairs.title_exact(papers(s, d))


def surname_blocks(s, d):
    return pairs.surname_blocks(papers(s, d))


def pairs_title_trgm(s, d):
    return rounded(pairs.title_trgm(papers(s, d)), "sim")


def preprints(s, d):
    return pairs.preprints(papers(s, d), source_records(s, d)).select("id")


def pairs_preprint_trgm(s, d):
    return rounded(pairs.preprint_trgm(papers(s, d), records=source_records(s, d)), "sim")


def _titles(s, d):
    """The scored pairs with both titles."""
    t = papers(s, d).select("id", "title_norm")
    p = scored_pairs(s, d).where("a is not null and b is not null").select("a", "b").distinct()
    return p.join(t.select(F.col("id").alias("a"), F.col("title_norm").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("title_norm").alias("y")), "b")


def trigram_similarity(s, d):
    return _titles(s, d).select("a", "b", F.round(ft.trigram_similarity(F.col("x"), F.col("y")), 6).alias("sim"))


def enum_siblings(s, d):
    return _titles(s, d).select("a", "b", ft.enum_siblings(F.col("x"), F.col("y")).alias("siblings"))


def part_siblings(s, d):
    return _titles(s, d).select("a", "b", ft.part_siblings(F.col("x"), F.col("y")).alias("siblings"))


def pairs_attributed(s, d):
    return rounded(pairs.attributed(links(s, d)), "sim")


def trgm_sweep(s, d):
    p = papers(s, d)
    return pairs.threshold_sweep(pairs.title_trgm(p), p)


def boilerplate_seed(s, d):
    return pairs.boilerplate_seed(papers(s, d), shared=3)


def source_overlap(s, d):
    of = lambda n: _t(n)(s, d).select(ft.normalize_doi(F.col("doi")).alias("doi"), ft.normalize_title(F.col("title")).alias("title_norm"))
    return pairs.source_overlap(of("arxiv_fields"), of("pubmed_fields"))


def pairs_minus_negative(s, d):
    e = links(s, d)
    return pairs.minus_negative(pairs.attributed(e).select("a", "b"), e.where("strategy = 'title_trgm'"))


def dedup_pairs(s, d):
    """Every strategy over the papers, each pair once."""
    return rounded(pairs.attributed(pairs.all_pairs(papers(s, d), source_records(s, d))), "sim")


# groups
def components(s, d):
    return members(s, d)


def group_strategy(s, d):
    return rounded(groups.group_strategy(links(s, d), members(s, d)), "sim")


def group_verdict(s, d):
    m = members(s, d)
    held = papers(s, d).where("is_retracted").select("id")
    return groups.group_verdict(groups.group_strategy(links(s, d), m), m, held).select("root", "size", "strategy", "verdict")


def group_sizes(s, d):
    return groups.group_sizes(members(s, d))


def chain_report(s, d):
    return rounded(groups.chain_report(links(s, d), members(s, d), papers(s, d)), "density", "mean_sim", "min_sim")


def publication_rank(s, d):
    return groups.publication_rank(papers(s, d), source_records(s, d))


def survivor(s, d):
    return chosen(s, d)[1]


def merged_fields(s, d):
    m, c = chosen(s, d)
    return groups.merged_fields(papers(s, d), m, c).withColumn("authors", F.array_join("authors", "|"))


def merge_screening_conflicts(s, d):
    return groups.merge_screening_conflicts(screening.current(screenings(s, d)), members(s, d))


def screening_collapse(s, d):
    m, c = chosen(s, d)
    return groups.screening_collapse(screening.current(screenings(s, d)), groups.mapping(m, c))


def record_repoint(s, d):
    m, c = chosen(s, d)
    return groups.repoint(source_records(s, d).select("id", "paper_id"), groups.mapping(m, c))


def _mergeable(s, d):
    """Members and survivors of the groups that may be merged, the latter with the strategy and similarity of their group."""
    m, c = chosen(s, d)
    ok = groups.group_verdict(groups.group_strategy(links(s, d), m), m, papers(s, d).where("false").select("id")).where("verdict = 'mergeable'").select("root", "strategy", F.col("sim").alias("similarity"))
    return m.join(ok.select("root"), "root"), c.join(ok, "root")


def merge_snapshot(s, d):
    """The audit row of every merge: what undoing it needs, the group's strategy and similarity, and the collections in which a rater decided differently on its members.

    No table of earlier merges is given, so none of them is in the row.
    """
    m, c = _mergeable(s, d)
    snap = groups.merge_snapshot(papers(s, d), m, c, source_records(s, d).select("id", "paper_id"), screenings(s, d))
    against = groups.merge_screening_conflicts(screening.current(screenings(s, d)), m).groupBy("root").agg(F.array_sort(F.collect_set("collection_id")).alias("conflicts"))
    audit = c.join(against, "root", "left").select(F.col("survivor").alias("kept_paper_id"), "strategy", "similarity", F.coalesce("conflicts", F.array().cast("array<long>")).alias("conflicts"))
    counted = snap.withColumns({"deleted": F.size("deleted_papers"), "members": F.array_join("member_ids", ",")}).join(audit, "kept_paper_id")
    return counted.select("kept_paper_id", "deleted", "members", "strategy", "similarity", "conflicts", "survivor_before", "deleted_papers", "source_record_map", "screening_map")


def merge_roundtrip(s, d):
    """What differs from the papers after merging and undoing it: nothing."""
    p = papers(s, d)
    m, c = _mergeable(s, d)
    snap = groups.merge_snapshot(p, m, c)
    after = groups.apply_merge(p, groups.merged_fields(p, m, c), groups.mapping(m, c))
    back = groups.roll_back(after, snap)
    want = p.select("id", *groups.FIELDS)
    return back.exceptAll(want).unionByName(want.exceptAll(back)).agg(F.count(F.lit(1)).alias("differences"))


def unwind_candidates(s, d):
    m, c = _mergeable(s, d)
    return groups.unwind_candidates(groups.merge_snapshot(papers(s, d), m, c), 3).select("kept_paper_id")


def orphan_records(s, d):
    return groups.orphans(source_records(s, d), papers(s, d)).select("id", "paper_id")


# statistics
def corpus_totals(s, d):
    return stats.corpus_totals(papers(s, d))


def by_source(s, d):
    return stats.by_source(source_records(s, d))


def records_by_query(s, d):
    return stats.records_by_query(source_records(s, d))


def papers_by_query(s, d):
    return stats.papers_by_query(source_records(s, d))


def embedding_coverage(s, d):
    return stats.embedding_coverage(papers(s, d), source_records(s, d))


def merges_by_strategy(s, d):
    return stats.pairs_by_strategy(scored_pairs(s, d))


def corr_tail(s, d):
    return stats.citation_tail(papers(s, d))


def bucket_topn(s, d):
    return stats.top_per_query(papers(s, d), source_records(s, d), 5)


def title_sample(s, d):
    return stats.even_sample(papers(s, d), 50)


def stratified_sample(s, d):
    return stats.stratified_sample(papers(s, d), "venue", 3)


def document_text(s, d):
    return papers(s, d).select("id", ft.document_text(F.col("title"), F.col("abstract")).alias("text"))


def embed_backlog(s, d):
    p = papers(s, d)
    return stats.embed_backlog(p, pairs.boilerplate_seed(p))


def embed_hash(s, d):
    return embed(embed_backlog(s, d), HashingEncoder(DIM)).select("id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def l2_normalize(s, d):
    v = search.sound_vectors(papers(s, d), DIM).select("id", ft.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


# screening
def screenings_current(s, d):
    return screening.current(screenings(s, d))


def collection_summary(s, d):
    return screening.collection_summary(screening.current(screenings(s, d)), collections(s, d))


def collection_papers(s, d):
    return screening.collection_papers(screening.current(screenings(s, d)), papers(s, d), "include")


def conflicts(s, d):
    return screening.conflicts(screening.current(screenings(s, d)))


def resolutions_stale(s, d):
    now = screening.current(screenings(s, d))
    first = now.groupBy("collection_id", "paper_id").agg((F.min("decided_at") + F.expr("INTERVAL 60 DAYS")).alias("resolved_at"))
    ruled = screening.conflicts(now).join(first, ["collection_id", "paper_id"])
    return screening.stale_resolutions(ruled, now)


def _ruled(s, d):
    """Every conflict with a ruling two months after its first decision, by its rater of the smallest id."""
    now = screening.current(screenings(s, d))
    first = now.groupBy("collection_id", "paper_id").agg((F.min("decided_at") + F.expr("INTERVAL 60 DAYS")).alias("resolved_at"), F.min("user_id").alias("resolved_by"))
    return screening.conflicts(now).select("collection_id", "paper_id").join(first, ["collection_id", "paper_id"])


def self_resolved(s, d):
    return screening.self_resolved(_ruled(s, d), screening.current(screenings(s, d)))


def blinded_view(s, d):
    return screening.blinded_view(screening.current(screenings(s, d)), collections(s, d), 1)


def reveal_preview(s, d):
    return screening.reveal_preview(screening.current(screenings(s, d)))


def query_text(s, d):
    return papers(s, d).select("id", ft.query_text(F.col("title")).alias("text"))


def token_hash(s, d):
    return papers(s, d).select("id", ft.token_hash(F.col("title")).alias("hash"))


def mean_and_error(s, d):
    return rounded(stats.mean_and_error(papers(s, d).where("citation_count < 900000 and citation_count >= 0 and year is not null"), "citation_count", "year"), "mean", "stdev", "error")


def bootstrap_precision(s, d):
    population = scored_pairs(s, d).groupBy(F.col("strategy").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    return evaluation.bootstrap_precision(_labels(s, d), population)


def _owned(s, d):
    return source_records(s, d).where("query_name is not null and paper_id is not null").select("query_name", F.col("paper_id").alias("id")).distinct()


def proportional_subset(s, d):
    return stats.proportional_subset(_owned(s, d), papers(s, d), "query_name", 100)


def bucket_fill(s, d):
    """The years whose papers fit half the corpus, the latest year first of all."""
    sizes = papers(s, d).where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a year
    last = max((r["year"] for r in sizes), default=0)
    taken = set(stats.fill_buckets([(r["year"], r["n"], r["year"] == last) for r in sizes], sum(r["n"] for r in sizes) // 2))
    return s.createDataFrame([(r["year"], r["n"]) for r in sizes if r["year"] in taken], "year int, n long")


def _ingested(source: str):
    def run(s, d):
        return rec.papers_only(rec.derive_papers(source_records(s, d).where(F.col("source") == source))).select("record_id", "title", "doi", "type")

    return run


ingest_openalex, ingest_arxiv, ingest_pubmed = _ingested("openalex"), _ingested("arxiv"), _ingested("pubmed")


def text_moved(s, d):
    m, c = chosen(s, d)
    return groups.text_moved(papers(s, d), groups.merged_fields(papers(s, d), m, c))


def member_progress(s, d):
    now = screening.current(screenings(s, d))
    return screening.member_progress(now, screenings(s, d).select("collection_id", "user_id").distinct())


def cohen_kappa(s, d):
    return screening.cohen_kappa(screening.current(screenings(s, d)))


def krippendorff_alpha(s, d):
    return screening.krippendorff_alpha(screening.current(screenings(s, d)))


def export_csv_cells(s, d):
    return screening.csv_rows(papers(s, d))


def bibtex_key(s, d):
    return screening.bibtex_keys(papers(s, d))


def export_bibtex(s, d):
    return screening.bibtex_entries(papers(s, d))


# evaluation
def recall_at_k(s, d):
    """What an order by the first 128 entries keeps of the exact order, for one query. ``ivf_recall`` measures the cells."""
    near, rough = _rough_lists(s, d)
    whole = search.vector_topk(papers(s, d), query_vector(s, d), 20).select("id", "score")
    of = lambda df: search.ranked(df, 20).select("id", "rank")
    exact = of(near).join(whole, "id").select(F.lit(0).alias("query_id"), "id", "rank", "score")
    found = of(rough).join(whole, "id", "left").select(F.lit(0).alias("query_id"), "id", "rank", F.coalesce("score", F.lit(-1.0)).alias("score"))
    return evaluation.recall_at_k(exact, found, 10)


def _rough_lists(s, d):
    """(exact, rough): the 20 nearest rows by all entries, and by the first 128."""
    p, q = search.sound_vectors(papers(s, d), DIM), query_vector(s, d)
    short = p.withColumn("embedding", F.slice("embedding", 1, 128))
    return search.vector_topk(p, q, 20), search.vector_topk(short, q[:128], 20)


def recall_by_group(s, d):
    near, rough = _rough_lists(s, d)
    of = lambda df: search.ranked(df, 20).select(F.lit(0).alias("query_id"), "id", "rank")
    found = evaluation.recall_by_group(of(near), of(rough), papers(s, d).select("id", (F.col("year") >= 2015).alias("grp")), 20)
    return rounded(found, "recall")


def _ivf_lists(s, d):
    """(exact, found): brute force and the cells' answers to the queries of ``vector_batch_topk``."""
    p = papers(s, d)
    queries = search.sound_vectors(p, DIM).where("id % 20 = 0")
    return search.vector_batch_topk(p, queries, DIM, 10), search.ivf_batch_topk(p, queries, DIM, 10)


def ivf_recall(s, d):
    """The approximate cells' recall at 10 against brute force, for each query of ``vector_batch_topk``."""
    return evaluation.recall_at_k(*_ivf_lists(s, d), 10)


def ivf_recall_by_group(s, d):
    """The same by the found papers' age."""
    exact, found = _ivf_lists(s, d)
    groups = papers(s, d).select("id", (F.col("year") >= 2015).alias("grp"))
    return rounded(evaluation.recall_by_group(exact.select("query_id", "id", "rank"), found.select("query_id", "id", "rank"), groups, 10), "recall")


def fusion_convergence(s, d):
    p, q = papers(s, d), query_vector(s, d)
    kw, vec = search.bm25(p, TEXT, 200), search.vector_topk(p, q, 200)
    out = None
    for depth in (20, 100, 200):
        top = search.fuse(kw, vec, depth).orderBy(F.desc("score"), "id").limit(20).select(F.lit(depth).alias("depth"), F.lit(0).alias("query_id"), "id")
        out = top if out is None else out.unionByName(top)
    return evaluation.convergence(out, out.where("depth = 200"))


def latency_percentiles(s, d):
    return evaluation.percentiles(papers(s, d).where("citation_count < 900000 and citation_count >= 0"), "citation_count", ["year"])


def stability_gate(s, d):
    runs = papers(s, d).where("citation_count < 900000 and citation_count >= 0 and year is not null").groupBy("year", F.pmod("id", F.lit(3)).alias("run")).agg(F.avg("citation_count").alias("v"))
    return rounded(evaluation.stability(runs, "v", ["year"]), "low", "high", "point")


def paired_ratio(s, d):
    return rounded(evaluation.paired_ratio(papers(s, d).where("citation_count < 900000"), "citation_count", "year"), "ratio", places=9)


def _labels(s, d):
    """Scored pairs as labels: merged at the gate, the same where both have one DOI."""
    p = papers(s, d).select("id", "doi")
    rows = scored_pairs(s, d).where("a is not null and b is not null and similarity is not null").select("a", "b", "similarity", "strategy").distinct()
    both = rows.join(p.select(F.col("id").alias("a"), F.col("doi").alias("da")), "a").join(p.select(F.col("id").alias("b"), F.col("doi").alias("db")), "b")
    return both.select(F.col("strategy").alias("stratum"), (F.col("similarity") >= pairs.GATE).alias("merged"), (F.substring_index("da", ".", -1) == F.substring_index("db", ".", -1)).alias("same"))


def weighted_prf(s, d):
    population = scored_pairs(s, d).groupBy(F.col("strategy").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    return evaluation.weighted_prf(_labels(s, d), population)


def binary_kappa(s, d):
    return evaluation.binary_kappa(_labels(s, d), "merged", "same")


def wilson_ci(s, d):
    by = papers(s, d).groupBy("venue").agg(F.count_if("is_retracted").alias("hits"), F.count(F.lit(1)).alias("n"))
    return by.select("venue", "hits", "n", evaluation.wilson(F.col("hits"), F.col("n")).alias("w")).select("venue", "hits", "n", "w.low", "w.high")


def p5_found(s, d):
    return flatten_records(source_records(s, d))


NAMES = [
    *["year_filter", "keyword_match", "keyword_total", "tokenize", "search_keyword_weighted", "search_bm25", "search_cover_density"],
    *["vector_topk", "vector_topk_filtered", "vector_total", "vector_batch_topk", "vector_ivf", "index_bm25", "index_cells_filtered", "search_facade", "hybrid_rrf", "hybrid_sources", "mode_overlap"],
    *["record_upsert", "paper_owner", "paper_link", "paper_refresh", "paper_refresh_all", "ingest_derived", "extract_venue", "extract_authors", "ingest_outcomes", "junk_types", "deinvert_abstract"],
    *["split_budget", "year_slices", "nested_departments", "normalize_doi", "normalize_title", "pairs_doi_exact", "pairs_doi_transform"],
    *["pairs_id_exact", "pairs_abstract_hash", "pairs_abstract_title", "pairs_title_exact", "surname_blocks", "pairs_title_trgm", "preprints"],
    *["pairs_preprint_trgm", "trigram_similarity", "enum_siblings", "part_siblings", "pairs_attributed", "trgm_sweep", "boilerplate_seed"],
    *["source_overlap", "pairs_minus_negative", "dedup_pairs", "components", "group_strategy", "group_verdict", "group_sizes", "chain_report"],
    *["publication_rank", "survivor", "merged_fields", "merge_screening_conflicts", "screening_collapse", "record_repoint", "merge_snapshot"],
    *["merge_roundtrip", "unwind_candidates", "orphan_records", "corpus_totals", "by_source", "records_by_query", "papers_by_query"],
    *["embedding_coverage", "merges_by_strategy", "corr_tail", "bucket_topn", "title_sample", "stratified_sample", "document_text"],
    *["embed_backlog", "embed_hash", "l2_normalize", "screenings_current", "collection_summary", "collection_papers", "conflicts", "resolutions_stale", "member_progress"],
    *["self_resolved", "blinded_view", "reveal_preview", "query_text", "token_hash", "mean_and_error", "bootstrap_precision", "proportional_subset", "bucket_fill"],
    *["ingest_openalex", "ingest_arxiv", "ingest_pubmed", "text_moved"],
    *["cohen_kappa", "krippendorff_alpha", "export_csv_cells", "bibtex_key", "export_bibtex", "recall_at_k", "recall_by_group", "ivf_recall", "ivf_recall_by_group", "fusion_convergence"],
    *["latency_percentiles", "stability_gate", "paired_ratio", "weighted_prf", "binary_kappa", "wilson_ci", "p5_found"],
]


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
