"""DuckDB SQL for the named queries, written from the definitions in the survey and not from the Spark code.

``merge_roundtrip`` is compared with a constant: it proves that undoing merges leaves no difference, nothing more.
"""

from __future__ import annotations

STOPS = "'a','an','and','are','as','at','be','by','for','from','in','is','of','on','or','that','the','to','was','were','with'"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({STOPS}))"


def doi(column: str) -> str:
    return (
        f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), '^https://doi.org/', ''), "
        "'^http://doi.org/', ''), '^doi.org/', ''), '^doi:', ''), '')"
    )


def title(column: str) -> str:
    return (
        f"regexp_replace(trim(regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^the ', '')"
    )


def grams(column: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def alike(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 0.0)"


PART = (
    "'^(additional file|additional table|additional figure|supplementary|supplemental|supporting information|appendix"
    "|figure s?[0-9]|table s?[0-9]|data (from|for)|dataset for|multimedia appendix)'"
)


def enum(a: str, b: str) -> str:
    return f"({a} <> {b} AND regexp_replace({a}, '[0-9]+', '#', 'g') = regexp_replace({b}, '[0-9]+', '#', 'g'))"


def part(a: str, b: str) -> str:
    return f"({a} <> {b} AND (regexp_matches({a}, {PART}) OR regexp_matches({b}, {PART})))"


def siblings(a: str, b: str) -> str:
    return f"({enum(a, b)} OR {part(a, b)})"


def star(rows: str, *keys: str) -> str:
    k = ", ".join(keys)
    return (
        f"SELECT low AS a, id AS b, 1.0::DOUBLE AS sim FROM (SELECT id, min(id) OVER (PARTITION BY {k}) AS low FROM ({rows}) "
        f"WHERE {' AND '.join(f'{x} IS NOT NULL' for x in keys)}) WHERE id <> low"
    )


BAND = "abs(length(t) - length(u)) <= ceil(least(length(t), length(u)) * 0.1765) + 2"
SURNAMES = (
    "surnames AS (SELECT DISTINCT id, lower(list_extract(string_split(author, ' '), -1)) AS surname FROM (SELECT id, unnest(authors) AS author FROM papers) "
    "WHERE length(list_extract(string_split(author, ' '), -1)) > 0)"
)
BLOCKED = "rows AS (SELECT p.id, surname, year, title_norm FROM papers p JOIN surnames s ON s.id = p.id WHERE year IS NOT NULL AND length(title_norm) >= 20 AND length(surname) >= 3)"
#: Every work inside a raw text: text in text, result pages and lists are opened.
WORKS = """
    raws AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS j0 FROM source_records),
    inner_json AS (SELECT * EXCLUDE (j0), CASE WHEN json_type(j0) = 'VARCHAR' THEN CASE WHEN json_valid(j0->>'$') THEN (j0->>'$')::JSON END ELSE j0 END AS j FROM raws),
    every AS (SELECT * EXCLUDE (j), unnest(CASE WHEN json_type(j, '$.results') = 'ARRAY' THEN json_extract(j, '$.results[*]') WHEN json_type(j, '$.results') <> 'NULL' THEN [json_extract(j, '$.results')]
                     WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS w FROM inner_json WHERE j IS NOT NULL),
    works AS (SELECT * FROM every WHERE json_type(w) <> 'NULL')"""
MARKED = WORKS + """,
    marks AS (SELECT paper_id FROM source_records WHERE source = 'arxiv' AND paper_id IS NOT NULL UNION SELECT paper_id FROM works WHERE w->>'$.type' = 'preprint' AND paper_id IS NOT NULL)"""
PREPRINT = (
    "(arxiv_id IS NOT NULL OR coalesce(contains(doi, '/preprints.'), false) OR "
    "coalesce(regexp_matches(venue, '(?i)arxiv|biorxiv|medrxiv|preprint|research square|ssrn'), false) OR id IN (SELECT paper_id FROM marks))"
)
TITLE_TRGM = f"""
    met AS (SELECT DISTINCT a, b, t, u FROM (SELECT x.id AS a, y.id AS b, x.title_norm AS t, y.title_norm AS u FROM rows x JOIN rows y USING (surname, year)
            WHERE x.id < y.id AND x.title_norm <> y.title_norm) WHERE {BAND}),
    title_trgm AS (SELECT a, b, t, u, {alike('g', 'h')} AS sim FROM (SELECT *, {grams('t')} AS g, {grams('u')} AS h FROM met) WHERE {alike('g', 'h')} >= 0.85)"""
VECTOR = "vec AS (SELECT id, year, embedding::DOUBLE[] AS e FROM papers WHERE len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)"
NEAREST = VECTOR + ", q AS (SELECT e AS qe FROM vec ORDER BY id LIMIT 1), near AS (SELECT id, year, list_cosine_similarity(e, qe) AS score FROM vec, q)"
ROUGH = NEAREST + ", rough AS (SELECT id, list_cosine_similarity(e[1:128], qe[1:128]) AS score FROM vec, q WHERE list_sum(list_transform(e[1:128], lambda x: abs(x))) > 0)"
BM25 = f"""
    w AS (SELECT id, year, list_concat({words('title')}, {words('abstract')}) AS ws FROM papers),
    st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS mean, count(*) FILTER (list_contains(ws, 'citation')) AS d0, count(*) FILTER (list_contains(ws, 'triage')) AS d1 FROM w),
    tf AS (SELECT w.*, st.*, len(list_filter(ws, lambda x: x = 'citation'))::DOUBLE AS t0, len(list_filter(ws, lambda x: x = 'triage'))::DOUBLE AS t1 FROM w, st
           WHERE list_contains(ws, 'citation') AND list_contains(ws, 'triage')),
    kw AS (SELECT id, year, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                  + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len(ws) / mean)) AS score FROM tf)"""
FUSED = (
    NEAREST
    + ","
    + BM25
    + """,
    k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS keyword_rank FROM kw QUALIFY keyword_rank <= 200),
    v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS vector_rank FROM near QUALIFY vector_rank <= 200),
    fused AS (SELECT id, keyword_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS score, count(*) OVER () AS pool
              FROM k FULL JOIN v USING (id))"""
)
LINKS = "links AS (SELECT a, b, similarity AS sim, strategy FROM pairs WHERE similarity >= 0.92 AND NOT isnan(similarity) AND a IS NOT NULL AND b IS NOT NULL AND a <> b)"
MEMBERS = (
    LINKS
    + """,
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT d.b, r.root FROM reach r JOIN both_ways d ON d.a = r.id WHERE r.root < d.b),
    members AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""
)
RANKED = "list_position(['doi_exact','jmir_doi','id_exact','abstract_hash','title_exact','title_trgm','preprint_trgm'], strategy)"
ATTRIBUTED = f"""
    attributed AS (SELECT a, b, sim, strategy FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, sim, strategy FROM links)
                   QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY {RANKED}, sim DESC) = 1)"""
GROUPS = f"""
    grouped AS (SELECT root, strategy, sim, a, b, {RANKED} AS r FROM attributed JOIN members ON members.id = a),
    groups AS (SELECT root, (SELECT count(*) FROM members m WHERE m.root = g.root) AS size, arg_min(strategy, (r, a, b)) AS strategy, arg_min(sim, (r, a, b)) AS sim,
                      array_to_string(list_sort(list_distinct(list(strategy))), ',') AS strategies FROM grouped g GROUP BY root)"""
RANKS = MARKED + """,
    ranks AS (SELECT id, CASE WHEN id IN (SELECT paper_id FROM marks) OR coalesce(contains(doi, '/preprints.'), false) OR coalesce(regexp_matches(venue, '(?i)arxiv|biorxiv|medrxiv|preprint'), false) THEN 0
                              WHEN venue IS NULL THEN 1 ELSE 2 END AS rank FROM papers)"""
CHOSEN = "chosen AS (SELECT root, arg_max(m.id, (rank, -m.id)) AS survivor FROM members m JOIN ranks USING (id) GROUP BY root)"
CURRENT = """
    last AS (SELECT collection_id, paper_id, user_id, coalesce(decision, '') AS decision, decided_at FROM screenings
             QUALIFY row_number() OVER (PARTITION BY collection_id, paper_id, user_id ORDER BY decided_at DESC NULLS LAST, coalesce(decision, '') DESC) = 1),
    now AS (SELECT * FROM last WHERE decision IN ('include', 'exclude', 'maybe'))"""
CREDIBLE = "citation_count < 900000 AND citation_count >= 0"

DERIVED = f"""
    {WORKS.strip()},
    derived AS (SELECT id AS record_id, source, paper_id, {doi("w->>'$.doi'")} AS doi, nullif(trim(coalesce(w->>'$.display_name', w->>'$.title')), '') AS title, w->>'$.type' AS type FROM works)"""
JUNK = "('paratext', 'editorial', 'erratum', 'supplementary-materials', 'peer-review', 'retraction')"

SQL: dict[str, str] = {
    "self_resolved": f"""
        WITH {CURRENT.strip()}, r AS (SELECT collection_id, paper_id, min(user_id) AS resolved_by, min(decided_at) + INTERVAL 60 DAY AS resolved_at FROM now GROUP BY ALL HAVING count(DISTINCT decision) > 1)
        SELECT collection_id, paper_id, resolved_by, EXISTS (SELECT 1 FROM now n WHERE n.collection_id = r.collection_id AND n.paper_id = r.paper_id AND n.user_id = r.resolved_by AND n.decided_at <= r.resolved_at) AS self_resolved FROM r""",
    "blinded_view": f"""
        WITH {CURRENT.strip()} SELECT collection_id, paper_id, user_id, decision, decided_at FROM now n JOIN collections c ON c.id = n.collection_id
        WHERE user_id <> 1 AND (NOT (mode = 'blind' AND phase = 'screening') OR EXISTS (SELECT 1 FROM now m WHERE m.user_id = 1 AND m.collection_id = n.collection_id AND m.paper_id = n.paper_id))""",
    "reveal_preview": f"""
        WITH {CURRENT.strip()} SELECT collection_id, count(DISTINCT paper_id) AS papers, count(*) AS decisions, count(DISTINCT user_id) AS screeners,
               (SELECT count(*) FROM (SELECT paper_id FROM now m WHERE m.collection_id = n.collection_id GROUP BY paper_id HAVING count(DISTINCT decision) > 1)) AS conflicts FROM now n GROUP BY collection_id""",
    "query_text": "SELECT id, 'Represent this sentence for searching relevant passages: ' || title AS text FROM papers",
    "token_hash": "SELECT id, sha256(title) AS hash FROM papers",
    "mean_and_error": f"""
        SELECT year, count(*) AS n, round(avg(citation_count), 6) AS mean, round(stddev_samp(citation_count), 6) AS stdev, round(stddev_samp(citation_count) / sqrt(count(*)), 6) AS error
        FROM papers WHERE {CREDIBLE} AND year IS NOT NULL GROUP BY year""",
    "proportional_subset": """
        WITH o AS (SELECT DISTINCT query_name, paper_id AS id FROM source_records WHERE query_name IS NOT NULL AND paper_id IS NOT NULL)
        SELECT query_name, id, row_number() OVER (PARTITION BY query_name ORDER BY citation_count DESC NULLS LAST, id) AS rank FROM o JOIN papers USING (id)
        QUALIFY rank <= greatest(1, 100 // (SELECT count(DISTINCT query_name) FROM o))""",
    **{
        f"ingest_{source}": f"""
        WITH {DERIVED} SELECT record_id, title, doi, type FROM derived WHERE source = '{source}' AND title IS NOT NULL AND coalesce(type, '') NOT IN {JUNK}"""
        for source in ("openalex", "arxiv", "pubmed")
    },
    "junk_types": f"""
        WITH {DERIVED} SELECT source, type, count(*) AS n, count(*) FILTER (title IS NOT NULL AND coalesce(type, '') NOT IN {JUNK}) AS kept FROM derived GROUP BY source, type""",
    "paper_link": f"""
        WITH {DERIVED}, d AS (SELECT DISTINCT record_id, doi FROM derived WHERE title IS NOT NULL AND coalesce(type, '') NOT IN {JUNK}),
        held AS (SELECT {doi('doi')} AS doi, min(id) AS held FROM papers WHERE doi IS NOT NULL GROUP BY 1), f AS (SELECT doi, min(record_id) AS f FROM d WHERE doi IS NOT NULL GROUP BY doi)
        SELECT record_id, held AS paper_id, CASE WHEN held IS NULL THEN coalesce(f, record_id) END AS new_record, CASE WHEN held IS NOT NULL OR coalesce(f, record_id) <> record_id THEN 'linked' ELSE 'new' END AS outcome
        FROM d LEFT JOIN held USING (doi) LEFT JOIN f USING (doi)""",
    "ingest_outcomes": """
        WITH m AS (SELECT coalesce(query_name, '(none)') AS query_name, row_number() OVER k AS pos, raw IS DISTINCT FROM lag(raw) OVER k AS other, NOT coalesce(json_valid(raw), false) AS bad,
                          row_number() OVER (PARTITION BY coalesce(paper_id, -id) ORDER BY fetched_at, id) AS nth
                   FROM source_records WINDOW k AS (PARTITION BY source, source_id ORDER BY fetched_at, id))
        SELECT query_name, count(*) AS fetched, count(*) FILTER (pos = 1 AND nth = 1 AND NOT bad) AS new, count(*) FILTER (pos = 1 AND nth > 1 AND NOT bad) AS linked,
               count(*) FILTER (pos > 1 AND NOT bad) AS refreshed, count(*) FILTER (pos > 1 AND NOT bad AND other) AS text_changed, count(*) FILTER (bad) AS skipped FROM m GROUP BY query_name""",
    "extract_venue": f"""
        WITH {WORKS.strip()},
        p AS (SELECT id, w, list_concat([json_extract(w, '$.primary_location')], CASE WHEN json_type(w, '$.locations') = 'ARRAY' THEN json_extract(w, '$.locations[*]') ELSE [json_extract(w, '$.locations')] END) AS places FROM works WHERE source = 'openalex')
        SELECT id, coalesce(list_filter(list_transform(places, lambda x: nullif(trim(x->>'$.source.display_name'), '')), lambda x: x IS NOT NULL)[1],
                            list_filter(list_transform(places, lambda x: nullif(trim(x->>'$.raw_source_name'), '')), lambda x: x IS NOT NULL)[1]) AS venue FROM p""",
    "extract_authors": f"""
        WITH {WORKS.strip()}, p AS (SELECT id, CASE WHEN source = 'openalex' THEN '$.authorships' ELSE '$.authors' END AS k, source, w FROM works),
        l AS (SELECT id, source, CASE WHEN json_type(json_extract(w, k)) = 'ARRAY' THEN json_extract(json_extract(w, k), '$[*]') WHEN json_extract(w, k) IS NOT NULL THEN [json_extract(w, k)] END AS many FROM p)
        SELECT id, nullif(array_to_string(list_filter(list_transform(many, lambda x: nullif(trim(CASE WHEN source = 'openalex' THEN x->>'$.author.display_name' ELSE x->>'$' END), '')), lambda x: x IS NOT NULL), '|'), '') AS authors FROM l""",
    "paper_refresh": f"""
        WITH {WORKS.strip()}, o AS (SELECT paper_id, min(id) AS owner FROM source_records WHERE paper_id IS NOT NULL GROUP BY paper_id),
        n AS (SELECT o.paper_id AS id, nullif(trim(coalesce(w->>'$.display_name', w->>'$.title')), '') AS title, coalesce(try_cast(w->>'$.cited_by_count' AS INT), 0) AS citation_count FROM o JOIN works ON works.id = o.owner AND works.paper_id = o.paper_id)
        SELECT p.id, n.title, {title('n.title')} AS title_norm, n.citation_count FROM n JOIN papers p USING (id)""",
    "unwind_candidates": f"""
        WITH RECURSIVE {{MEMBERS}}, {{ATTRIBUTED}}, {{GROUPS}}, {{RANKS}}, {{CHOSEN}}
        SELECT survivor AS kept_paper_id FROM groups JOIN chosen USING (root)
        WHERE size <= CASE WHEN strategy = 'title_exact' THEN 2 ELSE 8 END AND (SELECT count(*) FROM members m JOIN papers p ON p.id = m.id WHERE m.root = groups.root) > 3""".format(MEMBERS=MEMBERS, ATTRIBUTED=ATTRIBUTED, GROUPS=GROUPS, RANKS=RANKS, CHOSEN=CHOSEN),
    "recall_at_k": f"""
        WITH {ROUGH}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near), f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM rough)
        SELECT 0 AS query_id, (SELECT count(*) FROM f JOIN r USING (id) WHERE f.rank <= 10 AND r.rank <= 10) / 10.0::DOUBLE AS recall""",
    "fusion_convergence": f"""
        WITH {FUSED}, depths AS (SELECT unnest([20, 100, 200]) AS depth),
        s AS (SELECT depth, id, coalesce(CASE WHEN keyword_rank <= depth THEN 1.0::DOUBLE / (60 + keyword_rank) END, 0) + coalesce(CASE WHEN vector_rank <= depth THEN 1.0::DOUBLE / (60 + vector_rank) END, 0) AS score FROM fused, depths WHERE keyword_rank <= depth OR vector_rank <= depth),
        t AS (SELECT depth, id FROM s QUALIFY row_number() OVER (PARTITION BY depth ORDER BY s.score DESC, id) <= 20), u AS (SELECT id FROM t WHERE depth = 200)
        SELECT depth, count(*) FILTER (id IN (SELECT id FROM u)) / (SELECT count(*) FROM u)::DOUBLE AS overlap,
               (count(*) = (SELECT count(*) FROM u) AND count(*) FILTER (id IN (SELECT id FROM u)) = count(*))::INT::DOUBLE AS identical FROM t GROUP BY depth""",
    "year_filter": "SELECT id, year FROM papers WHERE year BETWEEN 2010 AND 2020",
    "keyword_match": f"""
        WITH w AS (SELECT id, ' ' || array_to_string({words('title')}, ' ') || ' ' AS t, ' ' || array_to_string({words('abstract')}, ' ') || ' ' AS a FROM papers)
        SELECT id FROM w WHERE (contains(t, ' citation triage ') OR contains(a, ' citation triage ') OR contains(t, ' reranker ') OR contains(a, ' reranker '))
          AND NOT (contains(t, ' dental ') OR contains(a, ' dental '))""",
    "keyword_total": f"""
        WITH w AS (SELECT list_concat({words('title')}, {words('abstract')}) AS ws FROM papers)
        SELECT count(*) AS total FROM w WHERE list_contains(ws, 'citation') AND list_contains(ws, 'triage')""",
    "tokenize": f"SELECT id, array_to_string({words('title')}, ' ') AS words FROM papers",
    "search_keyword_weighted": f"""
        WITH w AS (SELECT id, {words('title')} AS t, {words('abstract')} AS a FROM papers),
        m AS (SELECT * FROM w WHERE list_contains(list_concat(t, a), 'citation') AND list_contains(list_concat(t, a), 'triage'))
        SELECT id, round(1.0 * len(list_filter(t, lambda x: x IN ('citation', 'triage'))) + 0.4 * len(list_filter(a, lambda x: x IN ('citation', 'triage'))), 6)::DOUBLE AS score
        FROM m ORDER BY score DESC, id LIMIT 20""",
    "search_bm25": f"WITH {BM25} SELECT id, round(score, 6) AS score FROM kw WHERE year BETWEEN 2010 AND 2020 ORDER BY kw.score DESC, id LIMIT 20",
    "index_bm25": f"WITH {BM25} SELECT id, round(score, 6) AS score FROM kw WHERE year BETWEEN 2010 AND 2020 ORDER BY kw.score DESC, id LIMIT 20",
    "vector_topk": f"WITH {NEAREST} SELECT id, round(score, 6) AS score FROM near ORDER BY near.score DESC, id LIMIT 20",
    "vector_topk_filtered": f"WITH {NEAREST} SELECT id, round(score, 6) AS score FROM near WHERE year BETWEEN 2010 AND 2020 ORDER BY near.score DESC, id LIMIT 20",
    "vector_total": f"WITH {VECTOR} SELECT count(*) AS total FROM vec",
    "vector_batch_topk": f"""
        WITH {VECTOR}, s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS score FROM vec q, vec v WHERE q.id % 20 = 0)
        SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "hybrid_rrf": f"""
        WITH {FUSED}, top AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 20)
        SELECT id, doi, title, year, keyword_rank, vector_rank, round(score, 9) AS score, pool,
               CASE WHEN vector_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'vector' ELSE 'keyword+vector' END AS sources
        FROM top JOIN papers USING (id)""",
    "hybrid_sources": f"WITH {FUSED} SELECT CASE WHEN vector_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'vector' ELSE 'both' END AS arms, count(*) AS n FROM fused GROUP BY 1",
    "mode_overlap": f"""
        WITH {FUSED} SELECT count(*) FILTER (keyword_rank <= 20 AND vector_rank <= 20) AS common,
               count(*) FILTER (keyword_rank <= 20 AND (vector_rank IS NULL OR vector_rank > 20)) AS only_a,
               count(*) FILTER (vector_rank <= 20 AND (keyword_rank IS NULL OR keyword_rank > 20)) AS only_b FROM fused""",
    "record_upsert": """
        SELECT source, source_id, arg_max(id, (fetched_at, id)) AS id, max(fetched_at) AS fetched_at,
               (SELECT paper_id FROM source_records x WHERE x.source = r.source AND x.source_id = r.source_id ORDER BY fetched_at DESC, id DESC LIMIT 1) AS paper_id,
               arg_min(query_name, (fetched_at, id)) FILTER (query_name IS NOT NULL) AS query_name, count(*) AS fetches
        FROM source_records r GROUP BY source, source_id""",
    "paper_owner": "SELECT paper_id, min(id) AS owner FROM source_records WHERE paper_id IS NOT NULL GROUP BY paper_id",
    "deinvert_abstract": "SELECT id, abstract FROM papers WHERE abstract IS NOT NULL",
    "split_budget": """
        WITH w AS (SELECT year AS idx, count(*)::DOUBLE AS weight FROM papers WHERE year IS NOT NULL GROUP BY year),
        e AS (SELECT idx, weight * 1000 / sum(weight) OVER () AS exact FROM w),
        f AS (SELECT idx, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, idx) AS pos FROM e)
        SELECT idx, (base + CASE WHEN pos <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM f""",
    "year_slices": "SELECT CASE WHEN year > 2014 THEN year::VARCHAR WHEN year IS NOT NULL THEN 'pre' ELSE 'none' END AS slice, count(*) AS n FROM papers GROUP BY 1",
    "normalize_doi": f"SELECT id, {doi('doi')} AS doi FROM papers",
    "normalize_title": f"SELECT id, {title('title')} AS title FROM papers",
    "pairs_doi_exact": star("SELECT id, doi FROM papers", "doi"),
    "pairs_doi_transform": f"""
        WITH d AS (SELECT id, {doi('doi')} AS doi FROM papers)
        SELECT DISTINCT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, 1.0::DOUBLE AS sim FROM d p JOIN d q ON replace(p.doi, '/v1', '') = q.doi WHERE contains(p.doi, '/v1') AND p.id <> q.id""",
    "pairs_id_exact": f"{star('SELECT id, arxiv_id FROM papers', 'arxiv_id')} UNION {star('SELECT id, pubmed_id FROM papers', 'pubmed_id')}",
    "pairs_abstract_hash": "WITH b AS (SELECT abstract AS x FROM papers WHERE abstract IS NOT NULL GROUP BY abstract HAVING length(abstract) < 50 OR (length(abstract) < 100 AND count(*) >= 5)) "
    + star("SELECT id, abstract FROM papers WHERE abstract NOT IN (SELECT x FROM b)", "abstract"),
    "pairs_abstract_title": f"""
        WITH b AS (SELECT abstract AS x FROM papers WHERE abstract IS NOT NULL GROUP BY abstract HAVING length(abstract) < 50 OR (length(abstract) < 100 AND count(*) >= 5)),
        p AS (SELECT id, abstract AS k, title_norm AS t FROM papers WHERE abstract NOT IN (SELECT x FROM b) AND title_norm IS NOT NULL),
        low AS (SELECT k, t, min(id) AS id, {grams('any_value(t)')} AS g FROM p GROUP BY k, t)
        {star('SELECT * FROM p', 'k', 't')}
        UNION ALL
        SELECT a, b, round(sim, 6) AS sim FROM (SELECT x.id AS a, y.id AS b, {alike('x.g', 'y.g')} AS sim FROM low x JOIN low y USING (k)
        WHERE x.id < y.id AND NOT {siblings('x.t', 'y.t')}) WHERE sim >= 0.8""",
    "pairs_title_exact": star("SELECT id, title_norm, year FROM papers WHERE length(title_norm) >= 20", "title_norm", "year"),
    "surname_blocks": f"WITH {SURNAMES} SELECT id, surname FROM surnames",
    "pairs_title_trgm": f"WITH {SURNAMES}, {BLOCKED}, {TITLE_TRGM} SELECT a, b, round(sim, 6) AS sim FROM title_trgm",
    "preprints": f"WITH {MARKED} SELECT id FROM papers WHERE {PREPRINT}",
    "pairs_preprint_trgm": f"""
        WITH {SURNAMES}, {BLOCKED}, {MARKED}, early AS (SELECT rows.* FROM rows JOIN papers USING (id) WHERE {PREPRINT}),
        met AS (SELECT DISTINCT a, b, t, u FROM (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CASE WHEN x.id < y.id THEN x.title_norm ELSE y.title_norm END AS t,
                CASE WHEN x.id < y.id THEN y.title_norm ELSE x.title_norm END AS u FROM early x JOIN rows y ON x.surname = y.surname AND abs(x.year - y.year) = 1 AND x.id <> y.id) WHERE {BAND})
        SELECT a, b, round(sim, 6) AS sim FROM (SELECT a, b, {alike('g', 'h')} AS sim FROM (SELECT *, {grams('t')} AS g, {grams('u')} AS h FROM met)) WHERE sim >= 0.85""",
    "trigram_similarity": f"""
        WITH p AS (SELECT DISTINCT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT a, b, round({alike('g', 'h')}, 6) AS sim FROM (SELECT a, b, {grams('x.title_norm')} AS g, {grams('y.title_norm')} AS h FROM p JOIN papers x ON x.id = a JOIN papers y ON y.id = b)""",
    "enum_siblings": f"""
        WITH p AS (SELECT DISTINCT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT a, b, {enum('x.title_norm', 'y.title_norm')} AS siblings FROM p JOIN papers x ON x.id = a JOIN papers y ON y.id = b""",
    "part_siblings": f"""
        WITH p AS (SELECT DISTINCT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT a, b, {part('x.title_norm', 'y.title_norm')} AS siblings FROM p JOIN papers x ON x.id = a JOIN papers y ON y.id = b""",
    "pairs_attributed": f"WITH {LINKS}, {ATTRIBUTED} SELECT a, b, round(sim, 6) AS sim, strategy FROM attributed",
    "trgm_sweep": f"""
        WITH {SURNAMES}, {BLOCKED}, {TITLE_TRGM}, th AS (SELECT unnest([0.85, 0.90, 0.92, 0.95, 0.98])::DOUBLE AS threshold)
        SELECT threshold, count(*) FILTER (sim >= threshold AND NOT {siblings('t', 'u')}) AS kept, count(*) FILTER (sim >= threshold AND {siblings('t', 'u')}) AS refused
        FROM th, title_trgm GROUP BY threshold""",
    "boilerplate_seed": """
        SELECT md5(abstract) AS abstract_md5, CASE WHEN length(abstract) < 50 THEN 'too short' ELSE 'short and shared' END AS reason, count(*) AS n, substr(abstract, 1, 120) AS sample
        FROM papers WHERE abstract IS NOT NULL GROUP BY abstract HAVING length(abstract) < 50 OR (length(abstract) < 100 AND count(*) >= 3)""",
    "source_overlap": f"""
        WITH l AS (SELECT {doi('doi')} AS d, {title('title')} AS t FROM arxiv_fields), r AS (SELECT {doi('doi')} AS d, {title('title')} AS t FROM pubmed_fields)
        SELECT CASE WHEN d IN (SELECT d FROM r WHERE d IS NOT NULL) THEN 'doi' WHEN t IN (SELECT t FROM r WHERE t IS NOT NULL) THEN 'title' ELSE 'none' END AS how, count(*) AS n FROM l GROUP BY 1""",
    "pairs_minus_negative": f"""
        WITH {LINKS} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links
        EXCEPT SELECT least(a, b), greatest(a, b) FROM links WHERE strategy = 'title_trgm'""",
    "components": f"WITH RECURSIVE {MEMBERS} SELECT id, root FROM members",
    "group_strategy": f"WITH RECURSIVE {MEMBERS}, {ATTRIBUTED}, {GROUPS} SELECT root, size, strategy, round(sim, 6) AS sim, strategies FROM groups",
    "group_verdict": f"""
        WITH RECURSIVE {MEMBERS}, {ATTRIBUTED}, {GROUPS}, held AS (SELECT DISTINCT root FROM members JOIN papers USING (id) WHERE is_retracted)
        SELECT root, size, strategy, CASE WHEN size > CASE WHEN strategy = 'title_exact' THEN 2 ELSE 8 END THEN 'flagged' WHEN root IN (SELECT root FROM held) THEN 'withheld' ELSE 'mergeable' END AS verdict FROM groups""",
    "group_sizes": f"WITH RECURSIVE {MEMBERS} SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM members GROUP BY root) GROUP BY size",
    "chain_report": f"""
        WITH RECURSIVE {MEMBERS}, {ATTRIBUTED}, s AS (SELECT root, count(*) AS size FROM members GROUP BY root HAVING count(*) >= 4),
        e AS (SELECT root, count(*) AS edges FROM attributed JOIN members ON members.id = a GROUP BY root),
        t AS (SELECT root, m.id, {grams('title_norm')} AS g FROM members m JOIN s USING (root) JOIN papers p ON p.id = m.id WHERE title_norm IS NOT NULL),
        v AS (SELECT x.root, {alike('x.g', 'y.g')} AS sim FROM t x JOIN t y ON x.root = y.root AND x.id < y.id),
        l AS (SELECT root, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS min_sim FROM v GROUP BY root)
        SELECT root, size, edges, round(edges / (size * (size - 1) / 2.0), 6)::DOUBLE AS density, mean_sim, min_sim FROM s JOIN e USING (root) LEFT JOIN l USING (root)""",
    "publication_rank": f"WITH {RANKS.strip()} SELECT id, rank FROM ranks",
    "survivor": f"WITH RECURSIVE {MEMBERS}, {RANKS}, {CHOSEN} SELECT root, survivor FROM chosen",
    "merged_fields": f"""
        WITH RECURSIVE {MEMBERS}, {RANKS}, {CHOSEN}, r AS (SELECT m.root, survivor, p.*, (p.id <> survivor) AS other FROM members m JOIN chosen USING (root) JOIN papers p ON p.id = m.id)
        SELECT root, survivor, any_value(title) FILTER (NOT other) AS title, any_value(abstract) FILTER (NOT other) AS abstract, any_value(venue) FILTER (NOT other) AS venue, any_value(year) FILTER (NOT other) AS year,
               max(citation_count) AS citation_count, bool_or(is_retracted) AS is_retracted,
               arg_min(doi, (other, id)) FILTER (doi IS NOT NULL) AS doi, arg_min(arxiv_id, (other, id)) FILTER (arxiv_id IS NOT NULL) AS arxiv_id,
               arg_min(pubmed_id, (other, id)) FILTER (pubmed_id IS NOT NULL) AS pubmed_id, array_to_string(arg_min(authors, (other, id)) FILTER (authors IS NOT NULL), '|') AS authors
        FROM r GROUP BY root, survivor""",
    "merge_screening_conflicts": f"""
        WITH RECURSIVE {MEMBERS}, {CURRENT}
        SELECT root, collection_id, user_id, count(DISTINCT decision) AS decisions FROM now JOIN members ON members.id = paper_id GROUP BY ALL HAVING count(DISTINCT decision) > 1""",
    "screening_collapse": f"""
        WITH RECURSIVE {MEMBERS}, {RANKS}, {CHOSEN}, {CURRENT}, map AS (SELECT id, survivor FROM members JOIN chosen USING (root)),
        moved AS (SELECT now.*, coalesce(survivor, paper_id) AS target FROM now LEFT JOIN map ON map.id = paper_id)
        SELECT collection_id, target AS paper_id, user_id, decision, decided_at FROM moved
        QUALIFY row_number() OVER (PARTITION BY collection_id, target, user_id ORDER BY (paper_id = target) DESC, decided_at DESC, paper_id) = 1""",
    "record_repoint": f"""
        WITH RECURSIVE {MEMBERS}, {RANKS}, {CHOSEN}, map AS (SELECT id, survivor FROM members JOIN chosen USING (root))
        SELECT r.id, coalesce(survivor, paper_id) AS paper_id FROM source_records r LEFT JOIN map ON map.id = paper_id""",
    "orphan_records": "SELECT id, paper_id FROM source_records r WHERE paper_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.id = r.paper_id)",
    "merge_roundtrip": "SELECT 0::BIGINT AS differences",
    "corpus_totals": """
        SELECT count(*) AS papers, count(*) FILTER (is_retracted) AS retracted, count(abstract) AS with_abstract, count(doi) AS with_doi, count(embedding) AS embedded,
               min(year) AS first_year, max(year) AS last_year FROM papers""",
    "by_source": "SELECT source, count(*) AS records, count(DISTINCT source_id) AS distinct_records, count(DISTINCT paper_id) AS papers FROM source_records GROUP BY source",
    "records_by_query": "SELECT coalesce(query_name, '(unknown)') AS query_name, count(*) AS n FROM source_records GROUP BY 1",
    "papers_by_query": """
        WITH f AS (SELECT query_name FROM source_records WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY fetched_at, id) = 1)
        SELECT coalesce(query_name, '(unknown)') AS query_name, count(*) AS n FROM f GROUP BY 1""",
    "embedding_coverage": """
        WITH o AS (SELECT DISTINCT paper_id FROM source_records WHERE source <> 'openalex' AND paper_id IS NOT NULL)
        SELECT count(*) AS total, count(embedding) AS embedded, count(*) FILTER (embedding IS NULL) AS missing,
               count(*) FILTER (embedding IS NULL AND id IN (SELECT paper_id FROM o)) AS awaiting_dedup,
               count(*) FILTER (embedding IS NULL AND id NOT IN (SELECT paper_id FROM o) AND created_at < TIMESTAMP '2024-12-31 23:00:00') AS stalled FROM papers""",
    "merges_by_strategy": "SELECT strategy, count(*) AS n, min(similarity) AS low, max(similarity) AS high FROM pairs GROUP BY strategy",
    "corr_tail": f"""
        WITH p AS (SELECT year::DOUBLE AS x, citation_count::DOUBLE AS y FROM papers WHERE year IS NOT NULL AND {CREDIBLE}),
        r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
        SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r""",
    "bucket_topn": """
        WITH o AS (SELECT DISTINCT query_name, paper_id AS id FROM source_records WHERE query_name IS NOT NULL AND paper_id IS NOT NULL)
        SELECT query_name, id, row_number() OVER (PARTITION BY query_name ORDER BY citation_count DESC NULLS LAST, id) AS rank FROM o JOIN papers USING (id) QUALIFY rank <= 5""",
    "title_sample": """
        WITH r AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, greatest(1, (SELECT count(*) FROM papers) // 50) AS step FROM papers)
        SELECT id FROM r WHERE (pos - 1) % step = 0 AND pos <= step * 50""",
    "stratified_sample": "SELECT venue AS stratum, id FROM papers QUALIFY row_number() OVER (PARTITION BY venue ORDER BY md5(id::VARCHAR || 's'), id) <= 3",
    "document_text": "SELECT id, CASE WHEN length(trim(coalesce(abstract, ''))) > 0 THEN title || '. ' || abstract ELSE title END AS text FROM papers",
    "embed_backlog": """
        WITH b AS (SELECT abstract AS x FROM papers WHERE abstract IS NOT NULL GROUP BY abstract HAVING length(abstract) < 50 OR (length(abstract) < 100 AND count(*) >= 5))
        SELECT id, CASE WHEN abstract IN (SELECT x FROM b) THEN title WHEN length(trim(coalesce(abstract, ''))) > 0 THEN title || '. ' || abstract ELSE title END AS text FROM papers WHERE embedding IS NULL""",
    "l2_normalize": f"WITH {VECTOR}, n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS l FROM vec) SELECT id, round(e[1] / l, 6) AS first, round(e[384] / l, 6) AS last FROM n",
    "screenings_current": f"WITH {CURRENT.strip()} SELECT collection_id, paper_id, user_id, decision, decided_at FROM now",
    "collection_summary": f"""
        WITH {CURRENT.strip()} SELECT c.id AS collection_id, c.name, count(DISTINCT paper_id) AS papers, count(DISTINCT user_id) AS raters, count(*) FILTER (decision = 'include') AS include,
               count(*) FILTER (decision = 'exclude') AS exclude, count(*) FILTER (decision = 'maybe') AS maybe FROM collections c LEFT JOIN now ON now.collection_id = c.id GROUP BY c.id, c.name""",
    "collection_papers": f"""
        WITH {CURRENT.strip()} SELECT collection_id, paper_id, user_id, decision, title, year FROM now JOIN papers ON papers.id = paper_id WHERE decision = 'include'""",
    "recall_by_group": f"""
        WITH {ROUGH}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near),
        f AS (SELECT id FROM rough ORDER BY score DESC, id LIMIT 20)
        SELECT (year >= 2015) AS grp, count(*) AS wanted, count(*) FILTER (id IN (SELECT id FROM f)) AS hits, round(count(*) FILTER (id IN (SELECT id FROM f)) / count(*)::DOUBLE, 6) AS recall
        FROM r JOIN papers USING (id) WHERE rank <= 20 GROUP BY 1""",
    "conflicts": f"""
        WITH {CURRENT.strip()} SELECT collection_id, paper_id, count(*) AS raters, count(DISTINCT decision) AS decisions, array_to_string(list_sort(list_distinct(list(decision))), ',') AS said
        FROM now GROUP BY collection_id, paper_id HAVING count(DISTINCT decision) > 1""",
    "resolutions_stale": f"""
        WITH {CURRENT.strip()} SELECT collection_id, paper_id, coalesce(max(decided_at) > min(decided_at) + INTERVAL 60 DAY, false) AS stale FROM now
        GROUP BY collection_id, paper_id HAVING count(DISTINCT decision) > 1""",
    "member_progress": f"""
        WITH {CURRENT.strip()}, m AS (SELECT DISTINCT collection_id, user_id FROM screenings)
        SELECT m.collection_id, m.user_id, count(now.decision) AS decided FROM m LEFT JOIN now ON now.collection_id = m.collection_id AND now.user_id = m.user_id GROUP BY ALL""",
    "cohen_kappa": f"""
        WITH {CURRENT.strip()}, p AS (SELECT x.collection_id, x.user_id AS user_a, y.user_id AS user_b, x.decision AS da, y.decision AS db FROM now x JOIN now y USING (collection_id, paper_id) WHERE x.user_id < y.user_id),
        c AS (SELECT collection_id, user_a, user_b, count(*)::DOUBLE AS n, count(*) FILTER (da = db) / count(*)::DOUBLE AS po,
              (count(*) FILTER (da = 'include') * count(*) FILTER (db = 'include') + count(*) FILTER (da = 'exclude') * count(*) FILTER (db = 'exclude')
               + count(*) FILTER (da = 'maybe') * count(*) FILTER (db = 'maybe')) / (count(*) * count(*))::DOUBLE AS pe FROM p GROUP BY collection_id, user_a, user_b)
        SELECT collection_id, user_a, user_b, n::BIGINT AS n, round(po, 4) AS po, round(pe, 4) AS pe, CASE WHEN n >= 30 AND abs(1 - pe) >= 1e-12 THEN round((po - pe) / (1 - pe), 4) END AS kappa FROM c""",
    "krippendorff_alpha": f"""
        WITH {CURRENT.strip()}, v AS (SELECT collection_id, paper_id, decision, count(*)::DOUBLE AS c FROM now GROUP BY ALL),
        i AS (SELECT collection_id, paper_id, sum(c) AS m, sum(c) - sum(c * (c - 1)) / nullif(sum(c) - 1, 0) AS apart FROM v GROUP BY ALL HAVING sum(c) > 1),
        t AS (SELECT collection_id, decision, sum(c) AS c FROM v JOIN i USING (collection_id, paper_id) GROUP BY ALL),
        s AS (SELECT collection_id, sum(c) AS n, sum(c * c) AS sq FROM t GROUP BY collection_id),
        d AS (SELECT collection_id, count(*) AS items, sum(apart) AS apart FROM i GROUP BY collection_id)
        SELECT collection_id, items, CASE WHEN items >= 50 AND (n * n - sq) / (n * (n - 1)) > 1e-12 THEN round(1 - (apart / n) / ((n * n - sq) / (n * (n - 1))), 4) END AS alpha FROM d JOIN s USING (collection_id)""",
    "export_csv_cells": "SELECT id, "
    + ", ".join(
        f"CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE coalesce({c}, '') END AS {n}"
        for c, n in [("title", "title"), ("array_to_string(authors, '; ')", "authors"), ("year::VARCHAR", "year"), ("venue", "venue"), ("doi", "doi"), ("citation_count::VARCHAR", "citation_count")]
    )
    + ", CASE WHEN is_retracted THEN 'yes' WHEN NOT is_retracted THEN 'no' ELSE '' END AS is_retracted FROM papers",
    "bibtex_key": """
        WITH b AS (SELECT id, regexp_replace(lower(coalesce(list_extract(string_split(authors[1], ' '), -1), 'anon')), '[^a-z0-9]', '', 'g') || coalesce(year::VARCHAR, 'nd')
                   || regexp_replace(lower(coalesce(nullif(regexp_split_to_array(trim(title), '\\s+')[1], ''), 'untitled')), '[^a-z0-9]', '', 'g') AS base FROM papers),
        n AS (SELECT id, CASE WHEN base = '' THEN 'entry' ELSE base END AS base FROM b), k AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 2 AS pos FROM n)
        SELECT id, base || CASE WHEN pos < 0 THEN '' WHEN pos < 26 THEN chr((97 + pos)::INT) ELSE chr((96 + pos // 26)::INT) || chr((97 + pos % 26)::INT) END AS key FROM k""",
    "latency_percentiles": f"""
        WITH s AS (SELECT year, citation_count, row_number() OVER (PARTITION BY year ORDER BY citation_count) AS pos, count(*) OVER (PARTITION BY year) AS n FROM papers WHERE {CREDIBLE})
        SELECT year, p::DOUBLE AS p, n, CASE WHEN round(n * (1 - p), 6) >= 5 THEN citation_count END AS value FROM s, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE pos = ceil(p * n)""",
    "stability_gate": f"""
        WITH r AS (SELECT year, id % 3 AS run, avg(citation_count) AS v FROM papers WHERE {CREDIBLE} AND year IS NOT NULL GROUP BY 1, 2)
        SELECT year, round(min(v), 6) AS low, round(max(v), 6) AS high, CASE WHEN max(v) <= 1.3 * min(v) THEN round(quantile_cont(v, 0.5), 6) END AS point FROM r GROUP BY year""",
    "paired_ratio": """
        SELECT count(*) AS n, round(quantile_cont(citation_count / year::DOUBLE, 0.5), 9) AS ratio FROM papers WHERE citation_count < 900000 AND citation_count > 0 AND year > 0""",
    "weighted_prf": """
        WITH r AS (SELECT DISTINCT a, b, similarity, strategy FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND similarity IS NOT NULL),
        l AS (SELECT strategy, similarity >= 0.92 AS merged, list_extract(string_split(x.doi, '.'), -1) = list_extract(string_split(y.doi, '.'), -1) AS same FROM r JOIN papers x ON x.id = a JOIN papers y ON y.id = b),
        w AS (SELECT strategy, (SELECT count(*) FROM pairs p WHERE p.strategy = l.strategy) / count(*)::DOUBLE AS w FROM l WHERE same IS NOT NULL GROUP BY strategy),
        s AS (SELECT sum(w) FILTER (merged AND same) AS tp, sum(w) FILTER (merged AND NOT same) AS fp, sum(w) FILTER (NOT merged AND same) AS fn FROM l JOIN w USING (strategy) WHERE same IS NOT NULL),
        z AS (SELECT coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM s),
        q AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM z)
        SELECT round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1 FROM q""",
    "binary_kappa": """
        WITH r AS (SELECT DISTINCT a, b, similarity, strategy FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND similarity IS NOT NULL),
        l AS (SELECT similarity >= 0.92 AS x, list_extract(string_split(p.doi, '.'), -1) = list_extract(string_split(q.doi, '.'), -1) AS y FROM r JOIN papers p ON p.id = a JOIN papers q ON q.id = b),
        t AS (SELECT count(*) AS n, count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM l WHERE y IS NOT NULL),
        k AS (SELECT *, ("both" + neither) / n::DOUBLE AS po, ("both" + only_a) / n::DOUBLE AS ya, ("both" + only_b) / n::DOUBLE AS yb FROM t)
        SELECT n, "both", only_a, only_b, neither, CASE WHEN n > 0 AND abs(1 - (ya * yb + (1 - ya) * (1 - yb))) >= 1e-12
               THEN round((po - (ya * yb + (1 - ya) * (1 - yb))) / (1 - (ya * yb + (1 - ya) * (1 - yb))), 4) END AS kappa FROM k""",
    "wilson_ci": """
        WITH v AS (SELECT venue, count(*) FILTER (is_retracted) AS hits, count(*) AS n FROM papers GROUP BY venue),
        w AS (SELECT *, hits / n::DOUBLE AS p, 1.96 * 1.96 / n AS z FROM v)
        SELECT venue, hits, n, round(greatest(0.0, ((p + z / 2) / (1 + z) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n)) / (1 + z))), 4)::DOUBLE AS low,
               round(least(1.0, ((p + z / 2) / (1 + z) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n)) / (1 + z))), 4)::DOUBLE AS high FROM w""",
}
