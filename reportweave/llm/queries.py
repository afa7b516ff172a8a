"""Queries over whole tables, one for each operation, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.llm.centroids import DIMENSIONS, K, ROUNDS, SCALE, SEED, cluster_vectors
from reportweave.llm.collocations import LEAST, LONGEST, TOP, collocations
from reportweave.llm.common import documents
from reportweave.llm.decontaminate import contaminated
from reportweave.llm.fingerprints import document_fingerprints
from reportweave.llm.language_id import identify_language
from reportweave.llm.license_scan import scan_licenses
from reportweave.llm.line_dedup import line_report
from reportweave.llm.min_max import SHARE, SHINGLE, shingle_components
from reportweave.llm.mixing import mix_sizes
from reportweave.llm.near_dedup import near_duplicates
from reportweave.llm.quality import judge_quality
from reportweave.llm.token_counts import count_tokens
from reportweave.llm.toxicity import score_toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts and their languages the paths."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = F.concat_ws("/", "source", "lang")
    return judge_quality(documents(spark, sf_dir), labels, F.col("source"), path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_collocations": op11_collocations,
    "op12_min_max": op12_min_max,
    "op13_centroids": op13_centroids,
}


def _collocations_sql() -> str:
    parts = " union all ".join(
        f"select lang, {n} as size, list_slice(w, i, i + {n - 1}) as words from "
        f"(select lang, w, unnest(range(1, len(w) - {n - 2})) as i from pieces where len(w) >= {n})"
        for n in range(1, LONGEST + 1))
    return rf"""
        with split as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), pieces as materialized (
            select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from split
        ), totals as (
            select lang, sum(len(w))::bigint as n from pieces group by lang
        ), counts as materialized (
            select lang, size, words, count(*)::bigint as f from ({parts}) group by all having count(*) >= {LEAST}
        ), candidates as (
            select * from counts where size >= 2
        ), cuts as (
            select lang, words, f as a, unnest(range(1, size)) as k from candidates
        ), scored as (
            select c.lang, c.words, c.a, c.k, l.f as l, r.f as r, n,
                   ((1000::hugeint * c.a * n) // (l.f::hugeint * r.f))::bigint as score
            from cuts c join totals t on t.lang = c.lang
            join counts l on l.lang = c.lang and l.words = list_slice(c.words, 1, k)
            join counts r on r.lang = c.lang and r.words = list_slice(c.words, k + 1, len(c.words))
        ), best as (
            select * from scored qualify row_number() over (partition by lang, words order by score, k) = 1
        ), inner_parts as (
            select lang, f, words, size, unnest(range(2, size)) as m from candidates
        ), around as (
            select lang, list_slice(words, i, i + m - 1) as words, max(f) as most
            from (select lang, f, words, m, unnest(range(1, size - m + 2)) as i from inner_parts) group by all
        ), kept as (
            select b.*, array_to_string(b.words, ' ') as phrase from best b
            left join around o on o.lang = b.lang and o.words = b.words
            where most is null or most < b.a
        )
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
               phrase, a, l, r, n, score
        from kept qualify rank <= {TOP}
    """


def _min_max_sql() -> str:
    """Exact similarity of all pairs that share a shingle, then the smallest id reachable."""
    return rf"""
        with recursive split as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as w
            from documents
        ), runs as (
            select doc_id, case when len(w) < {SHINGLE} then list_slice(w, 1, len(w)) else list_slice(w, i, i + {SHINGLE - 1}) end as run
            from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as i from split where len(w) > 0)
        ), shingles as materialized (
            select doc_id, array_to_string(run, ' ') || len(run) as run from runs group by all
        ), sizes as materialized (
            select doc_id, count(*) as n from shingles group by doc_id
        ), shared as (
            select a.doc_id as x, b.doc_id as y, count(*) as common
            from shingles a join shingles b on a.run = b.run and a.doc_id < b.doc_id group by all
        ), links as materialized (
            select x, y from shared join sizes s on s.doc_id = x join sizes t on t.doc_id = y
            where 100 * common >= {SHARE} * (s.n + t.n - common)
        ), edges as materialized (
            select x, y from links union select y, x from links
        ), reach(node, root) as (
            select doc_id, doc_id from documents
            union
            select y, root from reach join edges on x = node where root < y
        ), least as (
            select node, min(root) as root from reach group by node
        )
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, root as component_id, d.doc_id = root as kept
        from documents d join least on node = d.doc_id left join sizes s on s.doc_id = d.doc_id
    """


def _centroids_sql() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as materialized (
            select row_id, arg_min(cluster, d * {K} + cluster) as cluster, min(d) as d
            from (select row_id, cluster, list_sum(list_transform(range(1, {DIMENSIONS + 1}),
                      lambda j: (v[j] - c[j]) * (v[j] - c[j]))) as d from kept, c{i}) group by row_id
        )""")
        if i < ROUNDS:
            steps.append(f"""m{i} as (
            select cluster, j, sum(x)::hugeint as s, count(*)::hugeint as n from
            (select cluster, unnest(v) as x, unnest(range(1, {DIMENSIONS + 1})) as j from kept join a{i} using (row_id)) group by all
        ), c{i + 1} as materialized (
            select o.cluster, coalesce(moved.c, o.c) as c from c{i} o left join
            (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as c from m{i} group by cluster) moved
            on moved.cluster = o.cluster
        )""")
    return f"""
        with kept as materialized (
            select row_number() over () as row_id, vec_id,
                   list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
            from embeddings where len(embedding) = {DIMENSIONS}
            and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}
        ), c0 as materialized (
            select (row_number() over (order by h nulls last, v) - 1)::int as cluster, v as c
            from (select sha256('{SEED}:' || vec_id) as h, v from kept) order by h nulls last, v limit {K}
        ), {", ".join(steps)}, totals as (
            select cluster, sum(d)::bigint as cluster_inertia from a{ROUNDS} group by cluster
        )
        select vec_id, a.cluster, d::bigint as distance, cluster_inertia,
               (select sum(cluster_inertia) from totals)::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from kept join a{ROUNDS} a using (row_id) join totals t on t.cluster = a.cluster
        join c{ROUNDS} e on e.cluster = a.cluster
    """


ORACLE_SQL = {
    "op4_mixing": r"""
        with sized as (
            select doc_id, source, md5(coalesce(doc_id::varchar, '')) as slot,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
            from documents
        ), sources as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
            from sized group by source
        ), weighed as (
            select *, [5, 2, 1][((place - 1) % 3 + 1)::int]::bigint as weight from sources
        ), ordered as (
            select *, 3 * source_size / weight as full_at,
                   (sum(source_size) over ())::bigint as budget from weighed
        ), levels as (
            select *, (budget - coalesce(3 * sum(source_size) over
                        (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint)
                      / sum(weight) over
                        (order by full_at, source nulls last rows between current row and unbounded following)::bigint
                      as level
            from ordered
        ), targets as (
            select source, source_size,
                   least(weight * (select max(level) from levels), (3 * source_size)::double) as target
            from levels
        ), running as (
            select sized.*, sum(size) over (partition by source order by slot, doc_id nulls first, size
                       rows between unbounded preceding and current row)::bigint as done
            from sized
        )
        select r.doc_id, r.size, t.source_size, t.target,
               (r.size * ((2 * r.done - r.size <= 2 * t.target)::int
                   + (2 * (t.source_size + r.done) - r.size <= 2 * t.target)::int
                   + (2 * (2 * t.source_size + r.done) - r.size <= 2 * t.target)::int))::bigint as taken
        from running r join targets t on r.source is not distinct from t.source
    """,
    "op11_collocations": _collocations_sql(),
    "op12_min_max": _min_max_sql(),
    "op13_centroids": _centroids_sql(),
}
