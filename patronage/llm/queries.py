"""Registered queries of the text operators, each over its whole table, and SQL where it can express one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.llm.decontaminate import contained_items
from patronage.llm.exact_dedup import exact_groups
from patronage.llm.html_extract import main_text
from patronage.llm.line_dedup import dedup_lines
from patronage.llm.lm_score import file_blocks, score_documents
from patronage.llm.mixing import mix_documents
from patronage.llm.ngram_join import Similarity, ngram_components
from patronage.llm.quality import grade_documents
from patronage.llm.sharding import shard_rows
from patronage.llm.token_align import align_documents
from patronage.llm.token_counts import count_documents
from patronage.llm.tokens import Vocabulary
from patronage.llm.url_filter import Rule, judge_urls
from patronage.llm.whitening import whiten
from patronage.session import ensure_checkpoint_dir

#: Rules of the url query: verdict, host, path.
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op2_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grade_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return graded.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), "selected")


def op4_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), file_blocks())


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), Similarity(size=3, num=90, den=100))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op8_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    a, b = (Vocabulary.read(path(name), plain=True) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_documents(read(spark, sf_dir, "documents"), a, b)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of the query's own, so that a run encodes every distinct text of the table."""
    from public_tokenizers import path

    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    counted = count_documents(read(spark, sf_dir, "documents"), Vocabulary.read(path("byte_bpe_50k.json")), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_extendible_hash_dedup, op2_template_extraction, op3_ordinal_quality, op4_backoff_score, op5_ngram_jaccard_join,
        op6_url_filter, op7_containment_search, op8_subset_sum_mix, op9_feistel_shards, op10_fuzzy_line_dedup,
        op11_embedding_whitening, op12_token_alignment, op13_token_counts,
    )
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE: dict[str, str] = {
    "op1_extendible_hash_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op6_url_filter": f"""
        WITH r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        a AS (SELECT row_number() OVER () AS n, page_id,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT n, page_id, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        m AS (SELECT n, h || p AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
              FROM b JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b LEFT JOIN m ON b.n = m.n AND k = 1
    """,
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, len(g) AS n, list_sort(list_transform(g, lambda x: hash(x))) AS g FROM s),
        f AS (SELECT doc_id, n, unnest(g) AS x FROM n),
        c AS (SELECT x, count(*) AS df FROM f GROUP BY x HAVING count(*) > 1),
        o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), x) AS k FROM f LEFT JOIN c USING (x)),
        p AS (SELECT doc_id, n, x FROM o WHERE 100 * k <= 10 * n + 100),
        q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
        l AS (SELECT a, b FROM q JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 190 * len(list_intersect(na.g, nb.g)) >= 90 * (na.n + nb.n)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        t AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM t GROUP BY a) m ON m.a = n.doc_id
    """,
}
