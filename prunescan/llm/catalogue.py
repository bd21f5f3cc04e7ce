"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from prunescan.llm import decontamination, embedding_dedup, html_wrappers, mixing, pii, simhash, substring_dedup, token_counts, toxicity, url_filter
from prunescan.llm.common import table

#: Vocabulary of op10: its pieces and scores, read as a unigram model.
TOKENIZER = os.environ.get("PRUNESCAN_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")

#: Key of the surrogates where the session's ``prunescan.pii.key`` is unset: for the synthetic tables only.
SYNTHETIC_KEY = "synthetic tables"

#: The rules of op9, fixed by its contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def pii_key(spark: SparkSession) -> bytes:
    """The session's key of the surrogates."""
    return spark.conf.get("prunescan.pii.key", SYNTHETIC_KEY).encode()


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, groups and kept vectors of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_of(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    masked = pii.mask(docs, key=pii_key(spark), entities_col="entities")
    return masked.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_wrappers.extract_articles(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the weighted mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that an earlier document holds."""
    return substring_dedup.drop_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram reading of a public vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_mix_sources": op6_mix_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _keyed_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _swapped_sql(x: str, k: str) -> str:
    """One round of the index permutation: the index or its reflection, by the keyed bit of the pair."""
    draw = lambda name: _keyed_sql(f"'42/' || src || '/{name}/' || {k}")
    other, p = f"(({draw('turn')} % n + n - {x}) % n)", mixing.PRIME
    y = f"((greatest({x}, {other}) % {p} * ({draw('a')} % {p}) + {draw('b')} % {p}) % {p})"
    return f"CASE WHEN ({y} * {y} + {draw('b')} % {p}) % {p} % 2 = 1 THEN {other} ELSE {x} END"


ORACLE_SQL = {
    "op6_mix_sources": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce(len({_WORDS_SQL}), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, src, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
        v AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
        w AS (SELECT *, (CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM v),
        l AS (SELECT *, (3 * source_size)::DOUBLE AS cap,
                     (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / sum(w) OVER (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        g AS (SELECT src, source_size, coalesce(least(cap, w * (SELECT level FROM l WHERE w * level <= cap ORDER BY source_size / w, k LIMIT 1)), 0.0) AS target FROM l),
        b AS (SELECT *, {_keyed_sql("doc_id::VARCHAR")} % (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT FROM d) AS bucket FROM d),
        o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b),
        c AS (SELECT src, n, unnest(range(q)) AS slot FROM (SELECT src, ceil(source_size / 128)::BIGINT AS n, round(target * ceil(source_size / 128) / source_size)::BIGINT AS q FROM g WHERE source_size > 0) WHERE q > 0),
        j AS (SELECT src, n, slot % n AS x, 0 AS k FROM c UNION ALL SELECT src, n, {_swapped_sql("x", "(k + 1)")}, k + 1 FROM j WHERE k < {mixing.ROUNDS}),
        t AS (SELECT src, x AS block, count(*) AS times FROM j WHERE k = {mixing.ROUNDS} GROUP BY 1, 2),
        e AS (SELECT doc_id, src, size, start, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM o WHERE size > 0),
        a AS (SELECT doc_id, sum((least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * coalesce(times, 0))::BIGINT AS taken FROM e LEFT JOIN t USING (src, block) GROUP BY 1)
        SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(a.taken, 0) AS taken FROM d JOIN g USING (src) LEFT JOIN a ON a.doc_id = d.doc_id
    """,
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY 1),
        h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (s) WHERE first < doc_id),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN h USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
        SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op9_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
        u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
        v AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
        w AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM v),
        x AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM w),
        m AS (SELECT x.*, rule_host || rule_path AS rule, verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, rule_host || rule_path) AS k
              FROM x LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
}
