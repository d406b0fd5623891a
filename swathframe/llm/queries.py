"""Registered queries of the text operators, with checking SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from swathframe.llm.byte_bpe import encode_documents
from swathframe.llm.centroids import cluster_vectors
from swathframe.llm.embedding_dedup import link_vectors
from swathframe.llm.importance import resample
from swathframe.llm.lm_scoring import score_documents
from swathframe.llm.near_dup import link_documents
from swathframe.llm.packing import pack_documents
from swathframe.llm.private_spans import find_private
from swathframe.llm.quality_classifier import fit_quality, score_quality
from swathframe.llm.quality_rules import judge_documents
from swathframe.llm.substring_dedup import remove_repeats
from swathframe.llm.suffix_dedup import repeated_passages
from swathframe.llm.url_filters import Rule, apply_rules

URL_RULES = [Rule("com/", True), Rule("example.com/en/", False), Rule("www.example.com/en/", True),
             Rule("net/es/", False), Rule("net/fr/", False)]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "pages"), URL_RULES)


def op2_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return judge_documents(table(spark, sf_dir, "documents"))


def op4_minhash_near_dup(spark, sf_dir):
    return link_documents(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def op6_byte_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op7_suffix_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN)


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_embedding_near_dup(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_private_spans(spark, sf_dir):
    return find_private(table(spark, sf_dir, "documents")).drop("n_added")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_substring_dedup, op3_quality_rules, op4_minhash_near_dup,
                                   op5_lm_scoring, op6_byte_bpe, op7_suffix_dedup, op8_packing,
                                   op9_quality_classifier, op10_embedding_near_dup, op11_importance_resampling,
                                   op12_centroid_clustering, op13_private_spans)}


def _clustering_sql(rounds: int = 10, clusters: int = 8) -> str:
    """Whole-number k-means, one step of the statement for each round."""
    assign = """a{r} AS MATERIALIZED (
            SELECT k, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
                SELECT k, vec_id, v, cluster, CAST(list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))) AS BIGINT) AS d
                FROM kept, c{r}) GROUP BY k, vec_id, v)"""
    move = """c{n} AS MATERIALIZED (
            SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                    SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
                GROUP BY cluster) m USING (cluster))"""
    steps = [x for r in range(rounds) for x in (assign.format(r=r), move.format(r=r, n=r + 1))]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS k, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INT) AS cluster, v AS c
            FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters}),
        {", ".join(steps)},
        {assign.format(r=rounds)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES = {
    "op1_url_filters": r"""
        WITH r(name, allow) AS (VALUES ('com/', true), ('example.com/en/', false), ('www.example.com/en/', true),
                                       ('net/es/', false), ('net/fr/', false)),
        u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0
                     THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT k, page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        m AS (SELECT k, max_by(name, length(name)) AS name, max_by(allow, length(name)) AS allow
              FROM p JOIN r ON (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1)))
                           AND starts_with(path, substr(name, strpos(name, '/'))) GROUP BY k)
        SELECT page_id, host, path, m.name AS rule,
               CASE WHEN coalesce(m.allow, NOT regexp_matches(host || path,
                    '/wp-login\.php|/wp-admin/|/cgi-bin/|/checkout/|/cart/|/login/|/signup/'))
                    THEN 'allow' ELSE 'block' END AS verdict
        FROM p LEFT JOIN m USING (k)""",
    "op11_importance_resampling": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id,
                             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        words AS MATERIALIZED (SELECT k, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
        wanted AS MATERIALIZED (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        steps AS (SELECT list(list_reduce([CAST(b AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                              ORDER BY b) AS step FROM range(256) r(b)),
        vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM wanted)),
        buckets AS MATERIALIZED (
            SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
                       list_transform(range(1, len(h), 2), lambda p: CAST('0x' || substr(h, p, 2) AS UBIGINT))),
                       lambda c, b: xor(c >> 8, step[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
            FROM vocabulary, steps),
        s AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (w) GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln(
                      CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM words) + 10000) AS DOUBLE)
                      / ((s.n + 1) * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain
                  FROM s LEFT JOIN t USING (bucket)),
        weights AS (SELECT k, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g
                    FROM words JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY k),
        scored AS (SELECT k, doc_id, coalesce(n, 0) AS n_features,
                          CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
                          CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) AS h
                   FROM docs LEFT JOIN weights USING (k)),
        final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM scored),
        ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM final
                   WHERE n_features >= 20 AND score IS NOT NULL
                   QUALIFY place <= (10 * count(*) OVER ()) // 100)
        SELECT doc_id, n_features, weight, score, place AS rank FROM final LEFT JOIN ranked USING (k)""",
    "op12_centroid_clustering": _clustering_sql(),
}
