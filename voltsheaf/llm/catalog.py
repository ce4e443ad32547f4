"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.secrets import scan

    return scan(_documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.bpe import encode_and_decode

    return encode_and_decode(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.langid import identify

    return identify(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.warc import archive_round_trip

    return archive_round_trip(_pages(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.html import extract

    return extract(_pages(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.suffix_dedup import without_repeats

    return without_repeats(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.near_dedup import near_groups

    return near_groups(_documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.conversation_trie import trie

    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.clustering import clusters

    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltsheaf.llm.decontamination import contamination

    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = """
WITH turns AS MATERIALIZED (
  SELECT conv_id, sha256(strlen(r)::VARCHAR || ':' || r || t) AS key, strlen(t) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || t)) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
crc AS MATERIALIZED (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
again AS MATERIALIZED (
  SELECT c.conv_id, key, bytes, 0 AS part, i FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND i < h
  UNION ALL SELECT c.conv_id, key, bytes, 1, i FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND i >= h),
paths AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, bytes, count(*) OVER (PARTITION BY conv_id) AS length
  FROM again WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
every AS MATERIALIZED (
  SELECT conv_id, depth, path, bytes, length FROM paths
  UNION ALL SELECT c.conv_id, 0, '', 0, coalesce(length, 0) FROM crc c LEFT JOIN (SELECT conv_id, max(length) AS length FROM paths GROUP BY 1) p ON p.conv_id = c.conv_id),
nodes AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends FROM every GROUP BY 1, 2),
kids AS MATERIALIZED (SELECT depth - 1 AS depth, left(path, -64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
known AS MATERIALIZED (SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN kids k USING (depth, path))
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children,
       count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n - 1) * y.bytes)::BIGINT AS saved_tokens, any_value(x.ends) AS ends_sha256
FROM known x LEFT JOIN known p ON p.depth = x.depth - 1 AND p.path = left(x.path, -64) AND x.depth > 0
JOIN (SELECT n.n, n.n_children, n.bytes, unnest(range(0, n.depth + 1)) AS d, path FROM known n) y ON y.d = x.depth AND left(y.path, 64 * x.depth) = x.path
GROUP BY 1, 2, 3, 4, 5
"""


def clusters_sql(components: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, each a nearest centroid by all distances and an exact floor of the mean."""
    fits = "NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {components} AND {fits})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, {d} AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            sums = f"SELECT a.j, pos, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM a{i} a JOIN (SELECT r, unnest(x) AS y, unnest(range({components})) AS pos FROM v) e USING (r) GROUP BY 1, 2"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(m ORDER BY pos) AS c FROM ({sums}) GROUP BY 1) n USING (j))")
    last = f"SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (j)"
    return "WITH " + ",\n".join(parts) + "\n" + last


OP13_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS m, list_slice(w, i, i + least(len(w), 10) - 1) AS q FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, m, i, list_slice(w, i, i + m - 1) AS q FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT r, item, m, i FROM g JOIN p USING (m, q)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM f) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP5_SQL = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to
FROM (SELECT *, strlen(h) >= 1000 AND best <> page_id AS again
      FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages))
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secrets": op1_secrets, "op2_bpe": op2_bpe, "op3_exact_dedup": op3_exact_dedup, "op4_language_id": op4_language_id, "op5_warc": op5_warc, "op6_packing": op6_packing, "op7_html_text": op7_html_text, "op8_fingerprints": op8_fingerprints, "op9_suffix_dedup": op9_suffix_dedup, "op10_near_dedup": op10_near_dedup, "op11_conversation_trie": op11_conversation_trie, "op12_clusters": op12_clusters, "op13_decontamination": op13_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op12_clusters": clusters_sql(), "op13_decontamination": OP13_SQL}
