"""The queries opN_<name> of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.session import scratch

from . import bpe, centroids, conversations, exact_dedup, near_dedup, packing, pieces, quality, secrets, toxicity, training_order, url_filter, vector_dedup
from .common import table

#: Fixed values of the URL query: rule and verdict.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), f"{scratch(spark, 'shards')}")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("scanned")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_exact_dedup, op3_vector_dedup, op4_url_filter, op5_bpe, op6_secrets, op7_packing, op8_quality, op9_training_order, op10_near_dedup)
    ops += (op11_sentence_pieces, op12_conversation_repair, op13_centroids)
    return {f.__name__: f for f in (*ops, pipeline)}


#: Exact duplicates; the digest is SQL's own.
_OP2 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: URL rules by joining every page with the five rules.
_OP4 = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*', '') ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fit AS (
  SELECT page_id, rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM split s LEFT JOIN fit f ON s.page_id = f.page_id AND f.place = 1
"""

#: Conversations: the DP over turns as a recursion, a row for each conversation and state; crc32 by its table.
_OP12 = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM told WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faults GROUP BY conv_id
), inserts(p, q, edits) AS (
  VALUES ('0', '0', ''), ('0', 'U', 'I'), ('0', 'A', 'II'), ('S', 'S', ''), ('S', 'U', 'I'), ('S', 'A', 'II'), ('U', 'U', ''), ('U', 'A', 'I'), ('A', 'A', ''), ('A', 'U', 'I')
), moves(q, initial, r, edit, price) AS (
  VALUES ('0', 's', 'S', 'K', 0), ('0', 'u', 'U', 'K', 0), ('S', 'u', 'U', 'K', 0), ('A', 'u', 'U', 'K', 0), ('U', 'a', 'A', 'K', 0),
         ('0', NULL, 'U', 'R', 2), ('S', NULL, 'U', 'R', 2), ('A', NULL, 'U', 'R', 2), ('U', NULL, 'A', 'R', 2),
         ('0', NULL, '0', 'D', 3), ('S', NULL, 'S', 'D', 3), ('U', NULL, 'U', 'D', 3), ('A', NULL, 'A', 'D', 3)
), ways AS (
  SELECT p, initial, r, edit, edits || edit AS edits, price + 2 * length(edits) AS price FROM inserts JOIN moves USING (q)
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, '0' AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT d.conv_id, f.pos, w.r, min({'cost': d.best.cost + w.price + CASE WHEN f.fault = 'truncated' AND w.edit <> 'D' THEN 1 ELSE 0 END, 'audit': d.best.audit || w.edits})
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
  JOIN ways w ON w.p = d.state AND (w.initial IS NULL OR w.initial = f.initial) AND (w.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY d.conv_id, f.pos, w.r
), closing(state, edits) AS (VALUES ('0', ''), ('A', ''), ('U', 'I'), ('S', 'II')
), ended AS (
  SELECT d.conv_id, min({'cost': d.best.cost + 2 * length(edits), 'audit': d.best.audit || edits}) AS best
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.pos JOIN closing USING (state) GROUP BY d.conv_id
), edits AS (
  SELECT conv_id, i, best.audit[i] AS edit, length(replace(best.audit[:i], 'I', '')) AS pos FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS i FROM ended)
), left_over AS (
  SELECT e.conv_id, i, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS k,
         max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS with_system
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos AND e.edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role WHEN 'R' THEN made ELSE made END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, E'\\n' ORDER BY i)) AS digest
  FROM (SELECT *, CASE WHEN (k - with_system) % 2 = 1 THEN 'user' ELSE 'assistant' END AS made FROM left_over) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _op13(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    out = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE * 64) < 134217728)) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT rid, vec_id, k.v, min({{'d': {apart}, 'c': c.c}}) AS best FROM kept k, c{i} c GROUP BY rid, vec_id, k.v)")
        if i < rounds:
            out.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(floor_mean ORDER BY i) AS v FROM ("
                f"SELECT best.c AS c, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean "
                f"FROM a{i}, range(1, 65) r(i) GROUP BY best.c, i) GROUP BY c) m USING (c))"
            )
    return (
        "WITH " + ", ".join(out) + f" SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, "
        f"(sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.c"
    )


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_url_filter": _OP4, "op12_conversation_repair": _OP12, "op13_centroids": _op13()}
