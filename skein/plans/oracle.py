"""DuckDB SQL for the driver's queries, written apart from the operators."""

from __future__ import annotations

_BASE = """
WITH e AS (
  SELECT l_orderkey AS read, l_partkey AS node, l_suppkey % 2 = 1 AS read_rev,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 ELSE l_quantity END AS BIGINT) AS f,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0 ELSE l_quantity END AS BIGINT) AS t,
         l_returnflag = 'N' AS mis,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem
), w AS (
  SELECT *, coalesce(sum(t) OVER (PARTITION BY read ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         sum(t) OVER (PARTITION BY read) AS total,
         coalesce(last_value(CASE WHEN f > 0 OR t > 0 THEN f > 0 AND t = 0 END IGNORE NULLS) OVER (PARTITION BY read ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS del
  FROM e
), m AS (
  SELECT read, node, read_rev, f, t, mis, pos, total, CASE WHEN f > 0 AND t > 0 THEN f ELSE 0 END AS aligned,
         CASE WHEN f = 0 AND t = 0 THEN 0 WHEN t = 0 THEN CASE WHEN del THEN -f ELSE -(5 + f) END
              WHEN f = 0 THEN CASE WHEN pos = 0 OR pos + t = total THEN 0 ELSE -(5 + t) END
              ELSE CASE WHEN mis THEN -4 * f ELSE f END + CASE WHEN pos = 0 THEN 5 ELSE 0 END + CASE WHEN pos + t = total THEN 5 ELSE 0 END END AS score
  FROM w
), np AS (
  SELECT p_partkey AS node, p_brand || '_H' || CAST(p_size % 3 + 1 AS VARCHAR) AS path, p_size % 2 = 1 AS path_rev FROM part
  UNION ALL SELECT p_partkey, p_type || '_R1', p_size % 2 = 0 FROM part
), tally AS (
  SELECT read, path, CAST(sum(score) AS BIGINT) AS score, CAST(sum(CASE WHEN read_rev = path_rev THEN aligned ELSE 0 END) AS BIGINT) AS fwd,
         CAST(sum(CASE WHEN read_rev <> path_rev THEN aligned ELSE 0 END) AS BIGINT) AS rev
  FROM m JOIN np USING (node) GROUP BY read, path
), won AS (SELECT * FROM tally QUALIFY rank() OVER (PARTITION BY read ORDER BY score DESC) = 1
), tg AS (
  SELECT read, regexp_replace(path, '_[HR][0-9]+$', '') AS target, CAST(sum(fwd) AS BIGINT) AS fwd, CAST(sum(rev) AS BIGINT) AS rev, sum(fwd) >= sum(rev) AS forward
  FROM won GROUP BY ALL
), dict AS (
  SELECT target, CAST(row_number() OVER (ORDER BY target) - 1 AS INTEGER) AS target_id FROM (SELECT DISTINCT regexp_replace(path, '_[HR][0-9]+$', '') AS target FROM np)
), ng0 AS (
  SELECT p_partkey AS node, 'G' || CAST(p_partkey % 7 AS VARCHAR) AS gene, p_size <= 25 AS ex, p_size % 2 = 1 AS rv, CASE WHEN p_size <= 25 THEN 3 ELSE 1 END AS late FROM part
  UNION ALL SELECT p_partkey, 'G' || CAST(p_size % 7 AS VARCHAR), false, p_size % 2 = 0, 2 FROM part WHERE p_size % 3 = 0
), ng AS (SELECT node, gene, bool_or(ex) AS is_exon, arg_max(rv, late) AS gene_rev FROM ng0 GROUP BY ALL
), lg AS (
  SELECT read, gene, sum(CASE WHEN is_exon THEN aligned ELSE 0 END) AS ex, sum(CASE WHEN is_exon THEN 0 ELSE aligned END) AS intr,
         sum(CASE WHEN read_rev = gene_rev THEN aligned ELSE 0 END) >= sum(CASE WHEN read_rev <> gene_rev THEN aligned ELSE 0 END) AS forward
  FROM m JOIN ng USING (node) WHERE aligned > 0 GROUP BY read, gene HAVING sum(aligned) > 0
), len AS (SELECT read, sum(aligned) AS n FROM m GROUP BY read
), c_gene AS (SELECT lg.read, gene, forward FROM lg JOIN len USING (read) WHERE ex > 0 AND 2 * ex >= n
), c_genefull AS (SELECT read, gene, forward FROM lg
), c_exonoverintron AS (SELECT read, gene, forward FROM lg QUALIFY intr = 0 OR NOT bool_or(intr = 0) OVER (PARTITION BY read)
), c_ex50pas AS (SELECT read, gene, forward FROM (SELECT * FROM lg WHERE NOT (intr = 0 AND NOT forward)) QUALIFY ex > intr OR NOT bool_or(ex > intr) OVER (PARTITION BY read)
)
"""

_NAME = """
WITH c AS (
  SELECT c_custkey AS k, translate(to_base(c_custkey, 4, 16), '0123', 'ACGT') AS bc, translate(to_base(c_custkey, 4, 12), '0123', 'ACGT') AS umi FROM customer
), n AS (
  SELECT k, CASE k % 7 WHEN 0 THEN '_' || bc || '_' || umi WHEN 1 THEN bc || '_' || umi WHEN 2 THEN 'r_x_' || lower(bc) || '_' || umi
                  WHEN 3 THEN 'r_' || bc || '_' || umi[1:11] WHEN 4 THEN 'r_' || translate(bc, 'G', 'X') || '_' || umi
                  WHEN 5 THEN 'r_' || bc || '_' ELSE 'r_' || bc || '_' || umi END AS name FROM c
), p AS (SELECT k, string_split(name, '_') AS s FROM n
), q AS (SELECT k, s, len(s) AS n, s[-1] AS umi, s[-2] AS bc, array_to_string(s[1:len(s) - 2], '_') AS orig FROM p
), st AS (
  SELECT k, orig, CASE WHEN n < 3 OR umi = '' OR bc = '' THEN 'missing' WHEN orig = '' OR strlen(bc) <> 16 OR strlen(umi) <> 12 THEN 'malformed'
                       WHEN NOT regexp_full_match(bc, '[ACGTNacgtn]+') OR NOT regexp_full_match(umi, '[ACGTNacgtn]+') THEN 'unsupported' ELSE 'ok' END AS status FROM q
)
SELECT k AS c_custkey, status, CASE WHEN status = 'ok' THEN orig END AS original_name FROM st
"""

_OFFSETS = """
WITH RECURSIVE l AS (
  SELECT o_orderkey AS read, i AS subpath, (o_orderkey * (i + 3)) % 11 + 1 AS n FROM orders, range(6) r(i)
), edge AS (
  SELECT x.read, x.subpath AS a, y.subpath AS b, x.n FROM l x JOIN l y ON x.read = y.read AND y.subpath > x.subpath AND (x.read * (x.subpath + 1) + x.subpath + 7 * y.subpath) % 3 = 0
), up AS (SELECT read, b, min(a) AS a, arg_min(n, a) AS n FROM edge GROUP BY read, b
), o AS (
  SELECT read, subpath, 0::BIGINT AS off FROM l WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.read = l.read AND up.b = l.subpath)
  UNION ALL SELECT o.read, up.b, (o.off + up.n)::BIGINT FROM o JOIN up ON up.read = o.read AND up.a = o.subpath
)
SELECT read, CAST(subpath AS INTEGER) AS subpath, off AS read_offset FROM o
"""

_RANGE = """
WITH s AS (
  SELECT p_brand AS path, p_partkey AS node, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node_end, p_size FROM part
), f AS (
  SELECT 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_suppkey % 3 + 1 AS VARCHAR) AS path, 'S' || CAST(s_suppkey AS VARCHAR) AS gene, (s_suppkey * 37) % 900 AS a FROM supplier
)
SELECT path, node, gene FROM s JOIN f USING (path) WHERE a < node_end AND a + 120 > node_end - p_size
"""


#: Read groups of the conversion's view: k, name, parts of it, status, records, and whether one has subpaths.
_GROUPS = _BASE + """
, grp0 AS (
  SELECT DISTINCT l_orderkey AS k, translate(to_base(l_orderkey % 1000, 4, 16), '0123', 'ACGT') AS bc, translate(to_base(l_orderkey, 4, 12), '0123', 'ACGT') AS umi FROM lineitem
), grp AS (
  SELECT k, bc, umi, 'r' || k AS orig,
         CASE k % 17 WHEN 0 THEN 'r' || k WHEN 1 THEN 'r' || k || '_' || bc || '_' || umi || 'A' WHEN 2 THEN 'r' || k || '_' || bc || '_' || left(umi, 11) || 'X' ELSE 'r' || k || '_' || bc || '_' || umi END AS name,
         CASE k % 17 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'unsupported' ELSE 'ok' END AS status,
         CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END AS records, k % 13 <> 0 AS aligned FROM grp0
), hit AS (SELECT k, name, bc, umi, orig, target, forward FROM tg JOIN grp ON read = k WHERE status = 'ok' AND aligned
), steps AS (
  SELECT path, node, path_rev, regexp_replace(path, '_[HR][0-9]+$', '') AS bare FROM np
), layer AS (
  SELECT path, node, path_rev, path LIKE '%\\_H_' ESCAPE '\\' AS ex, 'G' || CASE WHEN path LIKE '%\\_H_' ESCAPE '\\' THEN right(bare, 1) ELSE CAST(length(bare) % 5 AS VARCHAR) END AS gene FROM steps
), cls AS (SELECT node, gene, bool_or(ex) AS is_exon, arg_max(path_rev, path) AS gene_rev FROM layer GROUP BY ALL
), led AS (
  SELECT read AS k, gene, sum(CASE WHEN is_exon THEN aligned ELSE 0 END) AS ex, sum(CASE WHEN is_exon THEN 0 ELSE aligned END) AS intr,
         sum(CASE WHEN read_rev = gene_rev THEN aligned ELSE -aligned END) >= 0 AS forward
  FROM m JOIN cls USING (node) WHERE aligned > 0 AND read IN (SELECT k FROM grp WHERE status = 'ok' AND grp.aligned) GROUP BY ALL
), gdict AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS id FROM (SELECT DISTINCT gene FROM layer)
), over_ AS (SELECT k, gene AS target, forward FROM led QUALIFY intr = 0 OR NOT bool_or(intr = 0) OVER (PARTITION BY k)
), pas AS (SELECT k, gene AS target, forward FROM (SELECT * FROM led WHERE NOT (intr = 0 AND NOT forward)) QUALIFY ex > intr OR NOT bool_or(ex > intr) OVER (PARTITION BY k)
), tgene AS (SELECT DISTINCT k, orig, bc, umi, 'G' || CAST(length(target) % 5 AS VARCHAR) AS gene FROM hit
), gset AS (SELECT k, orig, bc, umi, string_agg(gene, ';' ORDER BY gene) AS genes, min(gene) AS first, count(*) AS n FROM tgene GROUP BY ALL
)
"""


#: The summary's keys in their order.
_KEYS = """['input_records', 'input_read_groups', 'emitted_groups', 'no_compatible_transcript_groups', 'strand_filtered_groups', 'multigene_dropped_groups', 'unaligned_reads',
  'raw_molecule_missing_groups', 'raw_molecule_malformed_groups', 'raw_molecule_unsupported_groups', 'raw_molecule_skipped_groups', 'grouping_recurrence_failures',
  'emitted_target_count_histogram']"""


def _summary(hits: str, keep: str, unique: bool) -> str:
    """The twelve counters and the histogram of hits (k, target, forward)."""
    limit = "= 1" if unique else "> 0"
    drop = "count(*) FILTER (kept > 1)" if unique else "0"
    return _GROUPS + f""", per AS (SELECT k, count(*) AS n, count(*) FILTER ({keep}) AS kept FROM {hits} GROUP BY k
), st AS (SELECT grp.*, n, kept FROM grp LEFT JOIN per USING (k)
), hist AS (SELECT coalesce(string_agg(kept || ':' || c, ';' ORDER BY kept), '') AS h FROM (SELECT kept, count(*) AS c FROM per WHERE kept {limit} GROUP BY kept)
), one AS (
  SELECT sum(records) AS input_records, count(*) AS input_read_groups, count(*) FILTER (kept {limit}) AS emitted_groups, count(*) FILTER (status = 'ok' AND n IS NULL) AS no_compatible_transcript_groups,
         count(*) FILTER (kept = 0) AS strand_filtered_groups, {drop} AS multigene_dropped_groups, count(*) FILTER (status = 'ok' AND n IS NULL AND NOT aligned) AS unaligned_reads,
         count(*) FILTER (status = 'missing') AS raw_molecule_missing_groups, count(*) FILTER (status = 'malformed') AS raw_molecule_malformed_groups, count(*) FILTER (status = 'unsupported') AS raw_molecule_unsupported_groups,
         count(*) FILTER (status <> 'ok') AS raw_molecule_skipped_groups, 0 AS grouping_recurrence_failures, any_value((SELECT h FROM hist)) AS emitted_target_count_histogram
  FROM st
), txt AS (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM one)
SELECT key, value FROM (UNPIVOT txt ON COLUMNS(*) INTO NAME key VALUE value)
"""


_SAM = _GROUPS + """, len2 AS (SELECT read AS k, CAST(max(total) AS BIGINT) AS total FROM m GROUP BY read
)
SELECT concat_ws(chr(9), orig, '0', first, '1', '255', CASE WHEN total = 0 THEN '*' ELSE total || 'M' END, '*', '0', '0', CASE WHEN total = 0 THEN '*' ELSE repeat('A', total) END, '*',
  'CB:Z:' || bc, 'CR:Z:' || bc, 'UB:Z:' || umi, 'UR:Z:' || umi, 'GX:Z:' || genes, 'GN:Z:' || genes, CASE WHEN n = 1 THEN 'XT:Z:' || first END) AS line
FROM gset JOIN len2 USING (k)
UNION ALL SELECT '@SQ' || chr(9) || 'SN:' || gene || chr(9) || 'LN:268435456' FROM (SELECT DISTINCT 'G' || CAST(length(bare) % 5 AS VARCHAR) AS gene FROM steps)
UNION ALL SELECT '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted'
UNION ALL SELECT concat_ws(chr(9), '@PG', 'ID:skein', 'PN:skein', 'VN:1', 'CL:run')
"""

#: The same alignments as fields of binary records.
_BAM = _SAM[: _SAM.index("SELECT concat_ws(chr(9), orig")] + """
SELECT orig AS name, CAST(0 AS INTEGER) AS flag, first AS contig, CAST(1 AS BIGINT) AS pos, CAST(255 AS INTEGER) AS mapq, CASE WHEN total = 0 THEN '' ELSE total || 'M' END AS cigar,
       repeat('A', total) AS sequence, bc AS cell, umi, genes, CASE WHEN n = 1 THEN first END AS gene
FROM gset JOIN len2 USING (k)
"""

#: UMIs that edges connect, by walking the edges of each group.
_NETWORK = """
WITH RECURSIVE u AS (
  SELECT user_id % 7 AS cell, event_type AS gene, translate(to_base(event_id * event_id % 1024, 4, 5), '0123', 'ACGT') AS umi, count(*) AS n
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL
), e AS (
  SELECT a.cell, a.gene, a.umi AS a, b.umi AS b FROM u a JOIN u b ON a.cell = b.cell AND a.gene = b.gene AND hamming(a.umi, b.umi) = 1 AND a.n >= 2 * b.n - 1
), both_ AS (SELECT * FROM e UNION SELECT cell, gene, b, a FROM e
), walk AS (
  SELECT cell, gene, umi, umi AS root FROM u
  UNION SELECT w.cell, w.gene, x.b, w.root FROM walk w JOIN both_ x ON x.cell = w.cell AND x.gene = w.gene AND x.a = w.umi AND w.root < x.b
), named AS (SELECT cell, gene, umi, min(root) AS molecule FROM walk GROUP BY ALL)
SELECT gene, cell, count(*) AS umis, count(DISTINCT molecule) AS count FROM named GROUP BY ALL
"""

#: Base-quality scores in SQL's own arithmetic. Fixed value: the base of the flat scores' logarithms.
_QUAL = _GROUPS + """, lam AS (SELECT 1.3833252687::DOUBLE AS l
), tab AS (
  SELECT q, CASE WHEN q < 2 THEN 0 ELSE round(ln((1 - e) * exp(l) + e * exp(-4 * l)) / l) END AS hit,
         CASE WHEN q < 2 THEN 0 ELSE round(ln((1 - e) * exp(-4 * l) + e / 3 * (exp(l) + 2 * exp(-4 * l))) / l) END AS miss,
         CASE WHEN q < 3 THEN 0 ELSE round(ln((1 - 4.0 / 3 * e) * exp(5 * l) + 4.0 / 3 * e) / l) END AS bonus
  FROM (SELECT q, pow(10, -q / 10.0) AS e FROM range(42) r(q)), lam
), ed AS (SELECT row_number() OVER () AS id, read AS k, node, read_rev, f, t, CAST(pos AS BIGINT) AS pos, CAST(total AS BIGINT) AS total, score, aligned FROM m WHERE read % 13 <> 0
), base AS (
  SELECT id, k, node, read_rev, i, pos + i AS p, 'ACGTN'[CAST((k + (pos + i) * (pos + i)) % 5 + 1 AS INTEGER)] AS rb, CAST((k * 7 + (pos + i) * 3) % 42 AS BIGINT) AS q,
         CASE WHEN read_rev THEN 'TGCA'[CAST((node + (49 - i) * (49 - i)) % 4 + 1 AS INTEGER)] ELSE 'ACGT'[CAST((node + i * i) % 4 + 1 AS INTEGER)] END AS nb, pos = 0 AND i = 0 AS head, pos + t = total AND i = t - 1 AS tail
  FROM (SELECT *, unnest(range(t)) AS i FROM ed WHERE f > 0 AND t > 0)
), adj AS (
  SELECT id, CAST(sum(CASE WHEN rb = 'N' THEN 0 WHEN rb = nb THEN hit ELSE miss END + CASE WHEN head THEN bonus ELSE 0 END + CASE WHEN tail THEN bonus ELSE 0 END) AS BIGINT) AS s FROM base JOIN tab USING (q) GROUP BY id
)
SELECT name AS read, node, CAST(sum(coalesce(s, score)) AS BIGINT) AS score, CAST(sum(ed.aligned) AS BIGINT) AS aligned
FROM ed LEFT JOIN adj USING (id) JOIN grp USING (k) GROUP BY name, node
"""

_BODIES = """
WITH s AS (
  SELECT p_brand AS path, p_partkey AS node, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node_end, p_size, p_partkey % 4 = 0 AS path_rev FROM part
), f AS (
  SELECT 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_suppkey % 3 + 1 AS VARCHAR) AS path, 'S' || CAST(s_suppkey AS VARCHAR) AS gene, (s_suppkey * 37) % 900 AS a, s_suppkey % 2 = 1 AS r FROM supplier
), b AS (
  SELECT gene || '_R1' AS path, gene, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN r THEN -node_end ELSE node_end END) - 1 AS step_ord, node, path_rev <> r AS path_rev
  FROM s JOIN f USING (path) WHERE a < node_end AND a + 120 > node_end - p_size
)
"""

_DIFF = """
WITH a AS (SELECT event_type AS gene, user_id AS cell, count(DISTINCT props) AS count FROM events WHERE event_type IS NOT NULL GROUP BY ALL
), b AS (SELECT event_type AS gene, user_id AS cell, count(DISTINCT CASE WHEN event_id % 40 = 0 THEN 'other' ELSE props END) AS count FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
"""

_EMPTIED = _BASE.replace("  FROM lineitem\n), w AS (", "  FROM lineitem\n), w0 AS (SELECT * REPLACE (CASE WHEN greatest(f, t) <= 20 THEN 0 ELSE f END AS f, CASE WHEN greatest(f, t) <= 20 THEN 0 ELSE t END AS t) FROM e), w AS (").replace("AS del\n  FROM e\n", "AS del\n  FROM w0\n")


def oracle_sql() -> dict[str, str]:
    b = lambda s: _BASE + s
    g = lambda s: _GROUPS + s
    counts = "SELECT event_type AS gene, user_id AS cell, count(DISTINCT props) AS count FROM events WHERE event_type IS NOT NULL GROUP BY ALL"
    out = {
        "flagship_targets": b("SELECT read, target, fwd, rev, forward FROM tg"),
        "node_scores": b("SELECT read, node, CAST(sum(score) AS BIGINT) AS score, CAST(sum(aligned) AS BIGINT) AS aligned FROM m GROUP BY read, node"),
        "hst_tally": b("SELECT * FROM tally"),
        "winners": b("SELECT read, path, score FROM won"),
        "orientation": b("SELECT forward, count(*) AS targets FROM tg GROUP BY forward"),
        "strand_forward": b("SELECT read, target FROM tg WHERE forward"),
        "strand_reverse": b("SELECT read, target FROM tg WHERE NOT forward"),
        "strand_counters": b("SELECT count(*) AS reads, count(*) FILTER (f = 0) AS filtered_forward, count(*) FILTER (r = 0) AS filtered_reverse FROM (SELECT read, count(*) FILTER (forward) AS f, count(*) FILTER (NOT forward) AS r FROM tg GROUP BY read)"),
        "multigene_dropped": b(" UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) FILTER (n > 1) AS dropped, count(*) FILTER (n = 1) AS kept FROM (SELECT read, count(*) AS n FROM c_{m} GROUP BY read)" for m in ("gene", "genefull", "exonoverintron", "ex50pas"))),
        "molecule_status": _NAME,
        "molecule_pack": "SELECT o_orderkey, translate(to_base(o_custkey, 4, 16), '0123', 'ACGT') AS barcode, o_custkey AS packed, o_orderkey AS packed_umi FROM orders",
        "contiguity_violations": "SELECT user_id, min(event_id) AS first_event, max(event_id) - min(event_id) + 1 AS span, count(*) AS events FROM events GROUP BY user_id HAVING span <> count(*)",
        "missing_nodes": "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)",
        "semi_join_paths": b("SELECT path, count(*) AS steps FROM np WHERE path IN (SELECT p_type || '_R1' FROM part WHERE p_size <= 10) GROUP BY path"),
        "fallback_join": b("SELECT DISTINCT path, CASE WHEN path LIKE '%_H1' THEN 'E' ELSE 'B:' || regexp_replace(path, '_[HR][0-9]+$', '') END AS gene, path LIKE '%_H1' AS is_exon FROM np"),
        "target_dictionary": b("SELECT target, target_id FROM dict"),
        "gene_union": b("SELECT gene AS target, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS target_id FROM (SELECT DISTINCT gene FROM ng)"),
        "new_paths": b("SELECT DISTINCT path FROM np WHERE NOT (path LIKE '%_H1' OR path LIKE '%_H2')"),
        "target_histogram": b("SELECT targets, count(*) AS reads FROM (SELECT count(*) AS targets FROM tg GROUP BY read) GROUP BY targets"),
        "run_summary": _summary("hit", "forward", False),
        "run_summary_ledger": _summary("pas", "NOT forward", True),
        "convert_records": g("SELECT name AS read, bc AS barcode, umi, string_agg(target_id || CASE WHEN forward THEN '+' ELSE '-' END, ';' ORDER BY target_id) AS hits FROM hit JOIN dict USING (target) GROUP BY ALL"),
        "convert_records_ledger": g("SELECT name AS read, bc AS barcode, umi, any_value(id || CASE WHEN forward THEN '+' ELSE '-' END) AS hits FROM over_ JOIN gdict ON target = gene JOIN grp USING (k) GROUP BY ALL HAVING count(*) = 1"),
        "rejected_groups": g("SELECT name AS read, status FROM grp WHERE status <> 'ok'"),
        "rad_roundtrip": g("SELECT CAST(k % 1000 AS VARCHAR) AS barcode, CAST(k AS VARCHAR) AS umi, target, forward FROM hit"),
        "conflicting_genes": "SELECT p_brand AS target, count(DISTINCT p_size % 3) AS values FROM part WHERE p_brand LIKE '%1' OR p_size % 3 = 0 GROUP BY p_brand HAVING count(DISTINCT p_size % 3) > 1",
        "unknown_targets": b("SELECT target, count(DISTINCT read) AS reads FROM tg JOIN dict USING (target) WHERE target_id % 5 = 0 GROUP BY target"),
        "rad_order": g("SELECT row_number() OVER (ORDER BY k) - 1 AS record, CAST(k AS VARCHAR) AS umi FROM (SELECT DISTINCT k FROM hit)"),
        "tx2gene_lines": g("SELECT row_number() OVER (ORDER BY bare) - 1 AS ord, bare || chr(9) || 'G' || CAST(length(bare) % 5 AS VARCHAR) AS line FROM (SELECT DISTINCT bare FROM steps)"),
        "summary_lines": _summary("hit", "forward", False).replace("SELECT key, value FROM", f"SELECT list_position({_KEYS}, key) - 1 AS ord, key || chr(9) || value AS line FROM"),
        "warning_lines": g("SELECT row_number() OVER (ORDER BY k) - 1 AS ord, 'warning: skipping ' || name || ': molecule ' || status AS line FROM grp WHERE status <> 'ok'"),
        "bad_map_rows": "SELECT CASE WHEN p_partkey % 6 = 3 THEN '' ELSE p_brand END AS path, CASE p_partkey % 6 WHEN 2 THEN '' WHEN 3 THEN p_type END AS gene FROM part WHERE p_partkey % 6 IN (1, 2, 3)",
        "edits_outside": b("SELECT node, CAST(pos AS BIGINT) AS read_pos, t AS to_length FROM m WHERE read % 13 <> 0 AND f > 0 AND t > 30"),
        "bam_rows": _SAM,
        "bam_binary_rows": _BAM,
        "umi_network_counts": _NETWORK,
        "scan_sam_tags": g("SELECT orig AS name, CAST(1 AS BIGINT) AS pos, bc AS cell, umi, first AS gene FROM gset"),
        "scan_alignments": g("SELECT name AS read, CAST(records AS BIGINT) AS records, CAST(records - 1 AS BIGINT) AS span, n AS mappings, s AS score, x AS nodes FROM grp LEFT JOIN (SELECT read AS k, count(*) AS n, CAST(sum(score) AS BIGINT) AS s, CAST(sum(node) AS BIGINT) AS x FROM m WHERE read % 13 <> 0 GROUP BY read) USING (k)"),
        "scan_gfa": g("SELECT path, node, path_rev, CAST(50 AS INTEGER) AS bases, CAST(row_number() OVER (PARTITION BY path ORDER BY node) - 1 AS INTEGER) AS place FROM np"),
        "scan_path_map": g("SELECT DISTINCT path, 'G' || CAST(length(bare) % 5 AS VARCHAR) AS gene FROM steps"),
        "scan_fastq": "SELECT k AS ord, 'c' || c_custkey || '_AAAC_' || translate(to_base(k, 4, 12), '0123', 'ACGT') AS name, 'ACGT' AS sequence, 'IIII' AS quality FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer)",
        "scan_gtf": "SELECT 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_suppkey % 3 + 1 AS VARCHAR) AS path, 'S' || s_suppkey AS gene, CAST(s_suppkey * 37 % 900 AS BIGINT) AS start, CAST(s_suppkey * 37 % 900 + 120 AS BIGINT) AS \"end\", s_suppkey % 2 = 1 AS reverse FROM supplier",
        "scan_counts": "SELECT event_type AS gene, CAST(user_id AS VARCHAR) AS cell, count(*) AS count FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL",
        "scan_matrix": "SELECT 'cell' || (c_custkey % 50) AS cell, n_name AS gene, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
        "gene_body_paths": _BODIES + "SELECT p_brand AS path, p_partkey AS step_ord, p_partkey AS node, p_partkey % 4 = 0 AS path_rev FROM part UNION ALL SELECT path, step_ord, node, path_rev FROM b",
        "gene_body_map": _BODIES + "SELECT DISTINCT path, gene FROM b",
        "node_genes": b("SELECT node, gene, is_exon, gene_rev FROM ng"),
        "tally_with_empty_edits": _EMPTIED + "SELECT * FROM tally",
        "umi_counts": counts,
        "cell_gene_matrix": f"SELECT cell, string_agg(gene || ':' || count, ';' ORDER BY gene) AS genes FROM ({counts}) GROUP BY cell",
        "position_independence": _DIFF,
        "gene_sets_xt": b("SELECT read, string_agg(gene, ';' ORDER BY gene) AS genes, min(gene) AS primary_gene, CASE WHEN count(*) = 1 THEN min(gene) END AS xt FROM (SELECT DISTINCT read, 'GENE' || CAST(target_id % 9 AS VARCHAR) AS gene FROM tg JOIN dict USING (target)) GROUP BY read"),
        "gene_sets_first": b("SELECT read, string_agg(gene, ';' ORDER BY gene) AS genes, min(gene) AS primary_gene, min(gene) AS xt FROM (SELECT DISTINCT read, 'GENE' || CAST(target_id % 9 AS VARCHAR) AS gene FROM tg JOIN dict USING (target)) GROUP BY read"),
        "dag_offsets": _OFFSETS,
        "gene_body_range_join": _RANGE,
        "fidelity_rate": b("SELECT count(*) AS subpaths, count(*) FILTER (a = b) AS matching, count(*) FILTER (a = b) * 1000 // count(*) AS per_mille, CAST(floor(avg(read % 42) FILTER (a = b) * 1000) AS BIGINT) AS quality_matching, CAST(floor(avg(read % 42) FILTER (a <> b) * 1000) AS BIGINT) AS quality_deviating FROM (SELECT read, sum(score) AS a, sum(CASE WHEN mis THEN -4 * f ELSE t END) AS b FROM m GROUP BY read)"),
        "fidelity_of_alignments": b("SELECT count(*) AS subpaths, count(*) FILTER (a = b) AS matching, count(*) FILTER (a = b) * 1000 // count(*) AS per_mille, CAST(floor(avg(read % 42) FILTER (a = b AND len > 0) * 1000) AS BIGINT) AS quality_matching, CAST(floor(avg(read % 42) FILTER (a <> b AND len > 0) * 1000) AS BIGINT) AS quality_deviating FROM (SELECT read, sum(t) AS len, sum(score) AS a, sum(CASE WHEN mis THEN -4 * f ELSE t END) AS b FROM m WHERE read % 13 <> 0 GROUP BY read)"),
        "qualadj_scores": _QUAL,
        "encoded_targets": b("SELECT read, target_id, target_id + CASE WHEN forward THEN 2147483648 ELSE 0 END AS word FROM tg JOIN dict USING (target)"),
    }
    out["stream_records"], out["stream_summary"] = out["convert_records"], out["run_summary"]  # a stream answers as a batch does
    for at, like in (("scan_graph_store", "scan_gfa"), ("store_records", "convert_records"), ("store_records_ledger", "convert_records_ledger")):
        out[at] = out[like]  # a stored graph as the text it was made of
    for m in ("gene", "genefull", "exonoverintron", "ex50pas"):
        out[f"count_{m}"] = b(f"SELECT read, gene AS target, forward FROM c_{m} QUALIFY count(*) OVER (PARTITION BY read) = 1")
    return out
