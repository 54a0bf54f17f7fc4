"""Each query once more as one DuckDB statement over the given tables.

Written independently of the operators: similarity compares all pairs,
components come from a recursive closure.
"""

from __future__ import annotations

import re

from .catalog import EXCLUDES, PREFER, REJECT

CTE: dict[str, str] = {}

CTE["items"] = """
SELECT doc_id, '/data/'||source||'/'||lang||'/'||CASE doc_id % 12
  WHEN 0 THEN 'IMG_'||doc_id||'.JPG'            WHEN 1 THEN 'clip_'||doc_id||'.mp4'
  WHEN 2 THEN 'bundle_'||doc_id||'.zip'         WHEN 3 THEN 'note '||doc_id||' copy.txt'
  WHEN 4 THEN 'report_'||doc_id||'(1).pdf'      WHEN 5 THEN 'Makefile'||doc_id
  WHEN 6 THEN 'draft_'||doc_id||'.tmp'          WHEN 7 THEN 'd'||doc_id||'/Thumbs.db'
  WHEN 8 THEN 'node_modules/m'||doc_id||'.js'   WHEN 9 THEN 'page_'||doc_id||'_20240101.html'
  WHEN 10 THEN 'photo_'||doc_id||'.webp'        ELSE 'plain_'||doc_id||'.txt' END AS path,
  strlen(text)::BIGINT AS size, text AS content, sha256(text) AS hash,
  doc_id + 5000000 AS inode, 1704067200 + doc_id AS mtime
FROM documents"""

CTE["linked"] = """
SELECT doc_id, path, size, inode, hash FROM items
UNION ALL SELECT doc_id, path||'.hl', size, inode, hash FROM items WHERE doc_id IN (SELECT doc_id FROM labels)"""

CTE["entries"] = """
SELECT doc_id, container, 'part'||i AS entry, strlen(line)::BIGINT AS size, sha256(line) AS hash,
       container||'::part'||i AS path, 'zip_entry' AS type
FROM (SELECT doc_id, '/data/'||source||'/doc'||doc_id||'.zip' AS container,
             unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE strlen(line) > 0"""

CTE["everything"] = """
SELECT path, size, hash, 'file' AS type FROM items UNION ALL SELECT path, size, hash, type FROM entries"""

_GROUPS = """
SELECT {key}, count(*) AS n, min(path) AS first, sum(size)::BIGINT AS total, arg_min(size, path) AS first_size
FROM {source} GROUP BY {key} HAVING count(*) > 1"""
_MEMBERS = """
SELECT s.*, g.n, (g.total - g.first_size)::BIGINT AS savable, s.path = g.first AS keep
FROM {source} s JOIN {groups} g USING ({key})"""

CTE["item_groups"] = _GROUPS.format(key="hash", source="items")
CTE["item_members"] = _MEMBERS.format(source="items", groups="item_groups", key="hash")
CTE["all_groups"] = _GROUPS.format(key="hash", source="everything")
CTE["all_members"] = _MEMBERS.format(source="everything", groups="all_groups", key="hash")
CTE["regular"] = """
SELECT 'regular' AS tab, 'r:'||hash AS group_id, path, size, type, hash, keep, n, savable FROM all_members
WHERE hash NOT IN (
  SELECT hash FROM all_members GROUP BY hash
  HAVING bool_and(contains(path, '::')) AND count(DISTINCT split_part(path, '::', 1)) = 1)"""

CTE["baskets"] = "SELECT 'o'||l_orderkey AS container, 'p'||l_partkey AS hash FROM lineitem"
CTE["basket_sizes"] = """
SELECT 'o'||l_orderkey AS container, sum(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1"""
CTE["container_sizes"] = "SELECT container, sum(size)::BIGINT AS size FROM entries GROUP BY 1"

_OVERLAP = """
SELECT container_a, container_b, common, a.total AS total_a, b.total AS total_b FROM (
  SELECT x.container AS container_a, y.container AS container_b, count(*) AS common
  FROM (SELECT DISTINCT container, hash FROM {source}) x JOIN (SELECT DISTINCT container, hash FROM {source}) y
    ON x.hash = y.hash AND x.container < y.container GROUP BY 1, 2 HAVING count(*) >= {least})
JOIN (SELECT container, count(*) AS total FROM {source} GROUP BY 1) a ON a.container = container_a
JOIN (SELECT container, count(*) AS total FROM {source} GROUP BY 1) b ON b.container = container_b"""
CTE["basket_pairs"] = _OVERLAP.format(source="baskets", least=2)
CTE["entry_pairs"] = _OVERLAP.format(source="entries", least=2)

CTE["vectors"] = """
SELECT vec_id * 3 AS id, vec_id, 0 AS k, embedding::DOUBLE[] AS v FROM embeddings
UNION ALL SELECT vec_id * 3 + 1, vec_id, 1, list_transform(embedding::DOUBLE[], lambda x, j:
  CASE WHEN (vec_id + j - 1) % (CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 16 END) = 0 THEN -x ELSE x END) FROM embeddings
UNION ALL SELECT vec_id * 3 + 2, vec_id, 2, list_transform(embedding::DOUBLE[], lambda x:
  CASE WHEN vec_id % 5 = 0 THEN x ELSE -x END) FROM embeddings"""
CTE["fp"] = """
SELECT id, vec_id, k, array_to_string(list_transform(v, lambda x: CASE WHEN x > mu THEN '1' ELSE '0' END), '') AS bits
FROM (SELECT *, list_sum(v) / len(v) AS mu FROM vectors)"""
CTE["kinds"] = "SELECT bits, min(id) AS rep, count(*) AS n FROM fp GROUP BY bits"
CTE["near"] = """
SELECT a.bits AS bits_a, b.bits AS bits_b, a.rep AS a, b.rep AS b, hamming(a.bits, b.bits)::BIGINT AS dist,
       a.n AS n_a, b.n AS n_b
FROM kinds a JOIN kinds b ON a.bits < b.bits WHERE hamming(a.bits, b.bits) <= 10"""

CTE["frames"] = """
SELECT vec_id // 5 * 4 AS seq, vec_id % 5 AS frame, bits FROM fp WHERE k = 0
UNION ALL SELECT vec_id // 7 * 4 + 1, vec_id % 7, bits FROM fp WHERE k = 1
UNION ALL SELECT vec_id // 5 * 4 + 2, vec_id % 5, CASE vec_id // 5 % 4 WHEN 0 THEN bits
  WHEN 1 THEN translate(bits[1:1], '01', '10')||bits[2:] WHEN 2 THEN translate(bits[1:6], '01', '10')||bits[7:]
  ELSE translate(bits, '01', '10') END FROM fp WHERE k = 0"""
CTE["seqs"] = "SELECT seq AS id, list(bits ORDER BY frame) AS f FROM frames GROUP BY 1"
CTE["seq_kinds"] = "SELECT f, min(id) AS rep, count(*) AS n FROM seqs GROUP BY f"
CTE["one_way"] = """
SELECT a, b, avg(m)::DOUBLE AS d FROM (
  SELECT x.seq AS a, y.seq AS b, x.frame, min(hamming(x.bits, y.bits)) AS m
  FROM (SELECT * FROM frames WHERE seq IN (SELECT rep FROM seq_kinds)) x
  JOIN (SELECT * FROM frames WHERE seq IN (SELECT rep FROM seq_kinds)) y ON x.seq <> y.seq GROUP BY ALL) GROUP BY a, b"""
CTE["seq_near"] = """
SELECT p.a, p.b, least(p.d, q.d) AS dist FROM one_way p JOIN one_way q ON p.a = q.b AND p.b = q.a
WHERE p.a < p.b AND least(p.d, q.d) <= 10"""
_ALIGNED = """list_avg(list_transform(range(least(len({a}), len({b}))), lambda i:
  hamming({a}[i * len({a}) // least(len({a}), len({b})) + 1], {b}[i * len({b}) // least(len({a}), len({b})) + 1])))"""
CTE["seq_near_aligned"] = f"""
SELECT * FROM (SELECT x.rep AS a, y.rep AS b, {_ALIGNED.format(a='x.f', b='y.f')} AS dist
FROM seq_kinds x JOIN seq_kinds y ON x.rep < y.rep) WHERE dist <= 10"""

CTE["images"] = """
SELECT id, bits, '/img/'||id||'.png' AS path, (vec_id * 10 + k + 100)::BIGINT AS size FROM fp"""
CTE["clips"] = """
SELECT id, f, '/clip/'||id||'.mp4' AS path, (id * 7 + 1000)::BIGINT AS size FROM seqs"""


def _closure(name: str, edges: str, nodes: str) -> None:
    """(node, root) for every node: smallest node reachable over the edges."""
    CTE[f"{name}_sym"] = f"SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})"
    CTE[f"{name}_reach"] = (
        f"SELECT node, node AS other FROM ({nodes}) "
        f"UNION SELECT r.node, s.b FROM {name}_reach r JOIN {name}_sym s ON r.other = s.a"
    )
    CTE[name] = f"SELECT node, min(other) AS root FROM {name}_reach GROUP BY node"


_closure("fp_parts", "SELECT a, b FROM near", "SELECT rep AS node FROM kinds")
_closure("seq_parts", "SELECT a, b FROM seq_near", "SELECT rep AS node FROM seq_kinds")
_closure("seq3_parts", "SELECT a, b FROM seq_near_aligned WHERE dist <= 3", "SELECT rep AS node FROM seq_kinds")
_closure("seq10_parts", "SELECT a, b FROM seq_near_aligned", "SELECT rep AS node FROM seq_kinds")
_closure("basket_parts", "SELECT container_a AS a, container_b AS b FROM basket_pairs",
         "SELECT container_a AS node FROM basket_pairs UNION SELECT container_b FROM basket_pairs")
_closure("entry_parts", "SELECT container_a AS a, container_b AS b FROM entry_pairs",
         "SELECT container_a AS node FROM entry_pairs UNION SELECT container_b FROM entry_pairs")

CTE["fp_groups"] = """
SELECT root, sum(n)::BIGINT AS members, coalesce(max(far), 0) AS far FROM fp_parts
JOIN kinds ON rep = node LEFT JOIN (
  SELECT a, max(dist) AS far FROM (SELECT a, dist FROM near UNION ALL SELECT b, dist FROM near) GROUP BY a) ON a = node
GROUP BY root HAVING sum(n) > 1"""
CTE["alike"] = """
SELECT fp.id, fp.bits, root, members, CASE WHEN far <= 0 THEN 'exact' ELSE 'similar' END AS category
FROM fp JOIN kinds USING (bits) JOIN fp_parts ON node = rep JOIN fp_groups USING (root)"""
CTE["seq_groups"] = """
SELECT root, sum(n)::BIGINT AS members, coalesce(max(far), 0) AS far FROM seq_parts
JOIN seq_kinds ON rep = node LEFT JOIN (
  SELECT a, max(dist) AS far FROM (SELECT a, dist FROM seq_near UNION ALL SELECT b, dist FROM seq_near) GROUP BY a)
  ON a = node
GROUP BY root HAVING sum(n) > 1"""
CTE["similar_seq"] = """
SELECT s.id, len(s.f)::BIGINT AS frame_count, root, members,
       CASE WHEN far <= 3 THEN 'exact' ELSE 'similar' END AS category
FROM seqs s JOIN seq_kinds USING (f) JOIN seq_parts ON node = rep JOIN seq_groups USING (root)"""


def _container_groups(name: str, pairs: str, parts: str, source: str, sizes: str) -> None:
    CTE[name] = f"""
SELECT p.node AS container, p.root, count(*) OVER g AS n, s.shared, t.total, z.size,
       (sum(z.size) OVER g - max(z.size) OVER g)::BIGINT AS savable,
       row_number() OVER (PARTITION BY p.root ORDER BY z.size DESC, p.node) = 1 AS keep
FROM {parts} p
JOIN (SELECT q.root, max(common) AS shared FROM {pairs} JOIN {parts} q ON q.node = container_a GROUP BY 1) s USING (root)
JOIN (SELECT container, count(*) AS total FROM {source} GROUP BY 1) t ON t.container = p.node
JOIN {sizes} z ON z.container = p.node
WINDOW g AS (PARTITION BY p.root)"""


_container_groups("basket_groups", "basket_pairs", "basket_parts", "baskets", "basket_sizes")
_container_groups("entry_groups", "entry_pairs", "entry_parts", "entries", "container_sizes")

CTE["kept_items"] = "SELECT * FROM items WHERE path NOT LIKE '%.tmp' AND path NOT LIKE '%/Thumbs.db'"
CTE["scan_source"] = """
SELECT path, size, hash, 'file' AS type FROM kept_items UNION ALL SELECT path, size, hash, type FROM entries"""
CTE["scan_groups"] = _GROUPS.format(key="hash", source="scan_source")
CTE["scan_members"] = _MEMBERS.format(source="scan_source", groups="scan_groups", key="hash")
CTE["tabs"] = """
SELECT 'regular' AS tab, 'r:'||hash AS group_id, path, size, type, hash, NULL AS category, NULL::BIGINT AS frame_count,
       NULL::BIGINT AS shared, keep FROM scan_members
WHERE hash NOT IN (
  SELECT hash FROM scan_members GROUP BY hash
  HAVING bool_and(contains(path, '::')) AND count(DISTINCT split_part(path, '::', 1)) = 1)
UNION ALL
SELECT 'image', 'i:'||root, i.path, i.size, 'file', NULL, category, NULL, NULL,
       i.path = min(i.path) OVER (PARTITION BY root) FROM alike JOIN images i USING (id)
UNION ALL
SELECT 'video', 'v:'||root, c.path, c.size, 'file', NULL, category, frame_count, NULL,
       c.path = min(c.path) OVER (PARTITION BY root) FROM similar_seq JOIN clips c USING (id)
UNION ALL
SELECT 'archive', 'a:'||root, container, size, 'archive', NULL, NULL, NULL, shared, keep FROM entry_groups"""

CTE["cache"] = """
SELECT path, size, mtime - 86400 * toxic AS mtime, CASE WHEN quality = 1 THEN hash END AS hash,
       CASE WHEN quality = 0 THEN left(hash, 16) END AS phash
FROM items JOIN labels USING (doc_id)"""
CTE["now"] = "SELECT path, size FROM items WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _contains_sum(texts: list[str], sign: str) -> str:
    return "".join(f" {sign} contains(path, '{t}')::BIGINT" for t in texts)


RULES = "0" + _contains_sum(PREFER, "+") + _contains_sum(REJECT, "-")
ORIGIN = (
    "len(string_split(path, '/')) + CASE WHEN regexp_matches(path, "
    "'(?i)copy|복사|\\(\\d+\\)|_\\d{8}|[ _-]copy\\d*') THEN 10 ELSE 0 END"
)
CTE["marked"] = f"""
SELECT hash AS group_id, path, {RULES} AS score, CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END AS mark
FROM item_members LEFT JOIN labels USING (doc_id)"""
CTE["resolved"] = """
SELECT m.*, CASE WHEN all_marked THEN 'marked' WHEN tops = 1 THEN 'ruled' ELSE 'unresolved' END AS status,
       CASE WHEN all_marked THEN mark = 'NO' WHEN tops = 1 THEN score < top ELSE false END AS remove
FROM marked m JOIN (
  SELECT group_id, top, all_marked, count(*) FILTER (score = top) AS tops FROM (
    SELECT *, max(score) OVER g AS top, bool_and(mark IS NOT NULL) OVER g AS all_marked
    FROM marked WINDOW g AS (PARTITION BY group_id)) GROUP BY ALL) USING (group_id)"""

SQL: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    SQL[name] = body


def _printf(n: str, units: str) -> str:
    """One-decimal text for thresholds from TB down to KB."""
    rows = " ".join(
        f"WHEN n >= {1024 ** p} THEN printf('%.1f {u}', n / {1024 ** p}.0)"
        for u, p in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1))
    )
    return f"CASE {rows} ELSE {units} END"


sql("file_inventory", "SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL")
sql("exact_duplicate_files", "SELECT hash, n, first_size AS size, (total - first_size)::BIGINT AS savable FROM item_groups")
sql("multi_root_union", "SELECT path, size FROM items")
sql("zip_entries", "SELECT path, size, hash, type FROM entries")
sql("tar_entries", "SELECT path, size, hash, 'tar_entry' AS type FROM entries")
sql("container_entry_total", "SELECT path, count(*) OVER (PARTITION BY container) AS total FROM entries")
sql("load_session_csv", "SELECT group_id, path, size, type, hash, keep FROM regular")
sql("load_fingerprint_cache", "SELECT path, size, mtime, hash, phash FROM cache")

sql("content_hash", "SELECT path, hash FROM items")
sql("head_hash", "SELECT path, sha256(encode(content)[1:1024]) AS hash FROM items")
sql("tail_hash", "SELECT path, sha256(encode(content)[greatest(size - 1023, 1):size]) AS hash FROM items")
sql("entry_fingerprint", """
SELECT path, CASE WHEN size * 64 <= 1048576 THEN left(hash, 16)
  ELSE lpad(lower(to_hex(xor(size * 64, strlen(path)::BIGINT))), 16, '0') END AS fingerprint FROM items""")
sql("split_container_path", """
SELECT path, container, entry, true AS is_entry FROM entries
UNION ALL SELECT path, path, NULL, false FROM items""")
sql("classify_media", """
SELECT path, CASE regexp_extract(lower(path), '\\.([^./]*)$', 1)
  WHEN 'jpg' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'zip' THEN 'archive'
  ELSE 'other' END AS media FROM items""")
sql("format_size", f"""
SELECT doc_id, n, {_printf('n', "n||' B'")} AS scanner, {_printf('n', "n||' B'")} AS report,
  {_printf('n', "n||'.0 B'")} AS web,
  CASE WHEN n >= 1073741824 THEN g // 10||'.'||g % 10||' GB' WHEN n >= 1048576 THEN m // 10||'.'||m % 10||' MB'
    WHEN n >= 1024 THEN (n + 512) // 1024||' KB' ELSE n||' B' END AS stats
FROM (SELECT *, (n::HUGEINT * 10 + 536870912) // 1073741824 AS g, (n::HUGEINT * 10 + 524288) // 1048576 AS m
  FROM (SELECT doc_id, size * (1::BIGINT << (doc_id % 36)) AS n FROM items))""")
sql("origin_score", f"SELECT path, ({ORIGIN})::BIGINT AS score FROM items")
sql("rule_score", f"SELECT path, ({RULES})::BIGINT AS score FROM items")
_AT = [0, 0, 1, 2, 3, 4, 5, 6, 7]
_DIFFS = ", ".join(f"g[{_AT[y] * 8 + _AT[x + 1] + 1}] - g[{_AT[y] * 8 + _AT[x] + 1}]" for y in range(8) for x in range(8))
sql("pixel_hash", f"""
SELECT id, array_to_string(list_transform(d, lambda x: CASE WHEN x > mu THEN '1' ELSE '0' END), '') AS bits
FROM (SELECT id, d, list_sum(d) / 64.0 AS mu FROM (SELECT id, [{_DIFFS}] AS d FROM (
  SELECT id, list_transform(v, lambda x: floor((x + 1) * 127)) AS g FROM vectors)))""")
sql("vector_sign_hash", "SELECT id, bits FROM fp")
sql("luma_rgb", """
SELECT id, array_to_string(list_transform(range(21), lambda i:
  ((g[3 * i + 1] + g[3 * i + 2] + g[3 * i + 3]) // 3)::VARCHAR), ',') AS gray
FROM (SELECT id, list_transform(v, lambda x: floor((x + 1) * 127)::BIGINT) AS g FROM vectors)""")
sql("hamming_distance", """
SELECT vec_id, a.k::BIGINT AS kind_a, b.k::BIGINT AS kind_b, hamming(a.bits, b.bits)::BIGINT AS dist,
  hamming(a.bits, b.bits)::BIGINT AS dist_hex FROM fp a JOIN fp b USING (vec_id) WHERE a.k < b.k""")
_PAIRS = "seqs a JOIN seqs b ON a.id // 4 = b.id // 4 AND a.id % 4 = 0 AND b.id % 4 > 0"
_WAY = "list_avg(list_transform({a}, lambda p: list_min(list_transform({b}, lambda q: hamming(p, q)))))"
sql("sequence_distance_mean_min", f"""
SELECT a.id AS id_a, b.id AS id_b,
  round(least({_WAY.format(a='a.f', b='b.f')}, {_WAY.format(a='b.f', b='a.f')}), 6) AS dist FROM {_PAIRS}""")
sql("sequence_distance_aligned", f"""
SELECT a.id AS id_a, b.id AS id_b, round({_ALIGNED.format(a='a.f', b='b.f')}, 6) AS dist FROM {_PAIRS}""")
sql("sequence_sample", """
SELECT user_id, sample, frame, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)
JOIN (SELECT user_id, i AS sample, floor(n * 0.1)::BIGINT + i * greatest(n - 2 * floor(n * 0.1)::BIGINT, 1) // 10 AS frame
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(10) r(i)) USING (user_id, frame)""")
sql("sequence_sample_seconds", """
WITH spans AS (SELECT user_id, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 % 4000)::DOUBLE AS s FROM events GROUP BY 1),
cut AS (SELECT *, s * 0.05::DOUBLE AS m, CASE WHEN s >= 1800 THEN 20 ELSE 10 END::BIGINT AS n FROM spans)
SELECT user_id, 'exclusive' AS form, i AS sample,
  round(floor((m + (greatest(s - m, m + 1) - m) * i / n) * 1000000::DOUBLE) / 1000000::DOUBLE, 5) AS at
FROM cut, LATERAL (SELECT unnest(range(n)) AS i)
UNION ALL SELECT user_id, 'inclusive', i, round(s * 0.1::DOUBLE + (s * 0.9::DOUBLE - s * 0.1::DOUBLE) * (i / 9::DOUBLE), 5)
FROM spans, range(10) r(i)""")
sql("cache_key", "SELECT path||'|'||size||'|'||mtime AS cache_key FROM items")
sql("short_hash", "SELECT path, left(hash, 8) AS short FROM items")

sql("ignore_builtin", "SELECT path FROM kept_items")
sql("exclude_rules", """
SELECT path FROM items WHERE path NOT LIKE '%.webp' AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%.tmp'
  AND regexp_matches(path, '\\.[^/]*$')""")
sql("exclude_fnmatch", """
SELECT path FROM items WHERE path NOT LIKE '%.webp' AND regexp_extract(path, '[^/]*$') NOT LIKE '%copy%'
  AND path NOT LIKE '%copy%' AND path NOT LIKE '/data/src1_/%'""")
sql("min_size_filter", "SELECT path, size FROM items WHERE size >= 1024")
sql("size_candidates", "SELECT path, size FROM items WHERE size IN (SELECT size FROM items GROUP BY 1 HAVING count(*) > 1)")
sql("head_tail_candidates", """
WITH h AS (SELECT path, size, sha256(encode(content)[1:1024]) AS head,
             sha256(encode(content)[greatest(size - 1023, 1):size]) AS tail FROM items),
     h2 AS (SELECT *, count(*) OVER (PARTITION BY size, head) AS nh FROM h)
SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size, head, tail) AS nt FROM h2 WHERE nh > 1) WHERE nt > 1""")
sql("drop_single_container_groups", "SELECT hash, path FROM regular")
sql("group_text_filter", """
SELECT group_id, path FROM regular WHERE group_id IN (SELECT group_id FROM regular WHERE contains(lower(path), 'src1/en'))""")
sql("group_type_filter", """
SELECT group_id, path, CASE WHEN bool_or(contains(path, '::')) OVER (PARTITION BY group_id) THEN 'archive'
  ELSE 'normal' END AS kind FROM regular""")
sql("min_container_entries", """
SELECT path FROM entries WHERE container IN (SELECT container FROM entries GROUP BY 1 HAVING count(*) >= 10)""")
sql("skip_known_duplicates", "SELECT path FROM items WHERE path NOT IN (SELECT path FROM item_members WHERE NOT keep)")

sql("hamming_join", "SELECT bits_a, bits_b, dist, n_a, n_b FROM near")
sql("container_overlap", "SELECT * FROM basket_pairs")
sql("container_overlap_documents", "SELECT * FROM entry_pairs")
sql("container_overlap_entries", """
SELECT x.container AS container_a, y.container AS container_b, count(*) AS common
FROM entries x JOIN (SELECT DISTINCT container, hash FROM entries) y ON x.hash = y.hash AND x.container < y.container
GROUP BY 1, 2 HAVING count(*) >= 2""")
CTE["contents"] = """
SELECT container, list(hash ORDER BY hash) AS all_, len(list_distinct(list(hash))) AS kinds, count(*) AS total
FROM entries GROUP BY container"""
CTE["classes"] = """
SELECT container, min(container) OVER w AS rep, kinds::BIGINT AS kinds, total, count(*) OVER w AS copies
FROM contents WINDOW w AS (PARTITION BY all_)"""
sql("container_classes", "SELECT * FROM classes")
sql("overlap_classes", """
SELECT container_a AS rep_a, container_b AS rep_b, common, total_a, total_b, a.copies AS copies_a, b.copies AS copies_b
FROM entry_pairs JOIN classes a ON a.rep = container_a AND a.container = container_a
JOIN classes b ON b.rep = container_b AND b.container = container_b
UNION ALL SELECT rep, rep, kinds, total, total, copies, copies FROM classes
WHERE container = rep AND copies > 1 AND kinds >= 2""")
sql("overlap_ratios", """
SELECT container_a, container_b, printf('%.1f', common / total_a * 100)::DOUBLE AS ratio_a,
  printf('%.1f', common / total_b * 100)::DOUBLE AS ratio_b FROM entry_pairs""")
_SEQ_PAIRS = """
SELECT a AS id_a, b AS id_b, round(dist, 6) AS dist, x.n AS n_a, y.n AS n_b
FROM {near} JOIN seq_kinds x ON x.rep = a JOIN seq_kinds y ON y.rep = b"""
sql("sequence_similarity_join", _SEQ_PAIRS.format(near="seq_near"))
sql("sequence_similarity_join_aligned", _SEQ_PAIRS.format(near="seq_near_aligned"))
sql("cache_lookup", """
SELECT i.path, c.hash, c.phash FROM items i LEFT JOIN cache c ON c.path = i.path AND c.size = i.size AND c.mtime = i.mtime""")
sql("cache_misses", """
SELECT i.path FROM items i WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.path = i.path AND c.size = i.size
  AND c.mtime = i.mtime AND c.hash IS NOT NULL)""")
sql("drop_missing", "SELECT hash, path FROM item_members WHERE path IN (SELECT path FROM now)")
CTE["left_over"] = """
SELECT tab, group_id, path FROM tabs WHERE path NOT IN (
  SELECT path FROM tabs WHERE NOT contains(path, '::') AND length(path) % 3 = 0 GROUP BY path HAVING NOT bool_or(keep))"""
sql("apply_deletions", """
SELECT tab, group_id, path FROM left_over
QUALIFY count(*) OVER (PARTITION BY tab, group_id) > 1""")

_MEMBER_OUT = "SELECT hash, path, size, n, savable, keep FROM "
sql("exact_duplicates", _MEMBER_OUT + "item_members")
sql("exact_duplicates_staged", _MEMBER_OUT + "item_members WHERE size >= 1024")
sql("exact_duplicates_with_entries", _MEMBER_OUT + "all_members")
sql("hardlink_groups", """
SELECT inode, size, path, count(*) OVER w AS n, path = min(path) OVER w AS keep FROM linked
WINDOW w AS (PARTITION BY inode, size) QUALIFY count(*) OVER w > 1""")
sql("hardlink_representatives", "SELECT hash, path, n, keep FROM item_members")
sql("connected_components", "SELECT node, root AS component FROM basket_parts")
sql("similar_groups", "SELECT id, root, members, category FROM alike")
sql("similar_groups_two_level", """
SELECT id, rep AS root, n AS members, 'exact' AS category FROM fp JOIN kinds USING (bits) WHERE n > 1
UNION ALL
SELECT id, root, members, 'similar' FROM alike WHERE root NOT IN (
  SELECT root FROM alike JOIN kinds USING (bits) WHERE n > 1)""")
sql("similar_sequences", "SELECT id, root, members, category, frame_count FROM similar_seq")
CTE["seq3"] = """
SELECT s.id, s.f, p.root, count(*) OVER (PARTITION BY p.root) AS members FROM seqs s JOIN seq_kinds USING (f)
JOIN seq3_parts p ON p.node = rep QUALIFY members > 1"""
CTE["seq10"] = """
SELECT s.id, s.f, p.root, count(*) OVER (PARTITION BY p.root) AS members FROM seqs s JOIN seq_kinds USING (f)
JOIN seq10_parts p ON p.node = rep QUALIFY members > 1"""
sql("similar_sequences_two_level", """
SELECT id, root, members, 'exact' AS category, len(f)::BIGINT AS frame_count FROM seq3
UNION ALL SELECT id, root, members, 'similar', len(f)::BIGINT FROM seq10
WHERE root NOT IN (SELECT root FROM seq10 WHERE id IN (SELECT id FROM seq3))""")
sql("container_groups", "SELECT container, root, n, shared, total, size, savable, keep FROM basket_groups")
sql("container_pair_groups", """
SELECT container_a, container_b, common, a.size AS size_a, b.size AS size_b, least(a.size, b.size) AS savable
FROM basket_pairs JOIN basket_sizes a ON a.container = container_a JOIN basket_sizes b ON b.container = container_b""")
CTE["collapsed"] = """
SELECT hash, path, max(size) AS size, CASE WHEN inside THEN 'archive' ELSE 'file' END AS type,
  CASE WHEN inside THEN count(*) END AS matched, CASE WHEN inside THEN max(total) END AS total
FROM (SELECT hash, size, contains(path, '::') AS inside, split_part(path, '::', 1) AS path FROM all_members)
LEFT JOIN (SELECT container, count(*) AS total FROM entries GROUP BY 1) t ON t.container = path
GROUP BY hash, path, inside"""
sql("container_collapse", "SELECT * FROM collapsed")
CTE["rollup"] = """
WITH e AS (SELECT DISTINCT split_part(path, '::', 1) AS container, hash FROM all_members WHERE hash IN (
  SELECT hash FROM all_members GROUP BY 1 HAVING bool_and(contains(path, '::'))))
SELECT x.container AS container_a, y.container AS container_b, count(*) AS shared
FROM e x JOIN e y ON x.hash = y.hash AND x.container < y.container GROUP BY 1, 2"""
sql("container_pair_rollup", "SELECT * FROM rollup")
sql("group_savable", """
SELECT group_id, count(*) AS n, sum(size)::BIGINT AS bytes, (sum(size) - arg_min(size, path))::BIGINT AS savable
FROM regular GROUP BY 1""")
sql("savable_by_mark", f"""
SELECT group_id, sum(CASE WHEN rn > 1 THEN size ELSE 0 END)::BIGINT AS savable_by_mark FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {ORIGIN}, path) AS rn FROM regular) GROUP BY 1""")
sql("scan_summary", """
SELECT count(*) AS groups, sum(n)::BIGINT AS members, sum(first_size * (n - 1))::BIGINT AS wasted FROM item_groups""")
sql("type_stats", """
WITH t AS (SELECT size, CASE WHEN tab <> 'regular' THEN tab
  WHEN regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff|heic)$') THEN 'image'
  WHEN regexp_matches(lower(path), '\\.(mp4|mkv|avi|mov|wmv|flv|webm|m4v)$') THEN 'video'
  WHEN regexp_matches(lower(path), '\\.(zip|7z|rar|tar|gz|bz2|xz)$') THEN 'archive' ELSE 'regular' END AS type FROM tabs)
SELECT type, count(*) AS n, sum(size)::BIGINT AS bytes,
  floor(count(*) * 100 / (SELECT count(*) FROM t) + 0.5)::BIGINT AS percent FROM t GROUP BY type
UNION ALL SELECT 'total', count(*), sum(size)::BIGINT, 100 FROM t""")
sql("tab_badges", "SELECT tab, count(DISTINCT group_id) AS groups, sum(size)::BIGINT AS bytes FROM tabs GROUP BY tab")
sql("removal_stats", """
SELECT tab, count(DISTINCT group_id) AS groups, count(*) FILTER (NOT keep) AS remove,
  sum(CASE WHEN keep THEN 0 ELSE size END)::BIGINT AS remove_bytes FROM tabs GROUP BY tab""")
sql("overlap_header", """
SELECT tab, group_id, count(*) AS n, CASE tab WHEN 'archive' THEN 'shared '||max(shared) WHEN 'regular' THEN max(hash)
  ELSE max(category) END AS label FROM tabs GROUP BY tab, group_id""")
sql("full_scan", "SELECT tab, group_id, path, size, category, frame_count, shared, keep FROM tabs")

sql("keep_first", "SELECT hash, path, keep FROM item_members")
sql("keep_original", f"""
SELECT hash, path, ({ORIGIN})::BIGINT AS score,
  row_number() OVER (PARTITION BY hash ORDER BY {ORIGIN}, path) = 1 AS keep FROM item_members""")
sql("resolve_keepers", "SELECT group_id, path, score::BIGINT AS score, status, remove FROM resolved")
sql("group_ids", """
SELECT 'r'||row_number() OVER (ORDER BY savable DESC, group_id) AS group_id, group_id AS root, savable FROM (
  SELECT group_id, (sum(size) - arg_min(size, path))::BIGINT AS savable FROM regular GROUP BY 1)""")
_BY = {
    "savable": "savable", "total": "largest", "count": "n", "archive_first": "has_entry", "shared": "coalesce(shared, 0)",
}
sql("sort_groups", "SELECT group_id, " + ", ".join(
    f"row_number() OVER (ORDER BY {by} DESC, group_id) AS by_{name}" for name, by in _BY.items()
) + """, row_number() OVER (ORDER BY group_id) AS by_none FROM (
  SELECT group_id, sum(size) - arg_min(size, path) AS savable, max(size) AS largest, count(*) AS n,
    max(contains(path, '::')::INT) AS has_entry, max(shared) AS shared FROM tabs GROUP BY 1)""")
sql("top_overlaps", """
SELECT container_a, container_b, common FROM entry_pairs ORDER BY common DESC, container_a, container_b LIMIT 5""")
sql("unresolved_sample", """
WITH u AS (SELECT group_id, count(*) AS members FROM resolved WHERE status = 'unresolved' GROUP BY 1)
SELECT group_id, members, greatest((SELECT count(*) FROM u) - 10, 0)::BIGINT AS remaining FROM u ORDER BY group_id LIMIT 10""")

sql("union_items", "SELECT path, size, hash, type FROM everything")
sql("shared_hashes", """
SELECT DISTINCT container_a, container_b, x.hash FROM entry_pairs JOIN entries x ON x.container = container_a
JOIN entries y ON y.container = container_b AND x.hash = y.hash""")
sql("missing_paths", "SELECT path FROM item_members WHERE path NOT IN (SELECT path FROM now)")

sql("mark_groups", """
SELECT group_id, path, CASE WHEN path = max(path) OVER w THEN NOT k ELSE k END AS keep FROM (
  SELECT *, CASE WHEN bool_or(contains(lower(path), 'src1/en')) OVER w THEN true ELSE keep END AS k FROM regular
  WINDOW w AS (PARTITION BY group_id)) WINDOW w AS (PARTITION BY group_id)""")
CTE["original"] = f"""
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {ORIGIN}, path) = 1 AS best FROM regular"""
sql("deletion_plan", "SELECT path, size FROM original WHERE NOT best AND NOT contains(path, '::')")
sql("deletion_log", """
SELECT log_day, path, 'delete' AS method, size FROM regular, (VALUES ('2024-01-02'), ('2024-01-03')) days(log_day)
WHERE NOT keep AND NOT contains(path, '::')""")
sql("export_regular_csv", """
SELECT group_id, path, size::VARCHAR AS size, type, hash, '2024-01-01 00:00:00' AS created,
  CASE WHEN keep THEN 'YES' ELSE 'NO' END AS keep FROM regular""")
sql("export_duplicates_report", f"""
SELECT 'groups' AS section, hash AS group_id, left(hash, 8) AS a, path AS b, {_printf('n', "n||' B'")} AS size, type,
  coalesce(matched::VARCHAR, '') AS count
FROM (SELECT *, size AS n FROM collapsed WHERE hash IN (SELECT hash FROM collapsed WHERE type = 'file'))
UNION ALL SELECT 'pairs', '', container_a, container_b, '', 'archive', shared::VARCHAR FROM rollup""")
sql("export_similar_csv", """
SELECT category, 'i:'||root AS group_id, i.path, i.size::VARCHAR AS size_bytes, 'file' AS type, i.bits,
  CASE WHEN i.path = min(i.path) OVER (PARTITION BY root) THEN 'YES' ELSE 'NO' END AS keep FROM alike JOIN images i USING (id)""")
sql("export_sequence_csv", """
SELECT category, 'v:'||root AS group_id, c.path, c.size::VARCHAR AS size_bytes, frame_count::VARCHAR AS frame_count,
  CASE WHEN c.path = min(c.path) OVER (PARTITION BY root) THEN 'YES' ELSE 'NO' END AS keep
FROM similar_seq JOIN clips c USING (id)""")
sql("export_overlap_csv", """
SELECT container_a AS archive_a, container_b AS archive_b, common::VARCHAR AS common_files, total_a::VARCHAR AS a_total,
  total_b::VARCHAR AS b_total, printf('%.1f', common / total_a * 100) AS overlap_ratio_a,
  printf('%.1f', common / total_b * 100) AS overlap_ratio_b FROM entry_pairs""")
sql("save_session", """
SELECT tab, group_id, count(*) AS n, (sum(size) - arg_min(size, path))::BIGINT AS savable, max(category) AS category
FROM tabs GROUP BY 1, 2""")
sql("update_fingerprint_cache", """
SELECT coalesce(i.path, c.path) AS path, coalesce(i.size, c.size) AS size, coalesce(i.mtime, c.mtime) AS mtime,
  coalesce(i.hash, c.hash) AS hash, c.phash
FROM items i FULL JOIN cache c ON c.path = i.path AND c.size = i.size AND c.mtime = i.mtime""")

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def _needed(text: str, seen: list[str]) -> list[str]:
    """CTEs a text refers to, each after those it depends on."""
    for word in _WORD.findall(text):
        if word in CTE and word not in seen and not (word in _OPEN):
            _OPEN.add(word)
            _needed(CTE[word], seen)
            _OPEN.discard(word)
            seen.append(word)
    return seen


_OPEN: set[str] = set()


def statement(name: str) -> str:
    """The whole statement: the body with the views it uses in front."""
    body = SQL[name].strip()
    views = [f"{view} AS ({CTE[view].strip()})" for view in _needed(body, [])]
    if not views:
        return body
    head = "WITH RECURSIVE " + ",\n".join(views)
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[len("WITH "):]
    return head + "\n" + body


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in SQL}
