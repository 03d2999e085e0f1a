"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), caps AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM caps WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * level THEN cap::DOUBLE
              ELSE w * (SELECT arg_min(level, cap / w) FROM levels WHERE NOT cap <= w * level) END AS target
  FROM levels
), due AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS due,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(due)::BIGINT AS whole, due - floor(due) AS p,
         CASE WHEN due > floor(due) THEN least(floor(u * (1 - (due - floor(due))) / (u * (1 - (due - floor(due))) + (1 - u) * (due - floor(due))) * 281474976710656.0), 281474976710655)
              ELSE 281474976710655 END::BIGINT AS place
  FROM due
), runs AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         target - sum(size * whole) OVER (PARTITION BY source) AS open
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND 2 * before + size <= 2 * open THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""

_KEY = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM split
), keyed AS (
  SELECT *, {_KEY} AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.last_doc AS gone FROM keyed l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM (SELECT vec_id, any_value(v) AS v FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id) q
  JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

# crc32: 256 remainders, then a step per UTF-8 byte.  Code points below 2048 only, enough for letters up to U+00FF.
_CRC_TABLE = """(
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i)
  FROM (SELECT unnest(range(256)) AS i)
)"""


def _crc(text: str, table: str) -> str:
    point = "unicode(x)"
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN {point} < 128 THEN [{point}] ELSE [192 + ({point} >> 6), 128 + ({point} & 63)] END))"
    return f"xor(4294967295, list_reduce(list_transform({utf8}, lambda b: b::BIGINT), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"


OP12 = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), uses AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run", "t")} AS h FROM uses, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), vocabulary AS (
  SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocabulary b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocabulary b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
         CASE WHEN top >= 10 * v.n THEN (SELECT min(x.other) FROM near x WHERE x.word = v.word AND x.other_n = b.top) END AS form
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word
), way(word, pos) AS (
  SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM way w JOIN formed f ON f.word = w.pos WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.pos AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN way w ON w.word = f.word JOIN formed e ON e.word = w.pos AND e.form IS NULL
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = _LEAF.replace("text::", "replace(text, chr(10), '')::")


def _tree(name: str, start: str) -> str:
    """CTE ``name`` (l, tree, pos, total, node): every level over ``start`` (tree, pos, total, node)."""
    return f"""{name}(l, tree, pos, total, node) AS (
  SELECT 0, tree, pos, total, node FROM {start}
  UNION ALL
  SELECT l + 1, tree, pos // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE total > 1 GROUP BY l, tree, pos // 3
)"""


def _folded(name: str, nodes: str, start: str) -> str:
    """CTE ``name`` (l, item, tree, pos, node): each item's node folded up its tree from ``start`` (item, tree, pos, node)."""
    return f"""{name}(l, item, tree, pos, node) AS (
  SELECT 0, item, tree, pos, node FROM {start}
  UNION ALL
  SELECT f.l + 1, f.item, f.tree, f.pos // 3, sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.node ELSE n.node END, '' ORDER BY n.pos))
  FROM {name} f JOIN {nodes} n ON n.l = f.l AND n.tree = f.tree AND n.pos // 3 = f.pos // 3 AND n.total > 1 GROUP BY f.l, f.item, f.tree, f.pos // 3
)"""


def _siblings(item: str, start: str, nodes: str, place: str, first: int) -> str:
    """Siblings of each item of ``start`` (item, tree, pos) on its way up ``nodes``, levels from ``first``."""
    return f"""SELECT s.{item} AS item, n.l + {first} AS l, n.pos, n.node FROM {start} s JOIN {nodes} n
    ON n.tree = s.{place} AND n.total > 1 AND n.pos // 3 = s.pos // (3 ** (n.l + 1))::BIGINT AND n.pos <> s.pos // (3 ** n.l)::BIGINT"""


OP13 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t), leaves AS (
  SELECT row_number() OVER () AS item, doc_id, source, sha256({_LEAF}) AS leaf,
         CASE WHEN {_crc("doc_id::VARCHAR", "t")} % 2 = 0 THEN sha256({_TAMPERED}) END AS tampered
  FROM documents, crc
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS total, leaf AS node, coalesce(tampered, leaf) AS claimed
  FROM leaves
), {_tree("nodes", "placed")}, subroots AS (
  SELECT 0 AS tree, tree AS pos, (SELECT count(DISTINCT tree) FROM placed) AS total, node FROM nodes WHERE total = 1
), {_tree("tops", "subroots")}, claims AS (
  SELECT item, tree, pos, claimed AS node FROM placed
), {_folded("fold", "nodes", "claims")}, folded_sub AS (
  SELECT f.item, 0 AS tree, f.tree AS pos, f.node FROM fold f QUALIFY row_number() OVER (PARTITION BY f.item ORDER BY f.l DESC) = 1
), {_folded("fold_top", "tops", "folded_sub")}, folded AS (
  SELECT item, node AS folded_root FROM fold_top QUALIFY row_number() OVER (PARTITION BY item ORDER BY l DESC) = 1
), siblings AS (
  {_siblings("item", "placed", "nodes", "tree", 0)}
  UNION ALL
  {_siblings("item", "folded_sub", "tops", "tree", 1000)}
), proofs AS (
  SELECT item, sha256(string_agg(node, '' ORDER BY l, pos)) AS proof FROM siblings GROUP BY item
)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM placed p JOIN subroots s ON s.pos = p.tree JOIN folded f ON f.item = p.item LEFT JOIN proofs q ON q.item = p.item,
     (SELECT node FROM tops WHERE total = 1) r
"""

SQL = {"op3_pareto_mix": OP3, "op5_topk": OP5, "op10_line_runs": OP10, "op12_spelling": OP12, "op13_merkle": OP13}
