"""SQL equivalents that are made of repeated steps: rounds of averaging, levels of a tree."""

from __future__ import annotations


def vector_codes(rounds: int = 4) -> str:
    """Codes by comparing every part with every entry in each round."""
    steps = [
        """
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT row, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x, list_inner_product(x, x) AS xx FROM kept, range(4) AS t(p)),
code0 AS MATERIALIZED (SELECT p, row - 1 AS entry, x AS c FROM parts WHERE row <= 256)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, p, min((xx - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + entry) AS best
  FROM parts JOIN code{r} USING (p) GROUP BY row, p)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT p, entry, list(m ORDER BY i) AS c
  FROM (SELECT p, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS m
        FROM near{r} JOIN parts USING (row, p), (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(x) GROUP BY ALL)
  GROUP BY p, entry),
code{r + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m.c, o.c) AS c FROM code{r} o LEFT JOIN mean{r} m USING (p, entry))""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string([z::BIGINT FOR z IN c], ','), ',' ORDER BY p, entry)) FROM code{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row)
"""


def _above(name: str, key: str, levels: int) -> list[str]:
    """Levels over the table ``{name}0(key, i, d, start)``: nodes, and the siblings of each on the way up."""
    steps = []
    for h in range(levels):
        steps.append(f"""
{name}{h + 1} AS MATERIALIZED (
  SELECT {key}, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d
  FROM {name}{h} WHERE {key} IN (SELECT {key} FROM {name}{h} GROUP BY {key} HAVING count(*) > 1) GROUP BY {key}, i // 16)""")
    return steps


def _top(name: str, key: str, levels: int) -> str:
    parts = [f"SELECT {key}, {h} AS h, min(d) AS d FROM {name}{h} GROUP BY {key} HAVING count(*) = 1" for h in range(levels + 1)]
    return " UNION ALL ".join(parts)


def _siblings(name: str, key: str, levels: int) -> str:
    parts = [
        f"""SELECT a.{key}, {h} AS h, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
        coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
        FROM {name}{h} a JOIN {name}{h} b ON a.{key} = b.{key} AND a.i // 16 = b.i // 16 GROUP BY a.{key}, a.i"""
        for h in range(levels)
    ]
    return " UNION ALL ".join(parts)


def merkle_log(levels: int = 6) -> str:
    """Leaves, levels of every tree, and each leaf folded up by one level after the other.

    The checksum is computed with a table of the usual polynomial.
    """
    framed = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    head = " || ".join(framed.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rounds = ["SELECT n AS i, n AS c FROM (SELECT unnest(range(256)) AS n)"]
    for _ in range(8):
        rounds.append(f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({rounds[-1]})")
    steps = [
        f"crc AS (SELECT list(c ORDER BY i) AS t FROM ({rounds[-1]}))",
        f"""
leaves AS MATERIALIZED (
  SELECT doc_id, source, sha256({head} || {framed.format("text")}) AS leaf, sha256({head} || {framed.format(low)}) AS low_leaf,
         xor(list_reduce([ascii(z) FOR z IN string_split(doc_id::VARCHAR, '')], lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1]), 4294967295), 4294967295) AS sum
  FROM documents, crc),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM documents)),
placed AS MATERIALIZED (
  SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf,
         CASE WHEN sum % 5 = 0 THEN low_leaf ELSE leaf END AS changed
  FROM leaves JOIN sources ON leaves.source IS NOT DISTINCT FROM sources.source),
node0 AS (SELECT grp, i, leaf AS d FROM placed)""",
        *_above("node", "grp", levels),
        f"tops AS MATERIALIZED ({_top('node', 'grp', levels)})",
        "root0 AS (SELECT 0 AS one, grp AS i, d FROM tops)",
        *_above("root", "one", levels),
        f"root AS ({_top('root', 'one', levels)})",
        f"""
steps AS MATERIALIZED (
  SELECT grp, h, i, before, after FROM ({_siblings('node', 'grp', levels)}) JOIN (SELECT grp, h AS top FROM tops) USING (grp) WHERE h < top),
root_steps AS MATERIALIZED (
  SELECT h, i, before, after FROM ({_siblings('root', 'one', levels)}) JOIN (SELECT one, h AS top FROM root) USING (one) WHERE h < top),
fold0 AS (SELECT grp, i, changed AS f, '' AS path FROM placed)""",
    ]
    for h in range(levels):
        steps.append(f"""
fold{h + 1} AS MATERIALIZED (
  SELECT g.grp, g.i, CASE WHEN s.h IS NULL THEN f ELSE sha256(before || f || after) END AS f, path || coalesce(before || after, '') AS path
  FROM fold{h} g LEFT JOIN steps s ON s.grp = g.grp AND s.h = {h} AND s.i = g.i // {16**h})""")
    for h in range(levels):
        steps.append(f"""
fold{levels + h + 1} AS MATERIALIZED (
  SELECT g.grp, g.i, CASE WHEN s.h IS NULL THEN f ELSE sha256(before || f || after) END AS f, path || coalesce(before || after, '') AS path
  FROM fold{levels + h} g LEFT JOIN root_steps s ON s.h = {h} AND s.i = g.grp // {16**h})""")
    return f"""
WITH {",".join(steps)}
SELECT doc_id, leaf, tops.d AS subroot, root.d AS root, sha256(path) AS proof_sha256, f AS folded_root, f = root.d AS verified
FROM placed JOIN fold{2 * levels} USING (grp, i) JOIN tops USING (grp), root
"""
