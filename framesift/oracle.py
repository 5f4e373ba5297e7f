"""The same results in SQL, written against the star-schema tables.

These statements restate each question for any SQL engine and follow another way
than the Spark jobs: whole-log windows and joins instead of chunks.
"""

from __future__ import annotations

AGG_LINES = r"""
agg_lines AS (
  SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_num,
    CASE event_type
      WHEN 'purchase' THEN 'swapBuffers: ' || CAST(floor(value) AS BIGINT) || ' us'
      WHEN 'error' THEN (event_id % 500) || ' frame cost ' || (CAST(floor(value) AS BIGINT) % 20) || 'ms'
      ELSE CASE event_type WHEN 'view' THEN 'glDrawElements' WHEN 'click' THEN 'glBindBuffer' ELSE 'glCompileShader' END
        || ': count=' || (event_id % 50 + 1) || ', time=' || CAST(floor(value * 100) AS BIGINT) || ' us'
    END AS content
  FROM events)"""

TRACE_LINES = r"""
trace_lines AS (
  SELECT l_orderkey % 100 AS log_id,
    row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, last, l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_quantity, content) AS line_num, content
  FROM (
    SELECT l_orderkey, 0 AS last, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
      'gl' || l_returnflag || l_linestatus || ': count=' || CAST(floor(l_quantity) AS BIGINT)
        || ', time=' || CAST(floor(l_extendedprice) AS BIGINT) || ' us' AS content
    FROM lineitem
    UNION ALL
    SELECT DISTINCT l_orderkey, 1, NULL::INT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE,
      'swapBuffers: ' || (l_orderkey % 1000) || ' us'
    FROM lineitem))"""

RAW_LINES = r"""
raw_lines AS (
  SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_num,
    CASE
      WHEN event_type = 'signup' THEN 'glGenBuffers ' || (event_id % 7 + 1)
      WHEN event_type = 'click' THEN 'glBindBuffer ' || CASE event_id % 3 WHEN 0 THEN 'GL_ARRAY_BUFFER'
        WHEN 1 THEN '0x8892' ELSE 'GL_UNIFORM_BUFFER' END || ' ' || (event_id % 7 + 1)
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'glUseProgram ' || (event_id % 7 + 1)
      WHEN event_type = 'view' AND event_id % 3 = 0
        THEN 'glBufferSubData GL_ARRAY_BUFFER 0 ' || CAST(floor(value) AS BIGINT) || ' 0x7f'
      WHEN event_type = 'view' THEN 'glBufferData ' || CASE WHEN event_id % 5 = 0 THEN '0x8892'
        WHEN event_id % 5 < 3 THEN 'GL_ARRAY_BUFFER' ELSE 'GL_UNIFORM_BUFFER' END || ' ' || CAST(floor(value) AS BIGINT)
        || ' 0x7f ' || CASE WHEN event_id % 4 = 1 THEN 'GL_STATIC_DRAW' ELSE '0x88E8' END
      WHEN event_type = 'error' THEN 'glDeleteBuffers ' || (event_id % 7 + 1)
      ELSE 'glXSwapBuffers: dpy = 0x1, drawable = 2'
    END AS content
  FROM events)"""

TEXT_LINES = r"""
text_lines AS (
  SELECT doc_id AS log_id, CAST(pos AS BIGINT) AS line_num, parts[pos] AS content
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


NOISY_LINES = rf"""{AGG_LINES.replace("agg_lines AS (", "plain AS (").replace("AS content", "AS content, event_id AS e")},
noisy_lines AS (
  SELECT log_id, line_num, e % 17 AS odd, CASE e % 17
    WHEN 0 THEN '[ ' || (e % 90) || '] ' || content WHEN 1 THEN 'x libGL: FPS =  ' || (e % 90) || '.5 (mean)'
    WHEN 2 THEN 'libGL: FPS = 8.9.1' WHEN 3 THEN 'warning: glLate: count=1, time=' || e || ' us'
    WHEN 4 THEN '12 [7:8:9 worker] libGL: FPS = 77' WHEN 5 THEN '<<gc = 0x1aF>>' WHEN 6 THEN '[ 4] vendor: count=2, time=9 us'
    WHEN 7 THEN '' WHEN 8 THEN 'glWide:   count=3,  time=' || e || '  us'
    WHEN 9 THEN 'glMany: count=99999999999999999999, time=1 us'
    WHEN 10 THEN '[7:8:9 worker] ERROR glLost: count=1, time=1 us' ELSE content END AS content
  FROM plain),
noisy AS (
  SELECT log_id, line_num, regexp_replace(regexp_replace(content, '^\[ \d+\] ', ''), '  us$', ' us') AS content
  FROM noisy_lines WHERE odd IN (0, 8) OR odd > 10)"""


def _rows(lines: str, every: str = "") -> str:
    """Typed rows with the frame they belong to; ``k`` is A for a call, S a swap, C a cost."""
    return rf"""
ev AS (
  SELECT log_id, line_num, regexp_extract(content, '^(\w+):', 1) AS name,
    CASE WHEN content LIKE 'swapBuffers:%' THEN 'S' WHEN content LIKE '%frame cost%' THEN 'C' ELSE 'A' END AS k,
    CASE WHEN content LIKE '%count=%' THEN CAST(regexp_extract(content, 'count=(\d+)', 1) AS BIGINT) END AS cnt,
    CASE WHEN content LIKE '%frame cost%' THEN 1000 * CAST(regexp_extract(content, '(\d+)ms$', 1) AS BIGINT)
      ELSE CAST(regexp_extract(content, '(\d+) us$', 1) AS BIGINT) END AS v
  FROM {lines}),
op AS (
  SELECT *, coalesce(last_value(CASE WHEN k <> 'C' THEN k END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_num
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'S') = 'A' AS opened FROM ev),
nm AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN k = 'S' AND opened THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_num
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_num FROM op),
calls AS (
  SELECT log_id, frame_num, line_num, name AS api_name, cnt AS call_count, v AS time_us, '' AS raw_params
  FROM nm WHERE k = 'A'),
pts AS (
  SELECT log_id, frame_num,
    min(line_num) FILTER (WHERE k = 'A') AS start_line,
    max(line_num) FILTER (WHERE k = 'S' AND opened) AS swap_line,
    max(v) FILTER (WHERE k = 'S' AND opened) AS swap_us,
    coalesce(max_by(v, line_num) FILTER (WHERE k = 'C' AND NOT opened), 0) AS gap_last,
    coalesce(max_by(v, line_num) FILTER (WHERE k = 'C' AND NOT opened AND v > 0), 0) AS gap_pos,
    max(line_num) FILTER (WHERE k = 'C' AND opened AND v > 0) AS pos_line,
    max_by(v, line_num) FILTER (WHERE k = 'C' AND opened AND v > 0) AS pos_us,
    min(line_num) FILTER (WHERE k = 'C' AND opened) AS first_cost
  FROM nm GROUP BY log_id, frame_num),
sums AS (
  SELECT p.log_id, p.frame_num, count(*) AS n, sum(v) AS all_us,
    coalesce(sum(v) FILTER (WHERE line_num > pos_line), 0) AS after_pos,
    coalesce(sum(v) FILTER (WHERE line_num > first_cost), 0) AS after_first
  FROM pts p JOIN nm ON nm.log_id = p.log_id AND nm.frame_num = p.frame_num AND k = 'A'
  GROUP BY p.log_id, p.frame_num),
ends AS (SELECT log_id, count(*) AS line_count FROM {every or lines} GROUP BY log_id),
tot AS (
  SELECT p.*, n, line_count, CAST(CASE
      WHEN pos_line IS NOT NULL THEN pos_us + after_pos
      WHEN gap_last = 0 THEN gap_pos + all_us
      WHEN first_cost IS NOT NULL THEN gap_pos + after_first
      ELSE gap_pos END AS BIGINT) AS total_time_us
  FROM pts p JOIN sums USING (log_id, frame_num) JOIN ends USING (log_id)),
frames AS (
  SELECT log_id, frame_num, start_line, coalesce(swap_line, line_count) AS end_line, total_time_us,
    coalesce(swap_us, 0) AS swap_time_us,
    CASE WHEN swap_line IS NULL THEN 0 ELSE greatest(0, total_time_us - swap_us) END AS api_total_time_us,
    n AS api_call_count
  FROM tot)"""


AGG = f"WITH {AGG_LINES}, {_rows('agg_lines')}"
TRACE = f"WITH {TRACE_LINES}, {_rows('trace_lines')}"
NOISY = f"WITH {NOISY_LINES}, {_rows('noisy', 'noisy_lines')}"
TEXT = f"WITH {TEXT_LINES}"

RAW_ROWS = r"""
rv AS (
  SELECT *, regexp_extract(content, '^\w+', 0) AS name,
    regexp_replace(regexp_replace(content, '^\w+', ''), '^ ', '') AS params,
    content LIKE 'glXSwapBuffers%' AS boundary FROM raw_lines),
rn AS (
  SELECT *, CAST(coalesce(sum(boundary::INT) OVER (PARTITION BY log_id ORDER BY line_num
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_num FROM rv),
rcalls AS (
  SELECT log_id, frame_num, line_num, name AS api_name, CAST(1 AS BIGINT) AS call_count, CAST(0 AS BIGINT) AS time_us,
    params AS raw_params FROM rn WHERE NOT boundary),
rframes AS (
  SELECT log_id, frame_num, min(line_num) FILTER (WHERE NOT boundary) AS start_line,
    coalesce(max(line_num) FILTER (WHERE boundary) - 1, max(line_count)) AS end_line,
    CAST(0 AS BIGINT) AS total_time_us, CAST(0 AS BIGINT) AS swap_time_us, CAST(0 AS BIGINT) AS api_total_time_us,
    count(*) FILTER (WHERE NOT boundary) AS api_call_count
  FROM rn JOIN (SELECT log_id, count(*) AS line_count FROM raw_lines GROUP BY log_id) USING (log_id)
  GROUP BY log_id, frame_num HAVING count(*) FILTER (WHERE NOT boundary) > 0)"""
RAW = f"WITH {RAW_LINES}, {RAW_ROWS}"

# Calls, ids and programs of the odd raw logs are told by the rule that makes their lines.
ODD = rf"""WITH {RAW_LINES.replace("raw_lines AS (", "plain AS (").replace("END AS content", "END AS content, event_id AS e")},
odd_lines AS (
  SELECT log_id, line_num, e % 19 AS odd, e % 7 + 1 AS k, content AS base, CASE e % 19
    WHEN 0 THEN '[ 7] ' || content WHEN 1 THEN '  glFlush' WHEN 2 THEN '[__dri3 x] glFlush'
    WHEN 3 THEN '(tid=1 gc=0x1) glFlush' WHEN 4 THEN 'no call' WHEN 5 THEN 'glUseProgram: program = ' || (e % 7 + 1)
    WHEN 6 THEN 'glGenBuffers: 30, 0x1F -2  ' || (e % 7 + 1) WHEN 7 THEN 'glUniform4f   ' || (e % 7 + 1) || '   0x1F' || chr(9) || '  2'
    WHEN 8 THEN 'eglSwapBuffers' WHEN 9 THEN 'glUseProgram -4' WHEN 10 THEN 'glUseProgram none' ELSE content END AS content
  FROM plain),
rv AS (
  SELECT log_id, line_num, odd, k, CASE odd WHEN 5 THEN 'glUseProgram' WHEN 6 THEN 'glGenBuffers' WHEN 7 THEN 'glUniform4f'
      WHEN 8 THEN 'eglSwapBuffers' WHEN 9 THEN 'glUseProgram' WHEN 10 THEN 'glUseProgram' ELSE regexp_extract(base, '^\w+', 0) END AS name,
    CASE odd WHEN 5 THEN 'program = ' || k WHEN 6 THEN '30, 0x1F -2  ' || k WHEN 7 THEN k || ' 0x1F 2' WHEN 8 THEN ''
      WHEN 9 THEN '-4' WHEN 10 THEN 'none' ELSE regexp_replace(regexp_replace(base, '^\w+', ''), '^ ', '') END AS params,
    odd = 8 OR (odd = 0 OR odd > 10) AND base LIKE 'glXSwapBuffers%' AS boundary
  FROM odd_lines WHERE odd NOT BETWEEN 1 AND 4),
{RAW_ROWS[RAW_ROWS.index("rn AS ("):].replace("FROM raw_lines", "FROM odd_lines")}"""

BUFFER_ROWS = r"""
last_calls AS (SELECT log_id, frame_num, max(line_num) AS last_line FROM rcalls GROUP BY log_id, frame_num),
bev AS (
  SELECT log_id, line_num AS a, 0 AS b, line_num AS c, api_name AS op, string_split(raw_params, ' ') AS t FROM rcalls
  WHERE api_name IN ('glGenBuffers', 'glBindBuffer', 'glBufferData', 'glBufferSubData', 'glDeleteBuffers')
  UNION ALL
  SELECT log_id, last_line, 1, line_num, 'made', string_split(raw_params, ' ')
  FROM rcalls JOIN last_calls USING (log_id, frame_num) WHERE api_name = 'glGenBuffers'),
be AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY a, b, c) AS pos FROM bev),
ex AS (
  SELECT log_id, pos, CAST(t[1] AS BIGINT) AS buffer_id, op <> 'glDeleteBuffers' AS born FROM be
  WHERE op IN ('glGenBuffers', 'made', 'glDeleteBuffers')),
exl AS (SELECT *, lag(born) OVER (PARTITION BY log_id, buffer_id ORDER BY pos) AS before FROM ex),
inc AS (
  SELECT s.log_id, s.buffer_id, s.pos AS s, coalesce(min(x.pos), 9223372036854775807) AS e, count(x.pos) = 0 AS is_live,
    row_number() OVER (PARTITION BY s.log_id, s.buffer_id ORDER BY s.pos) AS incarnation
  FROM exl s LEFT JOIN exl x ON x.log_id = s.log_id AND x.buffer_id = s.buffer_id AND NOT x.born AND x.pos > s.pos
  WHERE s.born AND NOT coalesce(s.before, false) GROUP BY s.log_id, s.buffer_id, s.pos),
bnd AS (
  SELECT inc.log_id, inc.buffer_id, inc.incarnation, be.pos,
    CASE be.t[1] WHEN '0x8892' THEN 'GL_ARRAY_BUFFER' ELSE be.t[1] END AS target
  FROM inc JOIN be ON be.log_id = inc.log_id AND op = 'glBindBuffer' AND CAST(t[2] AS BIGINT) = buffer_id
    AND pos > s AND pos < e),
upd AS (
  SELECT log_id, pos, op = 'glBufferData' AS is_data, t[1] AS token,
    CAST(CASE WHEN op = 'glBufferData' THEN t[2] ELSE t[3] END AS BIGINT) AS size,
    CASE WHEN op = 'glBufferData' THEN CASE t[len(t)] WHEN '0x88E8' THEN 'GL_DYNAMIC_DRAW' ELSE t[len(t)] END END AS usage
  FROM be WHERE op IN ('glBufferData', 'glBufferSubData')),
hit AS (
  SELECT i.log_id, i.buffer_id, i.incarnation, u.pos, u.is_data, u.token, u.size, u.usage,
    coalesce(max_by(b.target, b.pos), 'GL_ARRAY_BUFFER') AS target
  FROM inc i JOIN upd u ON u.log_id = i.log_id AND u.pos > i.s AND u.pos < i.e
    LEFT JOIN bnd b ON b.log_id = i.log_id AND b.buffer_id = i.buffer_id AND b.incarnation = i.incarnation AND b.pos < u.pos
  GROUP BY ALL),
app AS (SELECT * FROM hit WHERE token LIKE '0x%' OR token = target),
lives AS (
  SELECT i.log_id, i.buffer_id, i.incarnation, i.is_live,
    coalesce((SELECT max_by(target, pos) FROM bnd b WHERE b.log_id = i.log_id AND b.buffer_id = i.buffer_id
      AND b.incarnation = i.incarnation), 'GL_ARRAY_BUFFER') AS target,
    coalesce(max_by(a.size, a.pos) FILTER (WHERE a.is_data AND a.size > 0),
      min_by(a.size, a.pos) FILTER (WHERE NOT a.is_data AND a.size > 0), 0) AS size,
    coalesce(max_by(a.usage, a.pos) FILTER (WHERE a.is_data), '') AS usage
  FROM inc i LEFT JOIN app a USING (log_id, buffer_id, incarnation) GROUP BY ALL)"""
BUFFERS = f"{RAW}, {BUFFER_ROWS}"

MIXED = f"""WITH {AGG_LINES}, {RAW_LINES},
mixed AS (SELECT 'a' || log_id AS log_id, line_num, content FROM agg_lines
  UNION ALL SELECT 'r' || log_id, line_num, content FROM raw_lines)"""

# Sources of the shader logs: text lines that are not noise. The documents hold no fences or headers.
SHADER = r"""
WITH docs AS (
  SELECT doc_id, doc_id // 10 AS log_id, n_chars, string_split(text, chr(10)) AS parts FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(len(parts) + 5) OVER (PARTITION BY log_id ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base,
    row_number() OVER (PARTITION BY log_id ORDER BY doc_id) - 1 AS frame_num FROM docs),
body AS (
  SELECT doc_id, pos, parts[pos] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM docs)),
kept AS (
  SELECT * FROM body WHERE line <> '' AND NOT regexp_matches(line,
    '(?s)^((\d+\s+)?\[\d+:\d+:\d+.*\]|warning:|\[\d+:\d+:\d+.*ERROR|<<gc = 0x[a-fA-F0-9]+>>\z|(\[\s*\d+\]\s+)?vendor:)')
    AND NOT regexp_matches(line, 'libGL:\s+FPS\s*=\s*[\d.]+')),
srcs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS source FROM kept GROUP BY doc_id),
shaders AS (
  SELECT log_id, frame_num, base + 3 AS block_num, doc_id AS shader_id,
    '[ 1] (gc=0x1, tid=0x2): glShaderSource ' || doc_id || ' 1 0xff (nil)' AS command_line, source
  FROM placed JOIN srcs USING (doc_id))"""

_WORDS = "contains(lower(content), 'the') AND contains(lower(content), 'ing on')"
_RANKED = f"""{TEXT}, m AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_num) AS r,
  count(*) OVER (PARTITION BY log_id) AS total FROM text_lines WHERE {_WORDS})"""

_FUNC = """SELECT log_id, api_name, count(*) AS call_count, CAST(sum(time_us) AS BIGINT) AS total_time_us,
  CAST(sum(time_us) AS BIGINT) // count(*) AS avg_time_us FROM {calls} {where} GROUP BY log_id, api_name"""
_SUMMARY = """SELECT log_id, frame_num, api_name, CAST(sum(call_count) AS BIGINT) AS call_count,
  CAST(sum(time_us) AS BIGINT) AS time_us FROM calls GROUP BY log_id, frame_num, api_name"""
_FRAME_SUMMARY = """SELECT log_id, count(*) AS total_frames, max(total_time_us) AS max_time_us,
  min(total_time_us) AS min_time_us, CAST(sum(total_time_us) AS BIGINT) AS {total},
  CAST(sum(total_time_us) AS BIGINT) // count(*) AS avg_time_us FROM frames GROUP BY log_id"""
_TOP = """SELECT * REPLACE (CAST(place AS INTEGER) AS place) FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY total_time_us DESC, frame_num) AS place
  FROM frames) WHERE place <= {n}"""
_SLOWEST = """SELECT log_id, frame_num, api_name, time_us, line_num, api_call_count FROM (
  SELECT *, row_number() OVER (PARTITION BY log_id, frame_num ORDER BY time_us DESC, line_num) AS r,
    count(*) OVER (PARTITION BY log_id, frame_num) AS api_call_count FROM calls) WHERE r = 1"""
_RANGE_CALLS = """SELECT c.* FROM calls c JOIN frames f USING (log_id, frame_num)
  WHERE f.total_time_us BETWEEN {a} AND {b}"""
_LIST = "log_id, frame_num, start_line, end_line, total_time_us, swap_time_us, api_total_time_us"
_SHADER_CALLS = """SELECT log_id, type, count(*) AS compile_count, CAST(sum(time_us) AS BIGINT) AS total_compile_time_us
  FROM (SELECT log_id, time_us, CASE WHEN contains(api_name, 'glCreateShader') THEN 'Create'
    WHEN contains(api_name, 'glCompileShader') THEN 'Compile'
    WHEN contains(api_name, 'glShaderSource') THEN 'Source' END AS type FROM calls)
  WHERE type IS NOT NULL GROUP BY log_id, type"""
_LOGS = """SELECT log_id, {kind} AS kind, count(frame_num) AS frame_count,
    CAST(coalesce(sum(total_time_us), 0) AS BIGINT) AS total_time_us,
    CASE WHEN coalesce(sum(total_time_us), 0) > 0
      THEN count(frame_num) * CAST(1e6 AS DOUBLE) / CAST(sum(total_time_us) AS BIGINT) ELSE CAST(0 AS DOUBLE) END AS fps,
    line_count, CAST(0 AS BIGINT) AS rejects
  FROM {ends} LEFT JOIN {frames} USING (log_id) GROUP BY log_id, line_count"""
_RENDERED = """SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_num) AS line_num,
  api_name || ': count=' || call_count || ', time=' || time_us AS content FROM calls"""
_KIND = r"""CASE WHEN s LIKE '<<%' THEN 'profile'
  WHEN contains(s, 'count=') AND contains(s, 'time=') THEN 'apitrace'
  WHEN regexp_matches(s, '^(glX|eglSwapBuffers|gl(Gen|Create|Bind|Buffer|Draw|Clear|UseProgram|Shader|Compile|Link|Vertex|Pixel|Tex|Enable|Disable|Flush|Finish|Map|Unmap|Delete|Get|Is|Read))') THEN 'rawtrace'
  ELSE 'unknown' END"""


def _kinds(lines: str, head: int) -> str:
    return rf"""
, hd AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM {lines} WHERE line_num <= {head}),
sp AS (SELECT *, CASE WHEN regexp_matches(t, '(?s)^\[[^\]]*\].') THEN regexp_replace(t, '(?s)^\[[^\]]*\]\s*', '') ELSE t END AS s
  FROM hd),
kd AS (SELECT log_id, line_num, {_KIND} AS kind,
    (contains(t, 'count=') AND contains(t, 'time=')) OR (contains(t, 'swapBuffers:') AND contains(t, 'us'))
      OR contains(t, 'frame cost') AS agg,
    t = '' OR regexp_matches(t, '(?s)^\[\d+:\d+:\d+.*ERROR')
      OR (regexp_matches(t, '(?s)^\[\d+:\d+:\d+.*\]') AND NOT contains(t, 'gl') AND NOT contains(t, 'swapBuffers'))
      OR regexp_matches(t, '^<<gc = 0x[a-fA-F0-9]+>>$') OR regexp_matches(t, '^(\[\s*\d+\]\s+)?vendor:') AS skip
  FROM sp),
seen AS (SELECT *, bool_or(agg) OVER (PARTITION BY log_id ORDER BY line_num) AS agg_yet FROM kd)
SELECT log_id, coalesce(
    min_by(CASE WHEN agg_yet THEN 'apitrace' ELSE kind END, line_num) FILTER (WHERE NOT skip AND (kind <> 'unknown' OR agg_yet)),
    CASE WHEN bool_or(agg) THEN 'apitrace' ELSE 'unknown' END) AS kind
FROM seen GROUP BY log_id"""


_CLASS = "CASE WHEN content LIKE 'swapBuffers%' THEN 'swap' WHEN content LIKE '%frame cost%' THEN 'cost' ELSE 'call' END"

_SIDE = "CASE WHEN b.{key} IS NULL THEN 'after' WHEN a.{key} IS NULL THEN 'before' ELSE 'both' END AS side"


def _changes(*measures: str) -> str:
    return ", ".join(
        f"b.{m} AS {m}_before, a.{m} AS {m}_after, coalesce(a.{m}, 0) - coalesce(b.{m}, 0) AS {m}_change, "
        f"CASE WHEN b.{m} > 0 THEN a.{m} / b.{m} END AS {m}_growth"
        for m in measures
    )


def _run(name: str, calls: str, odd: str, where: str) -> str:
    return f"""{name} AS (SELECT api_name, count(*) AS call_count, CAST(sum(time_us) AS BIGINT) AS total_time_us,
      CAST(sum(time_us) AS BIGINT) // count(*) AS avg_time_us FROM {calls} WHERE log_id % 2 = {odd} AND {where} GROUP BY api_name)"""


_COMPARED_FRAMES = f"""
fb AS (SELECT *, log_id // 2 AS pair FROM frames WHERE log_id % 2 = 0),
fa AS (SELECT *, log_id // 2 AS pair FROM frames WHERE log_id % 2 = 1),
compared AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.frame_num, a.frame_num) AS frame_num, {_SIDE.format(key="pair")},
    {_changes("total_time_us", "swap_time_us", "api_call_count")}
  FROM fb b FULL JOIN fa a ON a.pair = b.pair AND a.frame_num = b.frame_num)"""

ORACLE: dict[str, str] = {
    "frames": f"{AGG} SELECT * FROM frames",
    "api_calls": f"{AGG} SELECT * FROM calls",
    "log_summary": AGG + " " + _LOGS.format(kind="'apitrace'", ends="ends", frames="frames"),
    "parse_summary": f"""{AGG}, logs AS ({_LOGS.format(kind="'apitrace'", ends="ends", frames="frames")}),
      per AS (SELECT log_id, max(total_time_us) AS m, min_by(total_time_us, frame_num) AS first_frame_us,
        max_by(total_time_us, frame_num) AS last_frame_us FROM frames GROUP BY log_id)
      SELECT log_id, kind, CASE WHEN fps > 0 THEN 'profile' ELSE 'rawtrace' END AS format_label, frame_count, fps,
        total_time_us, coalesce(m / CAST(1000 AS DOUBLE), CAST(0 AS DOUBLE)) AS max_frame_time, first_frame_us, last_frame_us
      FROM logs LEFT JOIN per USING (log_id)""",
    "top_frames": f"{AGG} {_TOP.format(n=3)}",
    "top_frames_of_all": f"{AGG} SELECT * FROM frames ORDER BY total_time_us DESC, log_id, frame_num LIMIT 20",
    "top_with_summary": f"""{AGG}, t AS ({_TOP.format(n=5)}), s AS ({_FRAME_SUMMARY.format(total="all_time_us")})
      SELECT {_LIST}, place, total_frames, max_time_us, min_time_us, all_time_us, avg_time_us FROM t JOIN s USING (log_id)""",
    "longest_frame": f"{AGG} SELECT * EXCLUDE (place) FROM ({_TOP.format(n=1)})",
    "frame_summary": f"{AGG} {_FRAME_SUMMARY.format(total='total_time_us')}",
    "frame_list": f"{AGG} SELECT {_LIST} FROM frames",
    "frame_ms": f"""{AGG} SELECT log_id, frame_num, round(total_time_us / 1000, 3) AS total_time_ms,
      round(swap_time_us / 1000, 3) AS swap_time_ms, round(api_total_time_us / 1000, 3) AS api_total_time_ms FROM frames""",
    "frame_page": f"""{AGG} SELECT {_LIST} FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY frame_num) AS r
      FROM frames) WHERE r BETWEEN 6 AND 10""",
    "frame_page_info": f"""{AGG} SELECT log_id, count(frame_num) AS total, CASE WHEN 10 >= count(frame_num) THEN 1 ELSE 3 END AS page,
      5 AS page_size FROM ends LEFT JOIN frames USING (log_id) GROUP BY log_id""",
    "frame_range": f"{AGG} SELECT * FROM frames WHERE frame_num BETWEEN 3 AND 6",
    "frame_by_number": f"{AGG} SELECT * FROM frames WHERE frame_num = 2",
    "frame_detail_text": f"""{AGG}, f AS (SELECT * FROM frames WHERE frame_num = 2),
      c AS (SELECT calls.*, calls.line_num = f.start_line AS is_first FROM calls JOIN f USING (log_id, frame_num)),
      s AS (SELECT *, api_name = min(api_name) OVER (PARTITION BY log_id) AS is_first FROM ({_SUMMARY}) WHERE frame_num = 2)
      SELECT log_id, 0 AS part, 0 AS k1, '' AS k2, '{{"FrameNum":' || frame_num || ',"StartLine":' || start_line
        || ',"EndLine":' || end_line || ',"TotalTimeUs":' || total_time_us || ',"SwapBufferTimeUs":' || swap_time_us
        || ',"APITotalTimeUs":' || api_total_time_us || ',"APICalls":[' AS value FROM f
      UNION ALL SELECT log_id, 1, line_num, '', CASE WHEN is_first THEN '' ELSE ',' END || '{{"APIName":"' || api_name
        || '","Count":' || call_count || ',"TimeUs":' || time_us || ',"LineNum":' || line_num || ',"RawParams":""}}' FROM c
      UNION ALL SELECT log_id, 2, 0, '', '],"APISummary":{{' FROM f
      UNION ALL SELECT log_id, 3, 0, api_name, CASE WHEN is_first THEN '' ELSE ',' END || '"' || api_name || '":{{"APIName":"'
        || api_name || '","Count":' || call_count || ',"TimeUs":' || time_us || '}}' FROM s
      UNION ALL SELECT log_id, 4, 0, '', '}},"Shaders":[' FROM f
      UNION ALL SELECT log_id, 6, 0, '', '],"Programs":null' FROM f
      UNION ALL SELECT log_id, 8, 0, '', ',"BufferCreations":null' FROM f
      UNION ALL SELECT log_id, 10, 0, '', '}}' FROM f""",
    "frame_offsets_in_bytes": f"""{AGG}, o AS (SELECT log_id, line_num, CAST(coalesce(sum(strlen(content) + 1) OVER (
        PARTITION BY log_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
        FROM agg_lines)
      SELECT f.log_id, frame_num, start_line, byte_offset FROM frames f JOIN o
      ON o.log_id = f.log_id AND o.line_num = start_line""",
    "log_line_and_byte_counts": f"""WITH {AGG_LINES} SELECT log_id, count(*) AS line_count,
      CAST(sum(strlen(content) + 1) AS BIGINT) AS text_bytes FROM agg_lines GROUP BY log_id""",
    "frame_boundary_lines": f"""WITH {AGG_LINES} SELECT log_id, line_num FROM agg_lines
      WHERE content LIKE 'swapBuffers%' OR content LIKE '%frame cost%'""",
    "line_classes": f"""{AGG} SELECT log_id, CASE k WHEN 'A' THEN 'call' WHEN 'S' THEN 'swap' ELSE 'cost' END AS line_class,
      count(*) AS n, CAST(sum(v) AS BIGINT) AS value FROM ev GROUP BY log_id, k""",
    "noisy_frames": f"{NOISY} SELECT * FROM frames",
    "noisy_calls": f"{NOISY} SELECT * FROM calls",
    "noisy_log_summary": f"""{NOISY}, facts AS (SELECT log_id, count(*) FILTER (odd = 9) AS n_rejects, max_by(
        CAST(nullif(regexp_extract(content, 'FPS =  (\\d+\\.5)', 1), '') AS DOUBLE), line_num) FILTER (odd = 1) AS rate FROM noisy_lines GROUP BY log_id),
      logs AS ({_LOGS.format(kind="'apitrace'", ends="ends", frames="frames")})
      SELECT logs.* REPLACE (CASE WHEN rate > 0 THEN rate ELSE fps END AS fps, n_rejects AS rejects) FROM logs JOIN facts USING (log_id)""",
    "noisy_line_classes": """WITH """ + NOISY_LINES + """, named AS (SELECT log_id, CASE WHEN odd IN (1, 2) THEN 'fps'
        WHEN odd BETWEEN 3 AND 7 OR odd = 10 THEN 'noise' WHEN odd = 8 THEN 'call' WHEN odd = 9 THEN 'reject'
        WHEN contains(content, 'swapBuffers') THEN 'swap' WHEN contains(content, 'frame cost') THEN 'cost' ELSE 'call' END AS line_class,
        CASE WHEN odd = 1 THEN CAST(regexp_extract(content, '(\\d+\\.5)', 1) AS DOUBLE) END AS fps FROM noisy_lines)
      SELECT log_id, line_class, count(*) AS n, max(fps) AS fps FROM named GROUP BY log_id, line_class""",
    "logged_rates": f"""WITH {NOISY_LINES} SELECT log_id, line_num,
      CASE WHEN odd = 1 THEN CAST(regexp_extract(content, '(\\d+\\.5)', 1) AS DOUBLE) END AS fps FROM noisy_lines WHERE odd IN (1, 2)""",
    "odd_raw_frames": f"{ODD} SELECT * FROM rframes",
    "odd_raw_calls": f"{ODD} SELECT * FROM rcalls",
    "odd_programs": f"""{ODD} SELECT log_id, frame_num, line_num, k AS program_id FROM rn
      WHERE name = 'glUseProgram' AND odd NOT IN (9, 10)""",
    "odd_buffer_creations": f"""{ODD}, made AS (SELECT log_id, frame_num, line_num, unnest(ids) AS id FROM (SELECT *, CASE odd WHEN 6
        THEN [{{'pos': 0, 'id': 30}}, {{'pos': 1, 'id': -2}}, {{'pos': 2, 'id': k}}] ELSE [{{'pos': 0, 'id': k}}] END AS ids
        FROM rn WHERE name = 'glGenBuffers'))
      SELECT log_id, frame_num, line_num, id.pos AS pos, CAST(id.id AS BIGINT) AS buffer_id, 'GL_ARRAY_BUFFER' AS target,
        CAST(0 AS BIGINT) AS size, '' AS usage FROM made""",
    "odd_noise_lines": f"{ODD} SELECT log_id, line_num, content FROM odd_lines WHERE odd IN (1, 2, 3)",
    "func_stats": f"{AGG} {_FUNC.format(calls='calls', where='')}",
    "func_stats_prefix": AGG + " " + _FUNC.format(calls="calls", where="WHERE api_name LIKE 'glDraw%'"),
    "frame_func_stats": f"""{AGG} SELECT log_id, frame_num, api_name, call_count, time_us AS total_time_us,
      CASE WHEN call_count <> 0 THEN time_us // call_count END AS avg_time_us FROM ({_SUMMARY}) WHERE frame_num = 1""",
    "frame_api_summary": f"{AGG} {_SUMMARY}",
    "slowest_call_per_frame": f"{AGG} {_SLOWEST}",
    "call_postings": f"{AGG} SELECT api_name, log_id, line_num FROM calls",
    "call_postings_lookup": f"{AGG} SELECT api_name, log_id, line_num FROM calls WHERE api_name = 'glBindBuffer'",
    "duration_range_calls": f"{AGG} {_RANGE_CALLS.format(a=1500, b=20000)}",
    "rendered_calls": f"{AGG} {_RENDERED}",
    "rendered_call_search": f"""{AGG} SELECT log_id, line_num, content,
      (row_number() OVER (PARTITION BY log_id ORDER BY line_num) - 1) // 1000 AS page_num FROM ({_RENDERED})
      WHERE contains(lower(content), 'bind') AND contains(lower(content), 'count=3')""",
    "trace_frames": f"{TRACE} SELECT * FROM frames",
    "trace_top_frames": f"{TRACE} {_TOP.format(n=20)}",
    "trace_func_stats": f"{TRACE} {_FUNC.format(calls='calls', where='')}",
    "trace_frame_api_summary": f"{TRACE} {_SUMMARY}",
    "trace_slowest_call_per_frame": f"{TRACE} {_SLOWEST}",
    "trace_duration_range_calls": f"{TRACE} {_RANGE_CALLS.format(a=50000, b=90000)}",
    "trace_keyword_search": f"""WITH {TRACE_LINES} SELECT * FROM trace_lines
      WHERE contains(lower(content), 'glaf') AND contains(lower(content), 'count=7')""",
    "text_lines": f"{TEXT} SELECT * FROM text_lines",
    "keyword_search": f"{_RANKED} SELECT log_id, line_num, content, (r - 1) // 3 AS page_num FROM m",
    "keyword_page": f"{_RANKED} SELECT log_id, line_num, content FROM m WHERE r BETWEEN 3 AND 4",
    "keyword_page_from_zero": f"{_RANKED} SELECT log_id, line_num, content FROM m WHERE r BETWEEN 4 AND 6",
    "keyword_page_info": f"""{_RANKED} SELECT log_id, count(m.log_id) AS total, CASE WHEN 2 >= count(m.log_id) THEN 1 ELSE 2 END AS page,
      2 AS page_size FROM (SELECT DISTINCT log_id FROM text_lines) t LEFT JOIN m USING (log_id) GROUP BY log_id""",
    "keyword_preview": f"{_RANKED} SELECT log_id, line_num, content, greatest(total - 2, 0) AS left_out FROM m WHERE r <= 2",
    "raw_file_search": f"""{TEXT} SELECT log_id, line_num FROM text_lines
      WHERE contains(lower(content), 'the') AND contains(lower(content), 'and')""",
    "regex_search": f"""{TEXT} SELECT log_id, line_num - 1 AS position, content FROM text_lines
      WHERE regexp_matches(content, '^[A-Z][a-z]+ing ')""",
    "detect_kind": MIXED + _kinds("mixed", 50),
    "detect_kind_of_texts": TEXT + _kinds("text_lines", 100),
    "kind_of_lines": f"""{MIXED} SELECT log_id, kind, count(*) AS n FROM (
      SELECT log_id, {_KIND} AS kind FROM (SELECT log_id, content AS s FROM mixed)) GROUP BY log_id, kind""",
    "auto_frames": f"""{AGG}, {RAW_LINES}, {RAW_ROWS}
      SELECT * REPLACE ('a' || log_id AS log_id) FROM frames UNION ALL SELECT * REPLACE ('r' || log_id AS log_id) FROM rframes""",
    "auto_log_summary": f"""{AGG}, {RAW_LINES}, {RAW_ROWS},
      rends AS (SELECT log_id, count(*) AS line_count FROM raw_lines GROUP BY log_id)
      SELECT * REPLACE ('a' || log_id AS log_id) FROM ({_LOGS.format(kind="'apitrace'", ends="ends", frames="frames")})
      UNION ALL
      SELECT * REPLACE ('r' || log_id AS log_id) FROM ({_LOGS.format(kind="'rawtrace'", ends="rends", frames="rframes")})""",
    "shader_call_stats": f"{AGG} {_SHADER_CALLS}",
    "shader_summary": f"""{AGG} SELECT log_id, count(*) AS shader_types, CAST(sum(compile_count) AS BIGINT) AS total_compile,
      CAST(sum(total_compile_time_us) AS BIGINT) AS total_time_us FROM ({_SHADER_CALLS}) GROUP BY log_id""",
    "shader_frames": f"""{SHADER} SELECT log_id, frame_num, base + 1 AS start_line, base + len(parts) + 5 AS end_line,
      n_chars AS total_time_us, doc_id AS swap_time_us, greatest(0, n_chars - doc_id) AS api_total_time_us,
      CAST(1 AS BIGINT) AS api_call_count FROM placed""",
    "shader_sources": f"{SHADER} SELECT * FROM shaders",
    "shader_body_lines": f"""{SHADER} SELECT log_id, frame_num, base + 3 AS block_num, base + 3 + pos AS line_num, line AS content
      FROM kept JOIN placed USING (doc_id)""",
    "shader_list_truncated": f"""{SHADER} SELECT * REPLACE (CASE WHEN length(source) > 2000
      THEN substr(source, 1, 2000) || chr(10) || '[Source truncated]' ELSE source END AS source) FROM shaders""",
    "shader_view": f"""{SHADER} SELECT * REPLACE (CASE WHEN length(source) > 50000
      THEN substr(source, 1, 50000) || '...[truncated]' ELSE source END AS source) FROM shaders""",
    "shader_previews": f"""{SHADER} SELECT log_id, frame_num, block_num, shader_id, command_line,
      CASE WHEN length(source) > 50 THEN substr(source, 1, 50) || '...' ELSE source END AS preview FROM shaders""",
    "raw_frames": f"{RAW} SELECT * FROM rframes",
    "raw_calls": f"{RAW} SELECT * FROM rcalls",
    "raw_func_stats": f"{RAW} {_FUNC.format(calls='rcalls', where='')}",
    "programs": f"""{RAW} SELECT log_id, frame_num, line_num, CAST(raw_params AS BIGINT) AS program_id FROM rcalls
      WHERE api_name = 'glUseProgram'""",
    "buffer_creations": f"""{RAW} SELECT log_id, frame_num, line_num, 0 AS pos, CAST(raw_params AS BIGINT) AS buffer_id,
      'GL_ARRAY_BUFFER' AS target, CAST(0 AS BIGINT) AS size, '' AS usage FROM rcalls WHERE api_name = 'glGenBuffers'""",
    "buffers_live": f"{BUFFERS} SELECT log_id, buffer_id, target, size, usage FROM lives WHERE is_live",
    "buffers_by_target": f"""{BUFFERS} SELECT log_id, 'GL_ARRAY_BUFFER' AS by_target, buffer_id, incarnation, target, size, usage
      FROM lives""",
    "buffer_total_size": f"""{BUFFERS} SELECT log_id, CAST(0 AS BIGINT) AS total_size,
      CAST(sum(CASE WHEN is_live THEN size ELSE 0 END) AS BIGINT) AS live_bytes FROM lives GROUP BY log_id""",
    "buffer_summary": f"""{BUFFERS} SELECT log_id, count(*) FILTER (WHERE is_live) AS total_count,
      CAST(0 AS BIGINT) AS total_size, 'GL_ARRAY_BUFFER' AS target, count(*) AS target_count,
      CAST(sum(size) AS BIGINT) AS target_size FROM lives GROUP BY log_id""",
    "export_frames_csv": f"""{AGG} SELECT frame_num AS "FrameNum", start_line AS "StartLine", end_line AS "EndLine",
      total_time_us AS "TotalTimeUs", api_call_count AS "APICallCount" FROM frames""",
    "export_funcs_json": f"""{AGG} SELECT api_name AS "FuncName", call_count AS "CallCount", total_time_us AS "TotalTimeUs",
      avg_time_us AS "AvgTimeUs" FROM ({_FUNC.format(calls='calls', where='')})""",
    "export_shaders_csv": f"""{SHADER} SELECT shader_id AS "ID", source AS "Source" FROM shaders""",
    "export_shaders_json": f"""{SHADER} SELECT shader_id AS "ID", nullif(command_line, '') AS "CommandLine",
      source AS "Source" FROM shaders""",
    "export_longest_csv": f"""{AGG}, t AS ({_TOP.format(n=1)}) SELECT coalesce(frame_num, 0) AS "FrameNum",
      coalesce(start_line, 0) AS "StartLine", coalesce(end_line, 0) AS "EndLine", coalesce(total_time_us, 0) AS "TotalTimeUs",
      coalesce(swap_time_us, 0) AS "SwapBufferTimeUs", coalesce(api_total_time_us, 0) AS "APITotalTimeUs",
      coalesce(api_call_count, 0) AS "APICallCount" FROM ends LEFT JOIN t USING (log_id)""",
    "export_search_text": f"""{AGG} SELECT '[' || line_num || '] ' || content AS value FROM ({_RENDERED})
      WHERE contains(lower(content), 'bind') AND contains(lower(content), 'count=3')""",
    "log_json_lines": f"""{AGG}, logs AS ({_LOGS.format(kind="'apitrace'", ends="ends", frames="frames")}),
      ff AS (SELECT log_id, min(frame_num) AS first_frame FROM frames GROUP BY log_id),
      s AS (SELECT *, api_name = min(api_name) OVER (PARTITION BY log_id, frame_num) AS is_first FROM ({_SUMMARY})),
      parts AS (SELECT unnest([2, 4, 6, 8, 10]) AS part, unnest(['],"APISummary":{{', '}},"Shaders":[', '],"Programs":null',
        ',"BufferCreations":null', '}}']) AS value)
      SELECT log_id, CAST(-1 AS BIGINT) AS frame_num, 0 AS part,
        CASE frame_count WHEN 0 THEN '{{"Frames":null' ELSE '{{"Frames":[' END AS value FROM logs
      UNION ALL SELECT log_id, 9223372036854775807, 0, CASE frame_count WHEN 0 THEN ',' ELSE '],' END || '"TotalTimeUs":'
        || total_time_us || ',"FPS":' || fps || '}}' FROM logs
      UNION ALL SELECT log_id, frame_num, 0, CASE WHEN frame_num > first_frame THEN ',' ELSE '' END || '{{"FrameNum":'
        || frame_num || ',"StartLine":' || start_line || ',"EndLine":' || end_line || ',"TotalTimeUs":' || total_time_us
        || ',"SwapBufferTimeUs":' || swap_time_us || ',"APITotalTimeUs":' || api_total_time_us || ',"APICalls":['
        FROM frames JOIN ff USING (log_id)
      UNION ALL SELECT c.log_id, c.frame_num, 1, CASE WHEN line_num = start_line THEN '' ELSE ',' END || '{{"APIName":"'
        || api_name || '","Count":' || call_count || ',"TimeUs":' || time_us || ',"LineNum":' || line_num
        || ',"RawParams":""}}' FROM calls c JOIN frames f ON f.log_id = c.log_id AND f.frame_num = c.frame_num
      UNION ALL SELECT log_id, frame_num, 3, CASE WHEN is_first THEN '' ELSE ',' END || '"' || api_name || '":{{"APIName":"'
        || api_name || '","Count":' || call_count || ',"TimeUs":' || time_us || '}}' FROM s
      UNION ALL SELECT log_id, frame_num, part, value FROM frames, parts""",
    "frame_text": f"""{AGG} SELECT log_id, frame_num, p.part, CAST(0 AS BIGINT) AS line_num, CASE p.part
        WHEN 0 THEN 'Frame #' || frame_num WHEN 1 THEN 'Lines: ' || start_line || ' - ' || end_line
        WHEN 2 THEN 'Total Time: ' || total_time_us || ' us (' || printf('%.2f', total_time_us / CAST(1000 AS DOUBLE)) || ' ms)'
        WHEN 3 THEN 'API Calls: ' || api_call_count
        WHEN 5 THEN printf('%-30s %10s %10s', 'API Name', 'Count', 'Time(us)')
        WHEN 6 THEN repeat('-', 50) ELSE '' END AS value
      FROM frames, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 8]) AS part) p
      UNION ALL SELECT log_id, frame_num, 7, line_num, printf('%-30s %10d %10d', api_name, call_count, time_us) FROM calls""",
    "func_stats_text": f"""{AGG}, f AS ({_FUNC.format(calls='calls', where='')})
      SELECT DISTINCT log_id, 0 AS part, printf('%-30s %10s %15s %15s', 'Function', 'CallCount', 'TotalTime(us)', 'AvgTime(us)')
        AS value FROM f
      UNION ALL SELECT DISTINCT log_id, 1, repeat('-', 50) FROM f
      UNION ALL SELECT log_id, 2, printf('%-30s %10d %15d %15d', api_name, call_count, total_time_us, avg_time_us) FROM f""",
    "shader_stats_text": f"""{AGG}, f AS ({_SHADER_CALLS})
      SELECT DISTINCT log_id, 0 AS part, printf('%-20s %15s %20s', 'Type', 'CompileCount', 'TotalCompileTime(us)') AS value FROM f
      UNION ALL SELECT DISTINCT log_id, 1, repeat('-', 50) FROM f
      UNION ALL SELECT log_id, 2, printf('%-20s %15d %20d', type, compile_count, total_compile_time_us) FROM f""",
    "shader_text": f"""{SHADER}, n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY block_num) = 1 AS is_first
        FROM shaders),
      p AS (SELECT log_id, block_num, CASE WHEN is_first THEN ['Shader ID: ' || shader_id, repeat('-', 50), source]
        ELSE ['', repeat('=', 50), '', 'Shader ID: ' || shader_id, repeat('-', 50), source] END AS parts FROM n)
      SELECT log_id, block_num, CAST(i - 1 AS INTEGER) AS part, parts[i] AS value
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)""",
    "text_source_calls": f"""WITH {TRACE_LINES} SELECT {_CLASS} AS line_class,
      CASE WHEN {_CLASS} = 'call' THEN regexp_extract(content, '^(\\w+)', 1) END AS api_name, count(*) AS n,
      CAST(sum(CAST(regexp_extract(content, '(\\d+) us$', 1) AS BIGINT)) AS BIGINT) AS value
      FROM trace_lines GROUP BY ALL""",
    "text_source_encodings": """SELECT CASE log_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding,
      count(*) AS n_logs, CAST(sum(log_id) AS BIGINT) AS sum_of_ids
      FROM (SELECT DISTINCT user_id AS log_id FROM events) GROUP BY log_id % 3""",
    "reopened_calls_of_logs": f"{AGG} SELECT * FROM calls WHERE log_id IN (3, 8)",
    "reopened_shaders": f"{SHADER} SELECT * FROM shaders",
    "reopened_mixed_search": f"""{MIXED} SELECT log_id, line_num, content,
      (row_number() OVER (PARTITION BY log_id ORDER BY line_num) - 1) // 5 AS page_num
      FROM mixed WHERE contains(lower(content), 'bind') AND contains(content, '1')""",
    "stored_postings_lookup": f"""{TRACE} SELECT api_name, log_id, line_num FROM calls
      WHERE api_name = 'glRF' AND line_num BETWEEN 20 AND 60""",
    "stored_postings_of_functions": f"""{TRACE} SELECT api_name, log_id, count(*) AS n_calls, min(line_num) AS first_line,
      max(line_num) AS last_line FROM calls GROUP BY api_name, log_id""",
    "captured_frames": f"{AGG} SELECT * FROM frames",
    "captured_logs_per_batch": """SELECT CAST(CASE WHEN log_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch, count(*) AS n_logs
      FROM (SELECT DISTINCT user_id AS log_id FROM events) GROUP BY log_id % 4 = 0""",
    "compared_functions": f"""{TRACE}, {_run("b", "calls", "0", "api_name <> 'glRF'")}, {_run("a", "calls", "1", "api_name <> 'glAF'")}
      SELECT coalesce(b.api_name, a.api_name) AS api_name, {_SIDE.format(key="api_name")},
        {_changes("call_count", "total_time_us", "avg_time_us")}
      FROM b FULL JOIN a ON a.api_name = b.api_name""",
    "compared_frames": f"{TRACE}, {_COMPARED_FRAMES} SELECT * FROM compared",
    "compared_runs": f"""{TRACE}, r AS (SELECT CASE log_id % 2 WHEN 0 THEN 'before' ELSE 'after' END AS run, count(*) AS total_frames,
        CAST(sum(total_time_us) AS BIGINT) AS total_time_us, CAST(sum(total_time_us) AS BIGINT) // count(*) AS avg_time_us,
        max(total_time_us) AS max_time_us, min(total_time_us) AS min_time_us FROM frames GROUP BY log_id % 2)
      SELECT r.*, r.total_frames - o.total_frames AS total_frames_beyond_other, r.total_time_us - o.total_time_us AS total_time_us_beyond_other,
        r.avg_time_us - o.avg_time_us AS avg_time_us_beyond_other, r.max_time_us - o.max_time_us AS max_time_us_beyond_other,
        r.min_time_us - o.min_time_us AS min_time_us_beyond_other
      FROM r LEFT JOIN r o ON r.run <> o.run""",
    "regressed_frames": f"""{TRACE}, {_COMPARED_FRAMES} SELECT * FROM compared
      WHERE total_time_us_growth > 1.5 OR side = 'after' AND total_time_us_after > 0""",
    "expression_search": f"""{TEXT} SELECT log_id, line_num, content FROM text_lines
      WHERE (contains(lower(content), 'the') OR contains(lower(content), 'license')) AND NOT contains(lower(content), 'ing on')
        AND regexp_matches(content, '\\b[A-Z][a-z]+s\\b')""",
    "expression_search_in_frames": f"""{TRACE} SELECT log_id, frame_num, line_num, api_name, time_us FROM calls JOIN
      (SELECT log_id, frame_num FROM frames WHERE total_time_us BETWEEN 40000 AND 120000) USING (log_id, frame_num)
      WHERE frame_num BETWEEN 2 AND 9 AND (contains(lower(api_name), 'glrf') OR regexp_matches(api_name, '^glN\\w$'))""",
}
_SIX_SHAPES = f"""{AGG}, m AS (SELECT *, (row_number() OVER (PARTITION BY log_id ORDER BY line_num) - 1) // 10 AS page_num
      FROM ({_RENDERED}) WHERE contains(lower(content), 'draw')),
    longest AS ({_TOP.format(n=1)}), sh AS ({SHADER} SELECT * FROM shaders)
  SELECT 'search' AS kind, log_id, concat_ws('|', line_num, content, page_num) AS fields FROM m
  UNION ALL SELECT 'funcs', log_id, concat_ws('|', api_name, call_count, total_time_us, avg_time_us)
    FROM ({_FUNC.format(calls='calls', where='')})
  UNION ALL SELECT 'frames', log_id, concat_ws('|', frame_num, start_line, end_line, total_time_us, api_call_count) FROM frames
  UNION ALL SELECT 'frame', log_id, concat_ws('|', frame_num, start_line, end_line, total_time_us, swap_time_us,
    api_total_time_us, api_call_count) FROM longest
  UNION ALL SELECT 'shader_stats', log_id, concat_ws('|', type, compile_count, total_compile_time_us) FROM ({_SHADER_CALLS})
  UNION ALL SELECT 'shaders', log_id, concat_ws('|', shader_id, source) FROM sh"""
ORACLE["csv_of_each_log"] = ORACLE["json_of_each_log"] = _SIX_SHAPES
ORACLE["frame_trees_of_each_log"] = f"SELECT log_id, value FROM ({ORACLE['frame_detail_text']})"
ORACLE["reopened_summary"] = ORACLE["parse_summary"]
