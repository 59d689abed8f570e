"""The same results in DuckDB's SQL, written from the operators' definitions."""

from __future__ import annotations

from foliospark.functions import wording as w
from foliospark.operators import ingest
from foliospark.functions.jsonx import NOT_JSON, NOT_OBJECT  # noqa: F401  the texts behind the error codes 2 and 1

_S = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _clean(x: str) -> str:
    joined = rf"regexp_replace(coalesce({x}, ''), '([^\x00-\x{{FF}}])[{_S}]+([^\x00-\x{{FF}}])', '\1\2', 'g')"
    return _strip(f"regexp_replace({joined}, '[{_S}]+', ' ', 'g')")


def _title(x: str) -> str:
    return f"CASE WHEN contains({x}, '-') THEN {_strip(f'string_split({x}, {chr(39)}-{chr(39)})[-1]')} ELSE {x} END"


_CJK = "translate(text, 'aeiou', '教学目标课')"

_TOP = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query_id, id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM q, c),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 3),
hits AS (SELECT query_id, rank, source, text FROM top LEFT JOIN documents ON doc_id = id)"""

_MD = "md AS (SELECT conv_id AS source, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"
_PIECES = f"{_MD}, pieces AS (SELECT source, i - 1 AS pos, {_strip('p[i]')} AS piece FROM (SELECT source, string_split(markdown, '---') AS p FROM md), unnest(range(1, len(p) + 1)) AS r(i)), chunks AS (SELECT source, pos, piece AS text FROM pieces WHERE length(piece) > 10)"

_EXT = "['pdf', 'DOCX', 'pptx', 'xlsx', 'XLS', 'png', 'Jpg', 'jpeg', 'bmp', 'webp', 'mp4', 'avi', 'MOV', 'mkv', 'txt', 'tar.gz'][p_partkey % 17 + 1]"
_NAMES = f"f AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 16 THEN p_name ELSE p_name || '.' || {_EXT} END AS name FROM part), e AS (SELECT *, lower(string_split(name, '.')[-1]) AS ext FROM f)"

_COLOR = "c AS (SELECT p_partkey, ltrim(CASE WHEN p_partkey % 5 = 0 THEN '#' || left(md5(p_name), 3) ELSE '##' || left(md5(p_name), 6) END, '#') AS h FROM part)"


def _channel(k: int) -> str:
    return f"CASE WHEN length(h) = 6 THEN ('0x' || h[{k}:{k + 1}])::INTEGER ELSE 0 END"


_REPLY = """CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' as asked.'
  WHEN 2 THEN '{bad} then ' || props WHEN 3 THEN 'null' ELSE ' ' || props || ' ' END"""

_DESC = """CASE event_id % 5 WHEN 0 THEN 'Play {"game_type": "quiz", "n": ' || event_id || '} now'
  WHEN 1 THEN 'Play {"pairs": [{"left": 1}], "game_type": "memory_match"} and {"pairs": [{"left": 1}], "game_type": "memory_match"} again'
  WHEN 2 THEN 'Play {"game_type": "memory_match", "pairs": [{"left": 1}]} now' WHEN 3 THEN 'See {x} and {"game_type": "quiz"}' ELSE 'no game' END"""

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_STAGES = f"""st AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS stage_pos FROM lineitem),
pg AS (SELECT l_orderkey AS project_id, stage_pos, p.i AS point_pos, CASE WHEN l_linenumber % 3 = 1 AND p.i = 0 THEN 'P' || l_partkey ELSE l_linestatus END AS title,
  CASE WHEN l_linenumber % 3 = 1 THEN 'E' || l_suppkey ELSE 'D' || l_partkey END AS content, CASE WHEN l_quantity > 45 THEN 'drag_sort' END AS game_type
  FROM st, unnest(range(0, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END)) AS p(i))"""
_DECK_PAGES = f"""p AS (SELECT l_orderkey AS project_id, 't' || l_partkey AS title, 'c' || l_suppkey AS content, CASE WHEN l_quantity > 25 THEN 'i' || l_partkey ELSE '' END AS image_path,
  CASE WHEN l_linenumber % 2 = 0 THEN '/g' END AS game_url, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS page_no, count(*) OVER (PARTITION BY l_orderkey) AS n_pages FROM lineitem)"""
_ELEMENTS = f"""{_DECK_PAGES},
l AS (SELECT project_id, page_no, unnest(list_filter([
  {{'o': 1, 'type': 'heading', 'content': title, 'src': NULL, 'url': NULL, 'size': 40, 'bold': true, 'color': '1A202C', 'x': 80, 'y': 60, 'width': 1120, 'height': 80}},
  {{'o': 2, 'type': 'text', 'content': content, 'src': NULL, 'url': NULL, 'size': 22, 'bold': false, 'color': '4A5568', 'x': 80, 'y': 160, 'width': CASE WHEN image_path <> '' THEN 600 ELSE 1120 END, 'height': 450}},
  CASE WHEN image_path <> '' THEN {{'o': 3, 'type': 'image', 'content': NULL, 'src': image_path, 'url': NULL, 'size': NULL, 'bold': false, 'color': NULL, 'x': 750, 'y': 160, 'width': 450, 'height': 450}} END,
  CASE WHEN game_url <> '' THEN {{'o': 4, 'type': 'game_link', 'content': '{w.GAME_LINK}', 'src': NULL, 'url': game_url, 'size': 18, 'bold': true, 'color': '0070C0', 'x': 80, 'y': 620, 'width': 400, 'height': 50}} END,
  {{'o': 5, 'type': 'text', 'content': page_no || ' / ' || n_pages, 'src': NULL, 'url': NULL, 'size': 14, 'bold': false, 'color': 'A0AEC0', 'x': 1150, 'y': 680, 'width': 100, 'height': 30}}], lambda x: x IS NOT NULL)) AS e FROM p),
n AS (SELECT project_id, page_no, row_number() OVER (PARTITION BY project_id, page_no ORDER BY e.o) - 1 AS pos, e FROM l)"""

_KB = f"""k AS (SELECT conv_id, conv_id || '.json' AS file, turn::INTEGER AS pos, role, turn, {_clean('text')} AS body, text, {_clean(_strip('text'))} AS leaf, length({_strip('text')}) > 5 AS long FROM conversations),
b AS (
  SELECT file, pos, 0::BIGINT AS block, '# 【教材】《B》- C - S1' AS h, body FROM k WHERE role = 'user' AND body <> ''
  UNION ALL SELECT file, pos, 0, '# 【优质资源】{w.UNNAMED_RESOURCE} - 第 ' || turn || ' 页', body FROM k WHERE role = 'assistant' AND turn % 4 = 1 AND body <> ''
  UNION ALL SELECT file, pos, 0, '{w.GOALS_HEADING}', {_clean("'G one ' || text")} FROM k WHERE role = 'assistant' AND turn % 4 <> 1
  UNION ALL SELECT file, pos, 1, '{w.POINTS_HEADING}', leaf FROM k WHERE role = 'assistant' AND turn % 4 <> 1 AND long
  UNION ALL SELECT file, pos, 0, '# 【时事热点】新闻素材：H', leaf FROM k WHERE role NOT IN ('user', 'assistant') AND conv_id % 2 = 0 AND long
  UNION ALL SELECT file, pos, 0, '# 【{w.UNKNOWN_LAYER}】补充知识片段', leaf FROM k WHERE role NOT IN ('user', 'assistant') AND conv_id % 2 <> 0 AND long),
m AS (SELECT file, pos, block, h || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS markdown FROM b)"""

_TEMPLATES = "t(game_type, html) AS (VALUES ('click', '<a>/*INJECT_DATA*/</a>'), ('view', '<b>/*INJECT_DATA*/ /*INJECT_DATA*/</b>'), ('purchase', '<c></c>'))"
_CARDS = """cards AS (SELECT n_regionkey AS game_id, n_nationkey AS pair_id, unnest(['left', 'right']) AS side, unnest([n_name, r_name]) AS label FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_FLIPS = """f AS (SELECT user_id AS game_id, event_id AS "at", (event_id // 2) % 5 AS pair_id, CASE WHEN event_id % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY "at", pair_id, side) AS n FROM f),
r AS (SELECT game_id, 0::BIGINT AS n, NULL::BIGINT AS o_at, NULL::BIGINT AS o_pair, NULL::VARCHAR AS o_side, []::BIGINT[] AS found, 0::BIGINT AS done, NULL::BOOLEAN AS matched, NULL::BIGINT AS m_at FROM (SELECT DISTINCT game_id FROM f)
  UNION ALL SELECT game_id, n, CASE WHEN idle THEN o_at WHEN o_at IS NULL THEN "at" END, CASE WHEN idle THEN o_pair WHEN o_at IS NULL THEN pair_id END, CASE WHEN idle THEN o_side WHEN o_at IS NULL THEN side END,
    CASE WHEN NOT idle AND o_at IS NOT NULL AND o_pair = pair_id THEN list_append(found, pair_id) ELSE found END, done + CASE WHEN NOT idle AND o_at IS NOT NULL THEN 1 ELSE 0 END,
    CASE WHEN NOT idle AND o_at IS NOT NULL THEN o_pair = pair_id END, CASE WHEN NOT idle AND o_at IS NOT NULL THEN o_at END
  FROM (SELECT r.* EXCLUDE (n), q.n AS n, q."at" AS "at", q.pair_id AS pair_id, q.side AS side, list_contains(found, q.pair_id) OR (o_at IS NOT NULL AND o_pair = q.pair_id AND o_side = q.side) AS idle FROM r JOIN q ON q.game_id = r.game_id AND q.n = r.n + 1)),
mv AS (SELECT game_id, done - 1 AS move, m_at AS "at", matched FROM r WHERE matched IS NOT NULL)"""
_BLOCKS = f"""l AS (SELECT doc_id, i - 1 AS pos, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
b AS (SELECT doc_id AS file, count(*)::BIGINT AS element_count, {_strip("coalesce(string_agg(CASE WHEN (doc_id + pos) % 5 <> 0 THEN repeat(line, 8) END, chr(10) || chr(10) ORDER BY pos), '')")} AS t FROM l GROUP BY doc_id),
g AS (SELECT file, element_count, CASE WHEN t = '' THEN '{w.NOTHING_READ}' ELSE t END AS t FROM b)"""

_NOTICE = w.CUT_NOTICE.replace("\n\n", "' || chr(10) || chr(10) || '")
_META = "o AS (SELECT DISTINCT l_orderkey AS project_id FROM lineitem)"

SQL = {
    "vector_topk": f"WITH {_TOP} SELECT query_id, rank, id, score FROM top",
    "hit_projection": f"WITH {_TOP} SELECT query_id, rank, coalesce(source, '{w.EVIDENCE_SOURCE}') AS source, coalesce(text, '') AS text FROM hits",
    "evidence_concat": f"""WITH {_TOP}, e AS (SELECT query_id, string_agg('【来源: ' || coalesce(source, '{w.EVIDENCE_SOURCE}') || '】' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS x FROM hits GROUP BY query_id)
SELECT query_id, md5(x) AS evidence_md5, length(x)::BIGINT AS n_chars FROM e""",
    "evidence_assemble": f"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND text <> '' THEN '{w.OUTSIDE_LABEL}' || chr(10) || text || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 AND text <> '' THEN '{w.CLOUD_LABEL}' || chr(10) || text || chr(10) || chr(10) ELSE '' END) AS evidence_md5 FROM documents""",
    "clean_text_latin": f"SELECT doc_id, md5({_clean('text')}) AS clean_md5 FROM documents",
    "clean_text_cjk": f"SELECT doc_id, md5({_clean(_CJK)}) AS clean_md5, length({_clean(_CJK)})::BIGINT AS n_chars FROM documents",
    "clean_text_spaces": f"""WITH x AS (SELECT doc_id, chr(12288) || ' ' || replace({_CJK}, ' ', chr(12288) || ' ') || chr(28) || ' ' AS t FROM documents) SELECT doc_id, md5({_clean('t')}) AS clean_md5 FROM x""",
    "chunk_split": f"WITH {_PIECES} SELECT source, pos, md5(piece) AS piece_md5 FROM pieces",
    "chunk_min_len": f"WITH {_PIECES} SELECT source, pos, md5(text) AS chunk_md5 FROM chunks",
    "chunk_short": f"""WITH m AS (SELECT user_id AS source, string_split(string_agg(props || CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END, '---' ORDER BY event_id), '---') AS p FROM events GROUP BY user_id),
x AS (SELECT source, i - 1 AS pos, {_strip('p[i]')} AS text FROM m, unnest(range(1, len(p) + 1)) AS r(i)),
y AS (SELECT source, text, pos FROM x WHERE length(text) > 10) SELECT source, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS pos, text FROM y""",
    "chunk_ids": f"WITH {_PIECES} SELECT row_number() OVER (ORDER BY source, pos) - 1 AS id, source, pos, md5(text) AS chunk_md5 FROM chunks",
    "stage_title": f"WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN replace(o_orderpriority, '-', ' ') ELSE o_orderpriority || ' ' END AS s FROM orders) SELECT o_orderkey, {_title('s')} AS title FROM x",
    "ext_filter": f"WITH {_NAMES} SELECT p_partkey, ext FROM e WHERE ext IN ('pdf','docx','pptx','xlsx','xls','png','jpg','jpeg','bmp','webp','mp4','avi','mov','mkv')",
    "ext_route": f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN ext IN ('xlsx','xls') THEN 'sheet' WHEN ext IN ('png','jpg','jpeg','bmp','webp') THEN 'image'
  WHEN ext IN ('mp4','avi','mov','mkv') THEN 'video' WHEN ext IN ('pdf','docx','pptx') THEN 'document' ELSE 'refused' END AS route FROM e""",
    "px_to_inch": "SELECT p_partkey, round(p_size * 20 / 1280 * 13.333::DOUBLE, 6) AS inch FROM part",
    "hex_rgb": f"WITH {_COLOR} SELECT p_partkey, {_channel(1)} AS r, {_channel(3)} AS g, {_channel(5)} AS b FROM c",
    "json_tolerant": f"""WITH r AS (SELECT event_id, trim({_strip(_REPLY)}, '`json') AS t0 FROM events), s AS (SELECT event_id, {_strip('t0')} AS t FROM r),
x AS (SELECT event_id, CASE WHEN json_valid(t) THEN t END AS a, regexp_extract(t, '(?s)\\{{.*\\}}') AS sp FROM s)
SELECT event_id, json_extract(coalesce(a, CASE WHEN sp <> '' AND json_valid(sp) THEN sp END), '$.k')::BIGINT AS k,
  CASE WHEN a IS NOT NULL OR (sp <> '' AND json_valid(sp)) THEN 0 WHEN sp = '' THEN 1 ELSE 2 END AS error FROM x""",
    "game_mine": f"""WITH e AS (SELECT event_id, {_DESC} AS t, event_id % 7 = 0 AS own FROM events),
s AS (SELECT *, regexp_extract(t, '\\{{[\\s\\S]*?"game_type"[\\s\\S]*?\\}}') AS sp FROM e), u AS (SELECT *, NOT own AND contains(t, '"game_type"') AND sp <> '' AND json_valid(sp) AS use FROM s)
SELECT event_id, CASE WHEN own THEN 'own' WHEN use THEN json_extract_string(sp, '$.game_type') END AS game_type, CASE WHEN use THEN replace(t, sp, '{w.GAME_LOADED}') ELSE t END AS description FROM u""",
    "string_or_object": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "unwrap": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract(props, '$.k')::BIGINT ELSE -1 END AS k FROM events",
    "precedence": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props WHEN event_id % 3 = 0 THEN '{"n": ' || event_id || '}' END AS chosen FROM events""",
    "leaf_text": f"""WITH x AS (SELECT conv_id, turn, {_strip('text')} AS t FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN length(t) > 5 THEN t || chr(10) ELSE '' END || 'long enough' || chr(10) || 'nested leaf' || chr(10) || 'last by place') AS leaves_md5 FROM x""",
    "kb_route": f"WITH {_KB} SELECT file, pos, block, md5(markdown) AS markdown_md5 FROM m",
    "kb_markdown": f"WITH {_KB}, x AS (SELECT file, string_agg(markdown, '' ORDER BY pos, block) AS t FROM m GROUP BY file) SELECT replace(file, '.json', '_clean.md') AS file, md5(t) AS markdown_md5, length(t)::BIGINT AS n_chars FROM x",
    "kb_split": """WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT user_id AS file, pos, k FROM x WHERE user_id % 3 = 0 UNION ALL SELECT DISTINCT user_id, 0, -5 FROM events WHERE user_id % 3 = 1""",
    "goals_join": f"SELECT p_partkey, {_clean("concat_ws(' ', p_name, '  ' || p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END)")} AS goals FROM part",
    "flatten_pages": f"WITH {_STAGES} SELECT project_id, stage_pos, point_pos, title, content, game_type FROM pg",
    "page_numbers": f"WITH {_STAGES} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY stage_pos, point_pos) AS page_no, count(*) OVER (PARTITION BY project_id) AS n_pages, title FROM pg",
    "layout_elements": f"""WITH {_ELEMENTS} SELECT project_id, page_no, pos, e.type AS type, e.content AS content, e.src AS src, e.url AS url, e.size AS font_size, e.bold AS bold, '#' || e.color AS color, e.x AS x, e.y AS y, e.width AS width, e.height AS height FROM n""",
    "layout_images": f"""WITH {_DECK_PAGES}, h AS (SELECT 'i' || p_partkey AS path FROM part WHERE p_size > 25)
SELECT project_id, page_no, 3 + CASE WHEN path IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN game_url <> '' THEN 1 ELSE 0 END AS n_elements FROM p LEFT JOIN h ON image_path = path""",
    "layout_render": f"""WITH {_ELEMENTS}, h AS (SELECT 'i' || p_partkey AS path FROM part WHERE p_size > 25),
c AS (SELECT *, e.type AS type, page_no % 3 = 0 AS bare FROM n LEFT JOIN h ON e.src = path WHERE NOT (page_no % 5 = 0 AND pos = 1) AND (e.type <> 'image' OR path IS NOT NULL)),
v AS (SELECT *, CASE WHEN NOT bare THEN e.color WHEN type = 'game_link' THEN '0070C0' END AS k FROM c)
SELECT project_id, page_no, pos, type, round(CASE WHEN bare THEN 0 ELSE e.x END / 1280 * 13.333::DOUBLE, 4) AS x_in, round(CASE WHEN bare THEN 0 ELSE e.y END / 1280 * 13.333::DOUBLE, 4) AS y_in,
  round(CASE WHEN bare THEN 800 ELSE e.width END / 1280 * 13.333::DOUBLE, 4) AS width_in, round(CASE WHEN bare THEN 100 ELSE e.height END / 1280 * 13.333::DOUBLE, 4) AS height_in,
  CASE WHEN type = 'image' THEN NULL WHEN NOT bare THEN e.size WHEN type = 'game_link' THEN 18 ELSE 20 END AS font_size, CASE WHEN type <> 'image' THEN (e.bold AND NOT bare)::INTEGER END AS bold,
  ('0x' || k[1:2])::INTEGER AS r, ('0x' || k[3:4])::INTEGER AS g, ('0x' || k[5:6])::INTEGER AS b, type = 'game_link' AS underline, CASE WHEN type = 'game_link' THEN 'http://h' || e.url END AS link,
  CASE WHEN type IN ('text', 'heading') THEN 1.3::DOUBLE END AS line_spacing FROM v""",
    "deck_files": f"""WITH {_ELEMENTS} SELECT 'presentation_' || project_id || '.pptx' AS file, count(*) AS n,
  md5(string_agg(CASE WHEN e.type = 'heading' THEN 'Title:' ELSE 'NarrativeText:' END || e.content, chr(10) ORDER BY page_no, pos)) AS text_md5 FROM n WHERE e.type <> 'image' GROUP BY project_id""",
    "lesson_files": "SELECT DISTINCT 'word_project_' || l_orderkey || '.docx' AS file, 5::BIGINT AS n FROM lineitem",
    "embedded_chunks": f"WITH {_PIECES} SELECT row_number() OVER (ORDER BY source, pos) - 1 AS id, source, 64 AS width, md5(text) AS text_md5 FROM chunks",
    "enrich_pages": f"""WITH {_STAGES} SELECT project_id, stage_pos, point_pos, upper('Summarise this slide in short numbered points, at most 150 characters in all, and say nothing else.' || chr(10) || 'Title: ' || title || chr(10) || 'Notes: ' || content) AS content,
  CASE WHEN stage_pos % 3 <> 0 THEN 'img_' || left(sha256(title), 16) || '.png' END AS image_path, '/static/exports/interactive_game_' || project_id || '_' || game_type || '.html' AS game_url FROM pg""",
    "parse_status": f"""WITH x AS (SELECT doc_id, {_strip("string_split(text, chr(10))[1]")} AS s FROM documents),
y AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 OR s = '' THEN '{w.NOTHING_READ}' WHEN length(s) > 80000 THEN left(s, 80000) || '{_NOTICE}' ELSE s END AS t FROM x)
SELECT doc_id || '.pdf' AS file, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'success' END AS status, md5(t) AS text_md5, CASE doc_id % 3 WHEN 1 THEN 0 WHEN 2 THEN 2 END::BIGINT AS element_count,
  length(t)::BIGINT AS char_count, CASE WHEN doc_id % 3 = 0 THEN '{ingest.UNREAD}' END AS message FROM y""",
    "queue_errors": f"WITH {_STAGES} SELECT DISTINCT l_orderkey AS project_id, 422 AS code, '{w.NO_PAGES}' AS message FROM lineitem WHERE l_orderkey NOT IN (SELECT project_id FROM pg WHERE stage_pos > 2)",
    "kb_empty_export": """SELECT DISTINCT conv_id || '_clean.md' AS file, CASE WHEN conv_id % 3 = 0 THEN '' ELSE '# 【L】补充知识片段' || chr(10) || chr(10) || 'leaf of ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) END AS markdown
FROM conversations WHERE turn = 0 AND conv_id % 3 <> 2""",
    "layout_decks": f"""WITH {_ELEMENTS}, t AS (SELECT project_id, page_no, 'slide-' || left(sha256(project_id || '/' || page_no), 8) || chr(10) || string_agg(concat_ws(',', e.type, coalesce(e.content, '-'), coalesce(e.src, '-'), coalesce(e.url, '-'),
  coalesce(e.size::VARCHAR, '-'), CASE WHEN e.bold THEN 'bold' ELSE '-' END, coalesce('#' || e.color, '-'), e.x, e.y, e.width, e.height), chr(10) ORDER BY pos) AS s FROM n GROUP BY project_id, page_no)
SELECT project_id, '项目 ' || project_id || ' 演示文稿' AS title, 'me,1280,720' AS meta, count(*) AS n_slides, md5(string_agg(s, chr(10) ORDER BY page_no)) AS slides_md5 FROM t GROUP BY project_id""",
    "key_points": f"""WITH {_STAGES}, x AS (SELECT l_orderkey AS project_id, string_agg(CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'R' THEN 'P' || l_partkey END, '；' ORDER BY stage_pos) AS a,
  string_agg(CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'A' THEN 'P' || l_partkey END, '；' ORDER BY stage_pos) AS b, bool_or(l_linenumber % 3 = 1 AND l_returnflag = 'N') AS n FROM st GROUP BY l_orderkey)
SELECT project_id, md5(coalesce(a, CASE WHEN n THEN '' END, '{w.NO_POINTS}')) AS key_md5, md5(coalesce(b, CASE WHEN n THEN '' END, '{w.NO_POINTS}')) AS difficult_md5 FROM x""",
    "lesson_process": f"""WITH {_STAGES}, x AS (SELECT l_orderkey AS project_id, stage_pos, l_linestatus AS stage, l_linenumber AS n, 'P' || l_partkey AS p, '    E' || l_suppkey || chr(10) || chr(10) AS e, 'D' || l_partkey AS dsc,
  CASE l_returnflag WHEN 'A' THEN '{w.DIFFICULT}' WHEN 'R' THEN '{w.KEY}' ELSE '{w.PLAIN}' END AS f1, CASE WHEN l_returnflag = 'N' THEN '{w.DIFFICULT}' ELSE '{w.PLAIN}' END AS f2 FROM st)
SELECT project_id, stage_pos, stage, md5(CASE WHEN n % 3 = 1 THEN f1 || p || chr(10) || e || f2 || chr(10) || e ELSE dsc END) AS activity_md5,
  '【互动形式】' || chr(10) || '{w.INTERACTION}' || chr(10) || chr(10) || '【时间安排】' || chr(10) || n || ' 分钟' AS intent FROM x""",
    "lesson_info": f"""WITH {_META} SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'T' || project_id ELSE '{w.UNNAMED_COURSE}' END AS title, '{w.ANYONE}' AS audience,
  CASE WHEN project_id % 2 = 0 THEN '45 分钟' ELSE '90 分钟' END AS minutes, CASE WHEN project_id % 2 = 0 THEN 'a、b' ELSE 'talk' END AS methods,
  CASE WHEN project_id % 2 = 0 THEN '{w.HOMEWORK}' ELSE 'h' END AS homework, CASE WHEN project_id % 2 = 0 THEN '  1. x' || chr(10) || '  2. y' || chr(10) ELSE '' END AS objectives FROM o""",
    "lesson_cells": "SELECT l_orderkey AS project_id, 17 + 3 * count(*) AS n_cells, count(*) + 2 AS process_rows FROM lineitem GROUP BY l_orderkey",
    "point_prefix": f"SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN '{w.DIFFICULT}' WHEN 'R' THEN '{w.KEY}' ELSE '{w.PLAIN}' END AS prefix, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "methods_join": f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '、' || p_type WHEN 1 THEN p_brand ELSE '{'、'.join(w.DEFAULT_METHODS)}' END AS methods FROM part",
    "objectives_enum": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '  1. ' || p_name || chr(10) || '  2. ' || p_type || chr(10) || '  3. ' || p_brand || chr(10) END AS objectives FROM part",
    "last_writer": "SELECT user_id, event_type, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "template_lookup": f"WITH {_TEMPLATES}, e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_type ELSE '{w.DEFAULT_GAME}' END AS game_type FROM events) SELECT event_id, game_type, html IS NOT NULL AS known FROM e LEFT JOIN t USING (game_type)",
    "template_inject": f"WITH {_TEMPLATES} SELECT event_id, replace(html, '/*INJECT_DATA*/', props || CASE WHEN event_id % 2 = 0 THEN '<\\/script>' ELSE '' END) AS page FROM events LEFT JOIN t ON event_type = game_type",
    "memory_cards": f"WITH {_CARDS} SELECT game_id, pair_id, side, label FROM cards",
    "memory_match": f"WITH {_CARDS} SELECT a.game_id, a.pair_id, a.side, a.label, b.side AS other_side, b.label AS other_label FROM cards a JOIN cards b ON a.game_id = b.game_id AND a.pair_id = b.pair_id AND a.side < b.side",
    "memory_flips": f"WITH RECURSIVE {_FLIPS} SELECT game_id, move, \"at\", matched FROM mv",
    "memory_progress": f"""WITH RECURSIVE {_FLIPS}, k AS (SELECT game_id, count(*) AS cards FROM (SELECT DISTINCT game_id, pair_id, side FROM f) GROUP BY game_id), m AS (SELECT game_id, 2 * count(*) FILTER (matched) AS matched_cards FROM mv GROUP BY game_id)
SELECT game_id, coalesce(matched_cards, 0) AS matched_cards, cards, coalesce(matched_cards = cards, false) AS won FROM k LEFT JOIN m USING (game_id)""",
    "drag_sort": """WITH l AS (SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'STANDARD' ELSE 'PROMO' END AS category FROM lineitem)
SELECT l_partkey::VARCHAR AS word, category, coalesce(p_type = category, false) AS right FROM l LEFT JOIN part ON p_partkey = l_partkey""",
    "quiz_check": """SELECT p_partkey // 50 AS game_id, p_partkey AS question, [p_brand, p_type, p_name][p_partkey % 4 + 1] AS chosen, p_partkey % 4 = p_size % 3 AS right,
  CASE WHEN p_partkey < max(p_partkey) OVER (PARTITION BY p_partkey // 50) THEN p_partkey + 1 END AS next_question FROM part""",
    "concat_blocks": f"WITH {_BLOCKS} SELECT file, 'success' AS status, element_count, length(t)::BIGINT AS char_count, md5(t) AS text_md5 FROM g",
    "truncate_guard": f"""WITH {_BLOCKS}, c AS (SELECT file, CASE WHEN length(t) > 80000 THEN left(t, 80000) || '{_NOTICE}' ELSE t END AS t FROM g)
SELECT 'success' AS status, file AS file_name, length(t)::BIGINT AS char_count, md5(t) AS text_md5 FROM c""",
    "element_filter": f"""SELECT doc_id, md5(CASE WHEN doc_id % 6 < 3 THEN text WHEN doc_id % 12 = 3 THEN chr(10) || '{w.TABLE_CAPTION}' || chr(10) || '<table>' || lang || '</table>' || chr(10)
  WHEN doc_id % 6 = 3 THEN chr(10) || '{w.PLAIN_TABLE_CAPTION}' || chr(10) || text || chr(10) END) AS block_md5 FROM documents""",
    "sheet_markdown": """SELECT r_name AS sheet, chr(10) || '[📊 表格：' || r_name || ']' || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown, count(*) AS n_rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "retention_expired": """WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id, floor(epoch(t))::BIGINT - floor(epoch(ts))::BIGINT AS age_seconds FROM events, m
WHERE event_id % 20 <> 0 AND event_id % 50 <> 0 AND ts < t - INTERVAL 24 HOUR""",
    "token_expiry": "SELECT event_id, ts + INTERVAL 1440 MINUTE AS expires FROM events",
    "user_lookup": """WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new ' || c_custkey % 50 END AS username FROM customer)
SELECT username, username IN (SELECT c_name FROM customer) AS found, count(*) AS n FROM r GROUP BY ALL""",
    "register_new": "SELECT DISTINCT 'new ' || c_custkey % 50 AS username, 'teacher' AS role, true AS is_active FROM customer WHERE c_custkey % 2 <> 0",
    "owners_gone": "SELECT o_orderkey AS id, o_custkey AS teacher_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
}
