"""DuckDB SQL for each query of the registry that SQL can express."""

from __future__ import annotations

import re

from tessera.functions.text import NOISE_MARKERS, NOISE_VERBS
from tessera.operators.retrieval import NO_RESULTS, SEPARATOR
from tessera.sources.catalogs import BANGS, CATEGORIES, NO_PAGES, TIME_RANGES


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_BANGS = "bangs(bang, name, description, engine, category) AS (VALUES " + ", ".join("(" + ", ".join(map(_text, b)) + ")" for b in BANGS) + ")"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SENTENCES = "list_filter(list_transform(regexp_extract_all({}, '[^.!?\\n]+[.!?]*'), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(160))), lambda s: length(s) > 0)"

_POINTS = """points_now AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY upserted_at DESC) AS rn FROM points)
  WHERE rn = 1 AND len(dense) = 64 AND NOT list_bool_or(list_transform(dense, lambda x: isnan(x))) AND list_sum(list_transform(dense, lambda x: abs(x))) > 0)"""
_CHUNKS = """chunks_now AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, content DESC) AS rn FROM chunks) WHERE rn = 1)"""


def _ranked(rows: str, k: int = 10) -> str:
    return f"""SELECT query_id, point_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM ({rows})) WHERE rank <= {k}"""


_DENSE = _ranked("""
  SELECT q.point_id AS query_id, p.point_id, round(array_cosine_similarity(q.dense::DOUBLE[64], p.dense::DOUBLE[64]), 6) AS score
  FROM points_now q, points_now p WHERE q.point_id % 50 = 0""")
_POSTINGS = """postings AS (
  SELECT point_id, unnest(sparse.indices) AS term, unnest(sparse.weights)::DOUBLE AS weight FROM points_now WHERE sparse IS NOT NULL)"""
_SPARSE = _ranked("""
  SELECT q.point_id AS query_id, p.point_id, round(sum(q.weight * p.weight), 6) AS score
  FROM postings q JOIN postings p USING (term) WHERE q.point_id % 50 = 0 GROUP BY 1, 2""")
_FUSED = _ranked("""
  SELECT query_id, point_id, round(sum(1.0 / (60 + rank)), 6) AS score
  FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY 1, 2""")
_HYBRID = f"""{_POINTS}, {_CHUNKS}, {_POSTINGS}, dense AS ({_DENSE}), sparse AS ({_SPARSE}), fused AS ({_FUSED}),
asked AS (SELECT p.point_id AS query_id, coalesce(c.content, '') AS query FROM points_now p LEFT JOIN chunks_now c ON c.id = p.chunk_id WHERE p.point_id % 50 = 0),
scored AS (
  SELECT f.query_id, f.point_id, f.rank, c.content, c.section_path, list_distinct({_WORDS.format('a.query')}) AS q, {_WORDS.format('c.content')} AS w
  FROM fused f JOIN points_now p ON p.point_id = f.point_id JOIN chunks_now c ON c.id = p.chunk_id JOIN asked a ON a.query_id = f.query_id),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank FROM (
    SELECT *, round(CASE WHEN len(q) > 0 THEN coalesce(len(list_intersect(q, w)), 0) / len(q) ELSE 0 END, 6) AS rerank_score FROM scored))"""

def _lexical(table: str, key: str) -> str:
    return f"""SELECT {key}, term, round(ln(1 + count(*)), 6) AS weight FROM (
  SELECT {key}, unnest({_WORDS.format('text')}) AS term FROM {table}) GROUP BY 1, 2"""


_ROUTED = f"""{_BANGS}, parsed AS (
  SELECT request_id, page, per_page, time_range, query_text, category AS asked,
    CASE WHEN starts_with(split_part(query_text, ' ', 1), '!') THEN split_part(query_text, ' ', 1) END AS bang,
    CASE WHEN len(engines) > 0 THEN engines WHEN engine <> '' THEN [engine] END AS given
  FROM search_requests),
routed AS (
  SELECT p.request_id, p.bang, page, per_page, time_range, asked, query_text,
    CASE WHEN p.bang IS NULL THEN query_text ELSE array_to_string(string_split(query_text, ' ')[2:], ' ') END AS query,
    coalesce(b.category, asked) AS category,
    CASE WHEN b.engine IS NOT NULL THEN [b.engine] ELSE given END AS engines,
    CASE WHEN p.bang IS NOT NULL AND b.category IS NULL THEN 'unknown_bang' END AS error
  FROM parsed p LEFT JOIN bangs b ON b.bang = p.bang),
judged AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN query_text IS NULL THEN 'query' END,
    CASE WHEN asked IS NOT NULL AND asked NOT IN ({', '.join(_text(c) for c, _, _ in CATEGORIES)}) THEN 'category' END,
    CASE WHEN time_range IS NOT NULL AND time_range NOT IN ({', '.join(map(_text, TIME_RANGES))}) THEN 'time_range' END,
    CASE WHEN coalesce(page < 1, true) THEN 'page' END,
    CASE WHEN coalesce(NOT per_page BETWEEN 1 AND 100, true) THEN 'per_page' END], lambda x: x IS NOT NULL), ',') AS reasons,
    coalesce(len(list_filter(engines, lambda e: lower(e) IN ({', '.join(map(_text, NO_PAGES))}))) > 0, false) AS unpaged
  FROM routed),
valid AS (SELECT * FROM judged WHERE reasons = '' AND error IS NULL)"""
_NORMAL = """normal AS (
  SELECT DISTINCT result_id, request_id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(content, '') AS content, lower(coalesce(engine, '')) AS engine,
    coalesce(score, 0.0) AS score, CASE WHEN category <> '' THEN category ELSE 'general' END AS category FROM search_results)"""
_PAGED = f"""{_ROUTED}, {_NORMAL}, shown AS (
  SELECT request_id, rank, result_id, score FROM (
    SELECT n.request_id, n.result_id, n.score, v.per_page, CASE WHEN v.unpaged THEN 1 ELSE v.page END AS page,
      row_number() OVER (PARTITION BY n.request_id ORDER BY n.score DESC, n.result_id) AS rank
    FROM normal n JOIN valid v USING (request_id) WHERE v.engines IS NULL OR list_contains(v.engines, n.engine))
  WHERE rank BETWEEN (page - 1) * per_page + 1 AND page * per_page),
meta AS (
  SELECT v.request_id, v.query, v.category, coalesce(nullif(t.n, 0), coalesce(s.n, 0)) AS number_of_results, v.page, v.per_page,
    NOT v.unpaged AND coalesce(s.n, 0) = v.per_page AS has_next, v.page > 1 AS has_previous
  FROM valid v LEFT JOIN (SELECT request_id, count(*) AS n FROM shown GROUP BY 1) s USING (request_id)
  LEFT JOIN (SELECT n.request_id, count(*) AS n FROM normal n JOIN valid v USING (request_id) WHERE v.engines IS NULL OR list_contains(v.engines, n.engine) GROUP BY 1) t USING (request_id))"""

_IS_NOISE = f"""length(content) >= 20 AND (
  {' OR '.join(f"contains(lower(content)[1:100], {_text(m)})" for m in NOISE_MARKERS)}
  OR len(regexp_extract_all(content, '\\([12]\\d{{3}}\\)')) + len(regexp_extract_all(content, '[A-Z][a-z]+,?\\s+[A-Z]\\.')) + len(regexp_extract_all(content, 'et al\\.')) > 3
  OR len(w) = 0
  OR (len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(w) > 0.6 AND NOT list_has_any(list_transform(w, lambda x: lower(x)), [{', '.join(map(_text, NOISE_VERBS))}])))"""
_TOKENS = "list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w"
_NOISE = f"SELECT DISTINCT id, {_IS_NOISE} AS noise FROM (SELECT id, content, {_TOKENS} FROM chunks WHERE content IS NOT NULL)"


def _folded(pieces: str, joiner: str, most: int, header: bool = False, alone: bool = False) -> str:
    """Greedy packing of ``pieces(id, k, piece)`` by a recursive query; ``header(id, head)`` stands before each part."""
    base = "length(head) // 4" if header else "0"
    text = f"head || {_text(joiner)} || cur" if header else "cur"
    single = f"length(p.piece) // 4 > {most}" if alone else "false"
    head = "head" if header else "NULL::VARCHAR AS head"
    return f"""
pieces AS ({pieces}),
fold AS (
  SELECT id, 0::BIGINT AS k, head, NULL::VARCHAR AS cur, ({base})::BIGINT AS t, []::STRUCT(c VARCHAR, t BIGINT)[] AS done FROM (SELECT DISTINCT id, {head} FROM pieces)
  UNION ALL
  SELECT f.id, f.k + 1, f.head,
    CASE WHEN {single} THEN NULL WHEN f.cur IS NULL OR f.t + length(p.piece) // 4 > {most} THEN p.piece ELSE f.cur || {_text(joiner)} || p.piece END,
    CASE WHEN {single} THEN {base.replace('head', 'f.head')} WHEN f.cur IS NOT NULL AND f.t + length(p.piece) // 4 > {most} THEN {base.replace('head', 'f.head')} + length(p.piece) // 4 ELSE f.t + length(p.piece) // 4 END,
    CASE WHEN {single} THEN (CASE WHEN f.cur IS NULL THEN f.done ELSE list_append(f.done, {{'c': {text.replace('head', 'f.head').replace('cur', 'f.cur')}, 't': f.t}}) END) || [{{'c': p.piece, 't': length(p.piece) // 4}}]
      WHEN f.cur IS NOT NULL AND f.t + length(p.piece) // 4 > {most} THEN list_append(f.done, {{'c': {text.replace('head', 'f.head').replace('cur', 'f.cur')}, 't': f.t}}) ELSE f.done END
  FROM fold f JOIN pieces p ON p.id = f.id AND p.k = f.k + 1),
packed AS (
  SELECT id, CASE WHEN cur IS NULL THEN done ELSE list_append(done, {{'c': {text}, 't': t}}) END AS parts
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS rn FROM fold) WHERE rn = 1)"""


def _split(rows: str, pieces: str, whole: str, joiner: str, most: int, key: str, header: bool = False, alone: bool = False) -> str:
    """Parts of ``rows(id, content)``: those within the budget, or where ``whole`` holds, stay as they are."""
    return f"""WITH RECURSIVE rows_ AS ({rows}), big AS (SELECT * FROM rows_ WHERE length(content) // 4 > {most} AND NOT ({whole})),
{_folded(pieces, joiner, most, header, alone)}
SELECT id AS {key}, 0 AS part, md5(content) AS content_md5, length(content) // 4 AS tokens FROM rows_ WHERE length(content) // 4 <= {most} OR ({whole})
UNION ALL
SELECT id, k - 1, md5(parts[k].c), parts[k].t FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS k FROM packed)"""


def _of_type(kind: str) -> str:
    return f"SELECT DISTINCT id, content FROM chunks WHERE lower(chunk_type) = '{kind}' AND content IS NOT NULL"


_UNNEST = "SELECT id, k, l[k] AS piece FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, {} AS l FROM big))"
_TABLE_LINES = "string_split(trim(content, ' ' || chr(10) || chr(9) || chr(13)), chr(10))"
_ITEM = "([-*+] |\\d+\\.\\s)"
_ITEMS = f"list_filter(string_split(regexp_replace(content, '\\n(\\s*{_ITEM})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^\\s*{_ITEM}'))"

# markdown by lines: a recursive walk carries the type of the element that the line before belongs to

_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SOLID = _SPACE.replace("[", "[^", 1)


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_ELEMENTS = f"""
lines AS (SELECT doc_id, k, s[k] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (
  SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
formed AS (SELECT *, min(CASE WHEN mark THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing FROM (
  SELECT doc_id, k, line, NOT regexp_matches(line, '{_SOLID}') AS blank, regexp_matches(line, '^#{{1,6}}{_SPACE}+{_SOLID}') AS heading, contains(line, '|') AS pipe,
    regexp_matches(line, '^{_SPACE}*([-*+] |\\p{{Nd}}+\\.{_SPACE})') AS item, regexp_matches({_strip('line')}, '^[-*_]{{3,}}$') AS rule,
    starts_with(line, '```') AS fence, regexp_matches(line, '^{_SPACE}*```') AS mark FROM lines)),
kinds AS (SELECT *, CASE WHEN heading THEN 'heading' WHEN fence AND closing IS NOT NULL THEN 'code_block' WHEN pipe THEN 'table' WHEN item THEN 'list'
    WHEN rule THEN 'horizontal_rule' WHEN fence OR starts_with(line, '#') THEN 'drop' ELSE 'paragraph' END AS kind FROM formed),
walk AS (
  SELECT doc_id, 0::BIGINT AS k, NULL::VARCHAR AS mode, 0::BIGINT AS till, 0::BIGINT AS e FROM (SELECT DISTINCT doc_id FROM lines)
  UNION ALL
  SELECT doc_id, k, CASE WHEN inside THEN 'code_block' WHEN blank THEN NULL WHEN goes_on THEN mode ELSE kind END,
    CASE WHEN inside THEN till WHEN NOT blank AND NOT goes_on AND kind = 'code_block' THEN closing ELSE 0 END,
    e + CASE WHEN inside OR blank OR goes_on OR kind = 'drop' THEN 0 ELSE 1 END
  FROM (SELECT w.doc_id, m.k, w.mode, w.till, w.e, m.blank, m.kind, m.closing, m.k <= w.till AS inside,
      coalesce((w.mode = 'table' AND m.pipe) OR (w.mode = 'list' AND (m.item OR starts_with(m.line, '  '))) OR (w.mode = 'paragraph' AND m.kind = 'paragraph'), false) AS goes_on
    FROM walk w JOIN kinds m ON m.doc_id = w.doc_id AND m.k = w.k + 1)),
grouped AS (
  SELECT w.doc_id, e, any_value(mode) AS type, first(line ORDER BY w.k) AS head, string_agg(line, chr(10) ORDER BY w.k) AS whole,
    coalesce(string_agg(line, chr(10) ORDER BY w.k) FILTER (NOT is_edge), '') AS inner_lines
  FROM (SELECT w.*, l.line, w.k = till OR w.k = min(w.k) OVER (PARTITION BY w.doc_id, e) AS is_edge FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.k = w.k WHERE mode IS NOT NULL AND mode <> 'drop') w
  GROUP BY 1, 2),
elements AS (
  SELECT doc_id, (e - 1)::INTEGER AS pos, type, CASE type WHEN 'heading' THEN {_strip(f"regexp_extract(head, '^(#{{1,6}}){_SPACE}+({_SOLID}.*)$', 2)")} WHEN 'code_block' THEN inner_lines
      WHEN 'horizontal_rule' THEN {_strip('head')} ELSE whole END AS content,
    CASE WHEN type = 'heading' THEN length(regexp_extract(head, '^(#{{1,6}})', 1))::INTEGER END AS level, CASE WHEN type = 'code_block' THEN nullif({_strip('head[4:]')}, '') END AS language
  FROM grouped)"""

_SECTIONS = f"""{_ELEMENTS},
headed AS (SELECT *, (count(*) FILTER (type = 'heading') OVER so_far)::INTEGER AS section_ord, {', '.join(
    f"max(lpad(pos::VARCHAR, 8, '0') || content) FILTER (type = 'heading' AND level = {k}) OVER so_far AS h{k}" for k in range(1, 7)
)} FROM elements WINDOW so_far AS (PARTITION BY doc_id ORDER BY pos)),
sections AS (SELECT *, string_split(section_path, ' > ')[-1] AS parent_section FROM (
  SELECT doc_id, pos, type, content, level, language, section_ord, array_to_string(list_filter([{', '.join(
    f"CASE WHEN h{k} IS NOT NULL AND {' AND '.join([f'coalesce(h{k}[1:8] > h{j}[1:8], true)' for j in range(1, k)] or ['true'])} THEN h{k}[9:] END" for k in range(1, 7)
)}], lambda x: x IS NOT NULL), ' > ') AS section_path FROM headed WHERE type <> 'heading' AND section_ord > 0))"""

_MOST = 512
#: For each kind of special element: its type, what stands between its parts' pieces, the pieces, where it stays whole, and whether a header stands before each part or an oversized piece alone.
_KINDS = {
    "table": ("type = 'table'", "\n", f"SELECT id, k, l[k + 2] AS piece, l[1] || chr(10) || l[2] AS head FROM (SELECT id, l, unnest(range(1, len(l) - 1)) AS k FROM (SELECT id, {_TABLE_LINES} AS l FROM big))", f"len({_TABLE_LINES}) < 3", True, False),
    "code": ("type = 'code_block'", "\n", _UNNEST.format("string_split(content, chr(10))"), "false", False, False),
    "list": ("type = 'list'", "\n", _UNNEST.format(_ITEMS), f"len({_ITEMS}) = 0", False, False),
    "text": ("type NOT IN ('table', 'code_block', 'list')", " ", _UNNEST.format(_SENTENCES.format("content")), f"len({_SENTENCES.format('content')}) = 0", False, True),
}


def _cut(name: str) -> str:
    """The parts of the oversized special elements of one kind."""
    of_type, joiner, pieces, stays, header, alone = _KINDS[name]
    rows = f"big AS (SELECT id, content FROM buffered WHERE special AND {of_type} AND length(content) // 4 > {_MOST} AND NOT ({stays})),\n{_folded(pieces, joiner, _MOST, header, alone)}"
    return re.sub(r"\b(big|pieces|fold|packed)\b", rf"\1_{name}", rows)


_CHUNKED = f"""{_SECTIONS},
sized AS (SELECT *, length(content) // 4 AS tokens, length(content) // 4 > {_MOST} OR type IN ('code_block', 'table') AS special,
    row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY pos) AS n
  FROM (SELECT *, {_TOKENS} FROM sections) WHERE NOT coalesce({_IS_NOISE}, false)),
filled AS (
  SELECT doc_id, section_ord, 0::BIGINT AS n, 0 AS own, 0 AS buffer, 0::BIGINT AS t FROM (SELECT DISTINCT doc_id, section_ord FROM sized)
  UNION ALL
  SELECT s.doc_id, s.section_ord, s.n, CASE WHEN s.special OR f.t + s.tokens > {_MOST} THEN f.buffer + 1 ELSE f.buffer END,
    CASE WHEN s.special OR f.t + s.tokens > {_MOST} THEN f.buffer + 1 ELSE f.buffer END + CASE WHEN s.special THEN 1 ELSE 0 END,
    CASE WHEN s.special THEN 0 WHEN f.t + s.tokens <= {_MOST} THEN f.t + s.tokens ELSE s.tokens END
  FROM filled f JOIN sized s ON s.doc_id = f.doc_id AND s.section_ord = f.section_ord AND s.n = f.n + 1),
buffered AS (
  SELECT doc_id || ':' || section_ord || ':' || min(pos) AS id, doc_id, section_ord, min(pos) AS pos, any_value(section_path) AS section_path, any_value(parent_section) AS parent_section,
    bool_or(special) AS special, first(type ORDER BY pos) AS type, first(language ORDER BY pos) AS language, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content
  FROM sized s JOIN filled f USING (doc_id, section_ord, n) GROUP BY doc_id, section_ord, own),
{', '.join(map(_cut, _KINDS))},
cuts AS (
  SELECT id, 1 AS part, 1 AS parts, content, length(content) // 4 AS token_count FROM buffered WHERE NOT special OR length(content) // 4 <= {_MOST}
    OR {' OR '.join(f"({of_type} AND {stays})" for of_type, _, _, stays, _, _ in _KINDS.values())}
  {' '.join(f"UNION ALL SELECT id, k, len(parts), parts[k].c, parts[k].t FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS k FROM packed_{name})" for name in _KINDS)}),
chunked AS (
  SELECT doc_id, section_ord, pos, part::INTEGER AS part, parts::INTEGER AS parts, c.content, token_count::INTEGER AS token_count,
    CASE WHEN NOT special THEN 'text' WHEN type = 'table' THEN 'table' WHEN type = 'code_block' THEN 'code_' || coalesce(language, 'unknown') WHEN type = 'list' THEN 'list' ELSE 'text' END AS chunk_type,
    section_path, parent_section
  FROM cuts c JOIN buffered b USING (id)),
linked AS (
  SELECT md5(doc_id || '/' || chunk_ord) AS id, doc_id, chunk_ord, content, token_count, chunk_type, parent_section, section_path,
    CASE WHEN parts > 1 THEN part || '/' || parts END AS split_sequence, CASE WHEN parts > 1 AND part < parts THEN md5(doc_id || '/' || (chunk_ord + 1)) END AS next_chunk_id,
    CASE WHEN parts > 1 AND part > 1 THEN md5(doc_id || '/' || (chunk_ord - 1)) END AS prev_chunk_id
  FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, pos, part))::INTEGER AS chunk_ord FROM chunked))"""

_OVERLAPPED = f"""{_CHUNKED},
spaced AS (SELECT *, min(chunk_ord) OVER (PARTITION BY doc_id, section_path) AS group_ord, CASE WHEN chunk_type <> 'table' AND safe > 0 THEN before END AS given FROM (
  SELECT *, lag(content) OVER (PARTITION BY doc_id, section_path ORDER BY chunk_ord) AS before, least(50, {_MOST} - 10 - token_count) AS safe FROM linked)),
ends AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS suffix FROM (
    SELECT *, sum(t) OVER (PARTITION BY id ORDER BY i DESC) AS c FROM (
      SELECT id, safe, i, s[i] AS x, length(s[i]) // 4 AS t FROM (SELECT id, safe, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, safe, {_SENTENCES.format('given')} AS s FROM spaced WHERE given IS NOT NULL))))
  WHERE c - t < safe AND (c - t = 0 OR c <= 1.5 * safe) GROUP BY 1),
lengthened AS (SELECT s.*, CASE WHEN length(suffix || chr(10) || chr(10) || content) // 4 <= {_MOST} THEN suffix || chr(10) || chr(10) || content END AS longer FROM spaced s LEFT JOIN ends USING (id))"""

SQL = {
    "dense_topk": _ranked("""
  SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(array_cosine_similarity(q.embedding::DOUBLE[64], p.embedding::DOUBLE[64]), 6) AS score
  FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0"""),
    "dense_topk_points": f"WITH {_POINTS} {_DENSE}",
    "sparse_topk_points": f"WITH {_POINTS}, {_POSTINGS} {_SPARSE}",
    "markdown_elements": f"WITH RECURSIVE {_ELEMENTS} SELECT * FROM elements",
    "element_stats": f"""WITH RECURSIVE {_ELEMENTS}
SELECT doc_id, pos, type, len(l) AS lines, CASE WHEN type = 'table' THEN len(string_split(regexp_replace(l[1], '^\\s*\\||\\|\\s*$', '', 'g'), '|')) ELSE len(list_filter(l, lambda x: regexp_matches(x, '^\\s*([-*+] |\\d+\\.\\s)'))) END AS parts
FROM (SELECT *, string_split(content, chr(10)) AS l FROM elements WHERE type IN ('table', 'list'))""",
    "section_paths": f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, pos, type, section_ord, section_path, parent_section FROM sections",
    "chunk_document": f"WITH RECURSIVE {_CHUNKED} SELECT * FROM chunked",
    "chunk_links": f"WITH RECURSIVE {_CHUNKED} SELECT * FROM linked",
    "chunk_overlap": f"""WITH RECURSIVE {_OVERLAPPED}
SELECT id, doc_id, chunk_ord, coalesce(longer, content) AS content, coalesce(length(longer) // 4, token_count)::INTEGER AS token_count, chunk_type, parent_section, section_path, split_sequence, next_chunk_id, prev_chunk_id,
  (row_number() OVER (PARTITION BY doc_id ORDER BY group_ord, chunk_ord))::INTEGER AS emit_ord FROM lengthened""",
    "sparse_postings": _lexical("documents", "doc_id"),
    "sparse_topk": f"WITH d AS ({_lexical('documents', 'doc_id')}), q AS ({_lexical('benchmark', 'item_id')}) "
    + _ranked("SELECT item_id AS query_id, doc_id AS point_id, round(sum(q.weight * d.weight), 6) AS score FROM q JOIN d USING (term) WHERE item_id % 50 = 0 GROUP BY 1, 2"),
    "rrf_fusion": f"WITH {_POINTS}, {_POSTINGS}, dense AS ({_DENSE}), sparse AS ({_SPARSE}) {_FUSED}",
    "rerank_lexical": f"WITH {_HYBRID} SELECT query_id, point_id, rank, rerank_score, rerank FROM found",
    "hybrid_search": f"""WITH {_HYBRID}
SELECT a.query_id, coalesce(string_agg(f.content, {_text(SEPARATOR)} ORDER BY f.rerank), {_text(NO_RESULTS)}) AS context, count(f.point_id) AS n
FROM asked a LEFT JOIN found f USING (query_id) GROUP BY 1""",
    "collection_topk": f"""WITH {_POINTS}
SELECT query_id, point_id, score, rank, collection_name FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (
    SELECT q.point_id AS query_id, p.point_id, q.collection_name, round(array_cosine_similarity(q.dense::DOUBLE[64], p.dense::DOUBLE[64]), 6) AS score
    FROM points_now q JOIN points_now p USING (collection_name) WHERE q.point_id % 50 = 0)) WHERE rank <= 5""",
    "context_sections": f"""WITH {_HYBRID}
SELECT query_id, string_agg('Section: ' || coalesce(section_path, 'unknown') || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY rerank) AS combined
FROM found GROUP BY 1""",
    "empty_result_message": f"""WITH {_PAGED}
SELECT r.request_id AS query_id, coalesce(string_agg(n.title, {_text(SEPARATOR)} ORDER BY s.rank), {_text(NO_RESULTS)}) AS context, count(s.result_id) AS n
FROM search_requests r LEFT JOIN shown s USING (request_id) LEFT JOIN normal n ON n.result_id = s.result_id GROUP BY 1""",
    "compress_targets": "SELECT doc_id, length(text) // 4 AS tokens, least(length(text) // 4 // 2, 256) AS by_ratio, 200 AS by_limit FROM documents WHERE text IS NOT NULL",
    "vector_dims": """WITH t AS (SELECT count(DISTINCT i) AS terms FROM (SELECT unnest(sparse.indices) AS i FROM points))
SELECT coalesce(len(dense), -1) AS dims, count(*) AS points, any_value(terms) AS terms FROM points, t GROUP BY 1""",
    "vector_join_check": f"""WITH {_POINTS}, c AS (SELECT DISTINCT id, document_id FROM chunks), u AS (SELECT DISTINCT document_id, collection_name FROM uploads)
SELECT collection_name, count(*) AS chunks, count(s.chunk_id) AS stored
FROM c LEFT JOIN (SELECT DISTINCT chunk_id FROM points_now) s ON s.chunk_id = c.id LEFT JOIN u USING (document_id) GROUP BY 1""",
    "token_count": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "truncate_batch": "SELECT doc_id, md5(CASE WHEN length(text) // 4 > 128 THEN text[1:512] ELSE text END) AS truncated_md5 FROM documents",
    "truncation_stats": "SELECT source, count(*) AS docs, count_if(length(text) // 4 > 512)::BIGINT AS truncated, coalesce(bool_or(length(text) // 4 > 512), false) AS any_truncated FROM documents GROUP BY 1",
    "sentence_split": f"SELECT doc_id, k - 1 AS pos, md5(s[k]) AS sentence_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents WHERE text IS NOT NULL))",
    "sentence_stats": f"SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {_SENTENCES.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM documents)",
    "metadata_noise": _NOISE,
    "point_ids": "SELECT DISTINCT id, ('0x' || md5(id)[1:15])::BIGINT AS point_id FROM chunks",
    "text_split_greedy": _split("SELECT doc_id AS id, text AS content FROM documents WHERE text IS NOT NULL", _UNNEST.format(_SENTENCES.format("content")), f"len({_SENTENCES.format('content')}) = 0", " ", 128, "doc_id", alone=True),
    "table_split": _split(_of_type("table"), f"SELECT id, k, l[k + 2] AS piece, l[1] || chr(10) || l[2] AS head FROM (SELECT id, l, unnest(range(1, len(l) - 1)) AS k FROM (SELECT id, {_TABLE_LINES} AS l FROM big))", f"len({_TABLE_LINES}) < 3", "\n", 64, "id", header=True),
    "code_split": _split(_of_type("code"), _UNNEST.format("string_split(content, chr(10))"), "false", "\n", 64, "id"),
    "list_split": _split(_of_type("list"), _UNNEST.format(_ITEMS), f"len({_ITEMS}) = 0", "\n", 64, "id"),
    "compress_extractive": """
WITH w AS (SELECT doc_id, l[k] AS word, k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))),
n AS (SELECT lower(word) AS w, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT doc_id, word, k, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM w JOIN n ON n.w = lower(word))
SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS compressed, any_value(total) AS words_before, count(*) AS words_after, round(count(*) / any_value(total), 6) AS ratio
FROM r WHERE r <= floor(total * 0.5) GROUP BY 1""",
    "query_embeddings": f"""
WITH p AS (SELECT request_id, ('0x' || md5(w)[1:8])::BIGINT % 64 AS place FROM (SELECT request_id, unnest({_WORDS.format('query_text')}) AS w FROM search_requests WHERE query_text IS NOT NULL)),
c AS (SELECT request_id, place, count(*) AS n FROM p GROUP BY 1, 2)
SELECT request_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY request_id)), 6) AS value FROM c""",
    "chunk_states": f"""WITH {_CHUNKS}
SELECT id, document_id, lower(chunk_type) AS chunk_type, length(content) // 4 AS tokens, token_count IS DISTINCT FROM length(content) // 4 AS stale,
  try_cast(nullif(regexp_extract(split_sequence, '^(\\d+)/(\\d+)$', 1), '') AS INTEGER) AS part, try_cast(nullif(regexp_extract(split_sequence, '^(\\d+)/(\\d+)$', 2), '') AS INTEGER) AS parts
FROM chunks_now""",
    "chunk_neighbours": f"""WITH {_CHUNKS}
SELECT c.id, c.next_chunk_id, CASE WHEN n.prev_chunk_id = c.id THEN 'mutual' WHEN n.prev_chunk_id IS NULL THEN 'dangling' ELSE 'other' END AS link
FROM chunks_now c LEFT JOIN chunks_now n ON n.id = c.next_chunk_id WHERE c.next_chunk_id IS NOT NULL""",
    "upload_summary": f"""WITH {_CHUNKS}, h AS (SELECT document_id, count(*) AS chunks, sum(length(coalesce(content, '')))::BIGINT AS chars FROM chunks_now GROUP BY 1)
SELECT document_id, collection_name, coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars,
  coalesce(ends_with(lower(filename), '.md'), false) AS is_markdown, coalesce(ends_with(lower(filename), '.pdf'), false) AS is_pdf
FROM uploads LEFT JOIN h USING (document_id)""",
    "bang_route": f"WITH {_ROUTED} SELECT request_id, bang, query, category, array_to_string(engines, ',') AS engines, error FROM routed",
    "request_validation": f"WITH {_ROUTED} SELECT request_id, reasons, reasons = '' AS is_valid FROM judged",
    "error_status": f"WITH {_ROUTED} SELECT request_id, CASE WHEN reasons <> '' THEN 422 WHEN error IS NOT NULL THEN 400 ELSE 200 END AS status FROM judged",
    "engine_parameters": f"""WITH {_ROUTED}
SELECT request_id, query AS q, per_page, CASE WHEN NOT unpaged THEN page END AS pageno, category AS categories, time_range, array_to_string(engines, ',') AS engines FROM valid""",
    "result_normalise": f"""WITH {_ROUTED}, {_NORMAL}
SELECT n.result_id, request_id, n.title, n.url, md5(n.content) AS content, n.engine, round(n.score, 6) AS score, CASE WHEN s.category <> '' THEN s.category ELSE coalesce(r.category, 'general') END AS category
FROM normal n JOIN (SELECT DISTINCT result_id, category FROM search_results) s USING (result_id) LEFT JOIN routed r USING (request_id)""",
    "request_bodies": """
SELECT request_id, '{"query":' || to_json(query_text) || coalesce(',"page":' || page, '') || coalesce(',"per_page":' || per_page, '')
  || CASE WHEN category <> '' THEN ',"category":' || to_json(category) ELSE '' END || CASE WHEN len(engines) > 0 THEN ',"engines":' || to_json(engines) ELSE '' END || '}' AS body
FROM search_requests WHERE query_text IS NOT NULL""",
    "result_scores": f"WITH {_NORMAL} SELECT result_id, engine, (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') AS shown FROM (SELECT result_id, engine, floor(score * 100 + 0.5)::BIGINT AS h FROM normal)",
    "upload_results": """
SELECT document_id, collection_name, count(*) AS points, true AS success FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY upserted_at DESC, document_id DESC, collection_name DESC) AS rn FROM points)
WHERE rn = 1 AND document_id IS NOT NULL GROUP BY 1, 2""",
    "collection_scan": f"""WITH {_POINTS}
SELECT point_id, collection_name, chunk_id, len(dense) AS dims FROM points_now WHERE collection_name = (SELECT min(collection_name) FROM points)""",
    "search_answers": f"""WITH {_HYBRID}
SELECT query_id, '{{"query":' || to_json(query) || ',"collection_name":"documents","context":' || to_json(context) || ',"limit":10}}' AS response FROM (
  SELECT a.query_id, a.query, coalesce(string_agg(f.content, {_text(SEPARATOR)} ORDER BY f.rerank), {_text(NO_RESULTS)}) AS context
  FROM asked a LEFT JOIN found f USING (query_id) GROUP BY 1, 2)""",
    "payloads": f"""WITH {_POINTS}, {_CHUNKS}, j AS (
  SELECT p.point_id, p.collection_name, p.chunk_id, c.chunk_type, c.section_path, c.content FROM points_now p JOIN chunks_now c ON c.id = p.chunk_id)
SELECT point_id, content, '{{' || array_to_string(list_filter([
  '"chunk_id":' || to_json(chunk_id), '"collection_name":' || to_json(collection_name), '"chunk_type":' || to_json(chunk_type), '"section_path":' || to_json(section_path)], lambda x: x IS NOT NULL), ',') || '}}' AS metadata
FROM j""",
    "websearch_page": f"WITH {_PAGED} SELECT request_id, rank, result_id, round(score, 6) AS score FROM shown",
    "websearch_meta": f"WITH {_PAGED} SELECT * FROM meta",
    "page_bar": f"""WITH {_PAGED}
SELECT request_id, greatest(ceil(number_of_results / 10), 1)::INTEGER AS total_pages, (page - 1) * 10 + 1 AS first, least(page * 10, number_of_results) AS last,
  array_to_string(range(CASE WHEN page <= 2 THEN 1 ELSE page - 1 END, CASE WHEN page <= 2 THEN 4 ELSE page + 2 END), ',') AS visible FROM meta""",
    "catalog_use": f"""WITH {_BANGS}, {_NORMAL}, c(category, description) AS (VALUES {', '.join(f'({_text(c)}, {_text(t)})' for c, t, _ in CATEGORIES)}),
e AS (SELECT category, engine, bang FROM bangs WHERE engine IS NOT NULL), n AS (SELECT engine, count(*) AS n FROM normal GROUP BY 1)
SELECT c.category, c.description, string_agg(e.engine, ',' ORDER BY e.engine) AS engines, string_agg(e.bang, ',' ORDER BY e.bang) AS bangs, coalesce(sum(n.n), 0)::BIGINT AS results
FROM c JOIN e USING (category) LEFT JOIN n USING (engine) GROUP BY 1, 2""",
    "bang_use": f"""WITH {_ROUTED}, u AS (SELECT bang, count(*) AS requests FROM parsed WHERE bang IS NOT NULL GROUP BY 1)
SELECT bang, name, engine, category, coalesce(requests, 0) AS requests FROM bangs FULL JOIN u USING (bang)""",
    "engine_union": f"WITH {_NORMAL} SELECT request_id, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, count(*) AS results, round(max(score), 6) AS best FROM normal GROUP BY 1",
    "gap_between_requests": """
SELECT event_id, user_id, round(g, 6) AS gap, round(greatest(3600 - coalesce(g, 3600), 0), 6) AS wait FROM (
  SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS g FROM events)""",
    "retry_waits": "SELECT user_id, n AS attempts, pow(2, n) - 1 AS total FROM (SELECT user_id, least(count_if(event_type = 'error'), 5)::INTEGER AS n FROM events GROUP BY 1)",
    "export_filenames": r"""
WITH u AS (SELECT DISTINCT result_id, coalesce(url, '') AS url FROM search_results),
p AS (SELECT result_id, url, CASE WHEN h = '' THEN 'unknown' ELSE h END AS host,
  regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '^/+|/+$', '', 'g') AS path
  FROM (SELECT *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS h FROM u)),
n AS (SELECT result_id, CASE WHEN l <> '' AND length(host || '_' || l) <= 100 THEN host || '_' || l ELSE host END AS name
  FROM (SELECT *, string_split(path, '/')[-1] AS l FROM p)),
b AS (SELECT result_id, '20260130_194536_' || CASE WHEN s IN ('', '_') THEN 'exported_content' ELSE s END AS base
  FROM (SELECT result_id, regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g')[1:100], '[. ]+$', '') AS s FROM n))
SELECT result_id, base || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.md' AS file
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY result_id) - 1 AS k FROM b)""",
    "result_arrivals": """
SELECT time_bucket(INTERVAL 1 DAY, ingested_at) AS day, lower(engine) AS engine, count(*) AS results
FROM (SELECT DISTINCT result_id, ingested_at, engine FROM search_results) WHERE ingested_at IS NOT NULL GROUP BY 1, 2""",
    "late_results": """
SELECT host, count(*) AS results, count_if(ingested_at - fetched_at > INTERVAL 24 HOUR)::BIGINT AS late, max(fetched_at) AS newest
FROM (SELECT DISTINCT result_id, host, fetched_at, ingested_at FROM search_results) GROUP BY 1""",
    "best_result": f"""WITH {_NORMAL}
SELECT request_id, engine, result_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, engine ORDER BY score DESC, result_id) AS n FROM normal) WHERE n = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
