"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from provenant.functions import text as fn
from provenant.operators import answer, evaluate, retrieve, segment, verify

from . import tables
from .registry import MARKED


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A string literal of a pattern."""
    return f"$rx${pattern}$rx$"


def norm(x: str) -> str:
    """Text as quotations are compared."""
    return f"translate(regexp_replace({x}, '[\\s　]+', '', 'g'), {lit(fn.UNIFY_FROM)}, {lit(fn.UNIFY_TO)})"


GRAMS = r"""list_distinct(list_transform(range(1, length({s}) - 4), lambda i: substring({s}, i, 6)))"""
BARE = "regexp_replace(coalesce(text, ''), " + rx(fn.SHINGLE_DROPS.removeprefix("(?U)").replace(r"\s", r"\s　")) + ", '', 'g')"

# Shingles of documents and items, and pairs by containment, by brute force.
SH = f"""sd AS (SELECT doc_id AS id, unnest(g) AS t, len(g) AS n FROM (SELECT doc_id, {GRAMS.format(s='s')} AS g FROM (SELECT doc_id, {BARE} AS s FROM documents))),
sb AS (SELECT item_id AS id, unnest(g) AS t, len(g) AS n FROM (SELECT item_id, {GRAMS.format(s='s')} AS g FROM (SELECT item_id, {BARE} AS s FROM benchmark)))"""
PAIRS = f"""{SH}, pairs AS (SELECT a, b, shared, shared / least(na, nb) AS sim FROM (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM sd x JOIN sd y ON x.t = y.t AND x.id < y.id GROUP BY ALL) WHERE 5 * shared >= 4 * least(na, nb))"""
CONTAINED = f"""{SH}, contained AS (SELECT doc_id, item_id, shared, shared / least(na, nb) AS sim FROM (SELECT x.id AS doc_id, y.id AS item_id, x.n AS na, y.n AS nb, count(*) AS shared FROM sd x JOIN sb y USING (t) GROUP BY ALL) WHERE 5 * shared >= 4 * least(na, nb))"""

JUNKED = " OR ".join(f"regexp_matches(x, {rx(p)})" for p in tables.JUNK)
CLEAN = f"""SELECT doc_id, len(l) AS n_lines, len(k) AS n_kept, md5(array_to_string(k, chr(10))) AS kept_md5
FROM (SELECT doc_id, l, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, {rx(tables.TAIL)}, ''))), lambda x: NOT ({JUNKED})) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def running(lines: str, doc: str, page: str, share: float) -> str:
    """Lines on enough pages of a document."""
    return f"""WITH l AS ({lines}), p AS (SELECT {doc}, count(DISTINCT {page}) AS n_pages FROM l GROUP BY 1),
c AS (SELECT {doc}, text, count(DISTINCT {page}) AS n_pages_with FROM l WHERE length(text) >= 6 AND NOT regexp_matches(text, '^\\d+$') GROUP BY 1, 2)
SELECT {doc}, text, n_pages_with, n_pages FROM c JOIN p USING ({doc}) WHERE n_pages >= 3 AND n_pages_with >= greatest(3, {share} * n_pages)"""


RUNNING = running("SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text FROM documents", "source", "doc_id", 0.05)
BOILER = running(
    f"""SELECT site, page_id, t AS text FROM (SELECT regexp_extract(url, '^https?://[^/?#]*?([^./?#]+[.][a-z]+)([/?#]|$)', 1) AS site, page_id,
  trim(unnest(string_split(regexp_replace(regexp_replace(html, {rx(tables.SCRIPTS)}, '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)))) AS t FROM pages) WHERE t <> ''""",
    "site",
    "page_id",
    0.02,
)
LEVEL = f"""SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(url, {rx(p)}) THEN {lit(v)}" for p, v in tables.URL_LEVELS)} ELSE 'other' END AS level FROM pages"""
NORMAL = f"SELECT doc_id, length(x) AS n, md5(x) AS normalized_md5 FROM (SELECT doc_id, {norm('text')} AS x FROM documents)"
IDS = """WITH u AS (SELECT DISTINCT url AS path FROM pages), r AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM u WHERE path LIKE 'https:%'),
w AS (SELECT path, (SELECT coalesce(max(n), 0) FROM r) + row_number() OVER (ORDER BY path) AS n FROM u WHERE path NOT LIKE 'https:%')
SELECT path, 'PUB-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS doc_id FROM (SELECT * FROM r UNION ALL SELECT * FROM w)"""
SHINGLES = f"SELECT doc_id, len({GRAMS.format(s='s')}) AS n_shingles FROM (SELECT doc_id, {BARE} AS s FROM documents)"
NEAR = f"WITH {PAIRS} SELECT a, b, shared, round(sim, 6) AS sim FROM pairs"
SURVIVE = f"""WITH RECURSIVE {PAIRS}, d AS (SELECT doc_id, lang, length(source) AS n FROM documents),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS k, a, b, (x.lang, x.n) <= (y.lang, y.n) AS first FROM pairs JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL
  SELECT p.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone WHEN first THEN list_append(gone, b) ELSE list_append(gone, a) END FROM r JOIN p ON p.k = r.k + 1),
e AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1)
SELECT doc_id, NOT list_contains(gone, doc_id) AS survives FROM documents, e"""
CONTAIN = f"WITH {CONTAINED} SELECT doc_id, item_id, shared, round(sim, 6) AS sim FROM contained"


def packed(sizes: str) -> str:
    """Numbers of the packs that greedy filling puts sizes in."""
    state = f"list_transform({sizes}, lambda n: {{'p': -1, 'room': CAST(n AS INTEGER), 'got': CAST([] AS INTEGER[])}})"
    opens = "(z.p < 0 OR x.room > z.room)"
    step = f"""{{'p': CASE WHEN {opens} THEN z.p + 1 ELSE z.p END, 'room': CASE WHEN {opens} THEN {segment.PACK} ELSE z.room END - x.room, 'got': list_append(z.got, CASE WHEN {opens} THEN z.p + 1 ELSE z.p END)}}"""
    return f"list_reduce({state}, lambda z, x: {step}, {{'p': -1, 'room': 0, 'got': CAST([] AS INTEGER[])}}).got"


SEGMENT = f"""WITH l AS (SELECT doc_id, pos, length(t) AS size, sum(CASE WHEN regexp_matches(t, {rx(tables.MARKER)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g
  FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
g AS (SELECT doc_id, g, list(size ORDER BY pos) AS sizes, list(pos ORDER BY pos) AS ps FROM l GROUP BY ALL),
u AS (SELECT doc_id, g, unnest(sizes) AS size, unnest(ps) AS pos, unnest(CASE WHEN list_sum(sizes) <= {segment.PACK} THEN list_transform(sizes, lambda s: 0) ELSE {packed('sizes')} END) AS part FROM g),
v AS (SELECT doc_id, list(size ORDER BY g, part) AS units FROM (SELECT doc_id, g, part, sum(size)::INTEGER AS size FROM u GROUP BY ALL) GROUP BY 1),
w AS (SELECT doc_id, len(units) AS n_units, unnest(units) AS size, unnest({packed('units')}) AS pack FROM v)
SELECT doc_id, n_units, string_agg(CAST(size AS VARCHAR), ',' ORDER BY pack) AS chunk_sizes FROM (SELECT doc_id, n_units, pack, sum(size) AS size FROM w GROUP BY ALL) GROUP BY 1, 2"""
CITE = """WITH l AS (SELECT doc_id, lang, source, pos AS line_no, regexp_extract(t, '^([^ ]*)', 1) AS label FROM (SELECT doc_id, lang, source, unnest(l) AS t, unnest(range(len(l))) AS pos FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY line_no) AS n, line_no // 10 + 1 AS page FROM l)
SELECT doc_id, line_no, doc_id || '#' || label || CASE WHEN n > 1 THEN '(' || n || ')' ELSE '' END AS chunk_id,
  concat_ws(' ', '《' || source || '》', nullif(lang, ''), nullif(CASE WHEN label = 'The' THEN label || '【article】' ELSE label END, ''), CASE WHEN line_no % 2 = 0 THEN '第' || page || '页' ELSE '第' || page || '-' || (page + 1) || '页' END) AS citation FROM n"""
REPORT = """WITH k AS (SELECT source, lang, count(*) AS n, max(length(text)) AS longest FROM documents GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS n_chunks, string_agg(lang || ':' || n, ',' ORDER BY lang) AS kinds, max(longest) AS longest, string_agg(lang, ',' ORDER BY lang) AS titles FROM k GROUP BY 1"""

USERS = "users AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"
GLOSSARY = "glossary AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lit(p)}, {lit(t)})" for i, (p, t) in enumerate(tables.GLOSSARY)) + ") g(ord, pattern, terms))"
RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(p)}, {lit(t)}, {lit(a)})" for p, t, a in tables.REQUIRED) + ") r(pattern, lang, source))"
EXPAND = f"""WITH {USERS}, {GLOSSARY}, h AS (SELECT query_id, string_agg(terms, '；' ORDER BY ord) AS t FROM users JOIN glossary ON regexp_matches(text, '(?i)' || pattern) GROUP BY 1)
SELECT query_id, CASE WHEN t IS NULL THEN text ELSE text || '（相关概念：' || t || '）' END AS expanded FROM users LEFT JOIN h USING (query_id)"""
REQUIRE = f"WITH {USERS}, {RULES} SELECT DISTINCT query_id, doc_id AS chunk_id FROM users JOIN rules ON regexp_matches(text, pattern) JOIN documents USING (lang, source)"
DEFINE = f"""WITH t AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, {rx(tables.TERMS)}, 1)) AS term FROM documents),
u AS (SELECT source, term, avg(CASE WHEN contains(text, term) THEN 1.0 ELSE 0.0 END) AS usage FROM (SELECT DISTINCT source, term FROM t) JOIN documents USING (source) GROUP BY 1, 2)
SELECT source, doc_id, term, round(usage, 6) AS usage FROM t JOIN u USING (source, term) WHERE usage <= 0.2 AND length(term) >= 2"""
CASES = r"""WITH f AS (SELECT conv_id, string_agg('【' || role || '】' || text, chr(10) ORDER BY turn) AS full_text, min(turn) + 1 AS a, max(turn) + 1 AS b, min_by(role, turn) AS role FROM conversations GROUP BY 1),
l AS (SELECT conv_id, trim(unnest(string_split(full_text, chr(10)))) AS line, unnest(range(len(string_split(full_text, chr(10))))) AS pos FROM f),
s AS (SELECT conv_id, pos, last_value(CASE WHEN regexp_matches(line, '^【[^】]{2,12}】') THEN regexp_extract(line, '^【([^】]{2,12})】', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS section, trim(regexp_replace(line, '^【[^】]{2,12}】\s*', '')) AS rest FROM l WHERE line <> ''),
g AS (SELECT conv_id, section, md5(string_agg(rest, chr(10) ORDER BY pos)) AS section_md5 FROM s WHERE rest <> '' GROUP BY 1, 2)
SELECT 'talk#' || conv_id AS case_id, 'Talk ' || conv_id AS title, '《Talks》 Talk ' || conv_id || CASE WHEN a = b THEN ' 第' || a || '页' ELSE ' 第' || a || '-' || b || '页' END AS citation, md5(full_text) AS full_md5, section, section_md5 FROM f JOIN g USING (conv_id)"""

DENSE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30"""

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '(\p{L}+)', 1)"
LAW, CASE = f"doc_type <> '{tables.CASE_LANG}'", f"doc_type = '{tables.CASE_LANG}'"


def ranking(name: str, tokens: str, side: str) -> str:
    """The best 30 chunks by shared tokens."""
    return f"""{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM
  (SELECT query_id, chunk_id, sum(q.weight * d.weight)::BIGINT AS score FROM q{tokens} q JOIN d{tokens} d USING (token) WHERE {side} GROUP BY 1, 2) QUALIFY rank <= 30)"""


def fused(name: str, dense: str, sparse: str) -> str:
    """Two rankings in one."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM
  (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1 / (60.0::DOUBLE + d.rank), 0) + coalesce(1 / (60.0::DOUBLE + s.rank), 0) AS rrf FROM {dense} d FULL JOIN {sparse} s USING (query_id, chunk_id)))"""


CORPUS = f"""chunks AS (SELECT doc_id AS chunk_id, lang AS doc_type, source, text, {WORDS} AS w, {BARE} AS s FROM documents),
items AS (SELECT item_id AS query_id, text, {WORDS} AS w, {BARE} AS s FROM benchmark),
qw AS (SELECT query_id, token, count(*) AS weight FROM (SELECT query_id, unnest(w) AS token FROM items) GROUP BY 1, 2),
dw AS (SELECT chunk_id, doc_type, token, count(*) AS weight FROM (SELECT chunk_id, doc_type, unnest(w) AS token FROM chunks) GROUP BY 1, 2, 3),
qg AS (SELECT query_id, unnest({GRAMS.format(s='s')}) AS token, 1 AS weight FROM items),
dg AS (SELECT chunk_id, doc_type, unnest({GRAMS.format(s='s')}) AS token, 1 AS weight FROM chunks),
{ranking('lex', 'w', LAW)}, {ranking('gram', 'g', LAW)}, {ranking('clex', 'w', CASE)}, {ranking('cgram', 'g', CASE)}, {fused('fused', 'gram', 'lex')}, {fused('cfused', 'cgram', 'clex')}"""
SCORE = "coalesce(len(list_intersect(list_distinct(q.w), list_distinct(d.w))) / nullif(len(list_distinct(q.w)), 0), 0.0)"
SEARCH = f"""{CORPUS}, {RULES},
pinned AS (SELECT query_id, chunk_id FROM items JOIN chunks ON query_id = chunk_id WHERE {LAW}),
required AS (SELECT DISTINCT query_id, chunk_id FROM items i JOIN rules r ON regexp_matches(i.text, pattern) JOIN chunks c ON c.doc_type = r.lang AND c.source = r.source),
pool AS (SELECT query_id, chunk_id, p.chunk_id IS NOT NULL AS pinned, r.chunk_id IS NOT NULL AS required, f.dense_rank, f.sparse_rank,
  CASE WHEN p.chunk_id IS NOT NULL THEN 0 WHEN f.fused_rank <= {retrieve.POOL} THEN 1 ELSE 2 END AS part, CASE WHEN p.chunk_id IS NULL AND f.fused_rank <= {retrieve.POOL} THEN f.fused_rank ELSE 0 END AS place
  FROM (SELECT query_id, chunk_id FROM pinned UNION SELECT query_id, chunk_id FROM required UNION SELECT query_id, chunk_id FROM fused WHERE fused_rank <= {retrieve.POOL}) x
  LEFT JOIN pinned p USING (query_id, chunk_id) LEFT JOIN required r USING (query_id, chunk_id) LEFT JOIN fused f USING (query_id, chunk_id)),
scored AS (SELECT p.*, d.doc_type, {SCORE} AS score FROM pool p JOIN items q USING (query_id) JOIN chunks d USING (chunk_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score DESC, part, place, chunk_id) AS o FROM scored),
capped AS (SELECT * FROM (SELECT *, doc_type = '{tables.CAPPED_LANG}' AND NOT required AS c, row_number() OVER (PARTITION BY query_id, doc_type = '{tables.CAPPED_LANG}' AND NOT required ORDER BY o) AS n FROM ordered) WHERE NOT c OR n <= {retrieve.INTERPRETATIONS}),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS k FROM capped) WHERE k <= {retrieve.TOP_K} OR required),
kw AS (SELECT source AS case_id, list(DISTINCT w) AS keywords FROM (SELECT source, lower(regexp_extract(text, '^(\\p{{L}}+)', 1)) AS w FROM chunks WHERE {CASE}) WHERE length(w) >= 4 GROUP BY 1),
cpool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS p FROM cfused) WHERE p <= {retrieve.CASE_POOL}),
cbest AS (SELECT * FROM (SELECT c.query_id, d.source AS case_id, c.chunk_id, q.text, {SCORE} AS score, row_number() OVER (PARTITION BY c.query_id, d.source ORDER BY {SCORE} DESC, p) AS b, min(p) OVER (PARTITION BY c.query_id, d.source) AS f FROM cpool c JOIN items q USING (query_id) JOIN chunks d USING (chunk_id)) WHERE b = 1),
cmatch AS (SELECT *, list_filter(coalesce(keywords, []), lambda k: contains(text, k)) AS matched FROM cbest LEFT JOIN kw USING (case_id)),
ccases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS case_rank FROM cmatch WHERE score >= {retrieve.CASE_SHOWN} OR (len(matched) > 0 AND score >= {retrieve.CASE_SHOWN_KEYWORD})) WHERE case_rank <= {retrieve.CASES}),
gate AS (SELECT query_id, greatest(coalesce(h.score, 0), coalesce(c.score, 0)) AS top_score, greatest(coalesce(h.score, 0), coalesce(c.score, 0)) >= {retrieve.GATE} AS has_evidence
  FROM items LEFT JOIN (SELECT query_id, score FROM hits WHERE hit_rank = 1) h USING (query_id) LEFT JOIN (SELECT query_id, score FROM ccases WHERE case_rank = 1) c USING (query_id)),
definitions AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS def_rank FROM fused f WHERE fused_rank > 24 AND NOT EXISTS (FROM hits h WHERE h.query_id = f.query_id AND h.chunk_id = f.chunk_id)) WHERE def_rank <= 2),
sources AS (SELECT query_id, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY p, r) AS source, chunk_id, tag FROM (
  SELECT query_id, chunk_id, 0 AS p, hit_rank AS r, '' AS tag FROM hits UNION ALL SELECT query_id, chunk_id, 1, def_rank, '{answer.DEFINITION_TAG}' FROM definitions UNION ALL SELECT query_id, chunk_id, 2, case_rank, '{answer.CASE_TAG}' FROM ccases WHERE case_rank <= {answer.CASES_GIVEN}))"""

FRAGMENT = "trim(trim({x}, " + lit(fn.EDGE_MARKS) + "), '\"''')"
CHECKED = f"""{SEARCH}, cites AS (SELECT query_id, unnest(range(6))::INTEGER AS ord, unnest(['S1', 'S2', 'S3', 'S4', 'S5', 'S99']) AS source, {FRAGMENT.format(x=norm("substring(text, 1, 40)"))} AS f1, {FRAGMENT.format(x=norm("substring(text, 61, 30)"))} AS f2 FROM items),
found AS (SELECT c.*, s.chunk_id, {norm('d.text')} AS body FROM cites c LEFT JOIN sources s USING (query_id, source) LEFT JOIN chunks d ON d.chunk_id = s.chunk_id),
checked AS (SELECT query_id, ord, source, chunk_id, valid, CASE WHEN chunk_id IS NULL THEN '{verify.NO_SOURCE}' WHEN NOT valid THEN '{verify.NOT_VERBATIM}' ELSE '' END AS reason FROM
  (SELECT *, coalesce(chunk_id IS NOT NULL AND length(f1) + length(f2) >= 6 AND (f1 = '' OR strpos(body, f1) > 0) AND (f2 = '' OR strpos(substring(body, CASE WHEN f1 = '' THEN 1 ELSE strpos(body, f1) + length(f1) END), f2) > 0), false) AS valid FROM found))"""
MARKS = ("S3", "S1", "S99", "S4")
SCRUBBED = lit(MARKED)
for _m in MARKS:
    SCRUBBED = f"CASE WHEN list_contains(good, '{_m}') THEN {SCRUBBED} ELSE replace({SCRUBBED}, '[{_m}]', '') END"
FINAL = "cleaned"
for _m in (*MARKS, "S2", "S5"):
    FINAL = f"replace({FINAL}, '[{_m}]', '[' || coalesce(CAST(list_position(refs, '{_m}') AS VARCHAR), '') || ']')"
SCRUB = f"""WITH {CHECKED}, g AS (SELECT query_id, coalesce(list(source) FILTER (valid), []) AS good, coalesce(list(source ORDER BY ord) FILTER (valid), []) AS cited FROM checked GROUP BY 1),
c AS (SELECT query_id, cited, {SCRUBBED} AS cleaned FROM g),
r AS (SELECT query_id, cleaned, list_concat(list_filter(['S3', 'S1', 'S99', 'S4'], lambda m: contains(cleaned, '[' || m || ']')), list_filter(cited, lambda m: NOT contains(cleaned, '[' || m || ']'))) AS refs FROM c)
SELECT query_id, cleaned, trim({FINAL}) AS final, array_to_string(refs, ',') AS "references" FROM r"""

MERGE = f"""WITH RECURSIVE {SEARCH}, m AS MATERIALIZED (SELECT query_id // 4 AS query_id, (query_id % 4)::INTEGER AS search_no, hit_rank, chunk_id, score FROM hits),
q4 AS (SELECT DISTINCT query_id FROM m),
r AS (SELECT query_id, -1 AS no, CAST([] AS BIGINT[]) AS got, CAST([] AS BIGINT[]) AS new FROM q4 UNION ALL
  SELECT r.query_id, r.no + 1, list_concat(r.got, x), x FROM r, LATERAL (SELECT list_slice(coalesce(list(chunk_id ORDER BY hit_rank), []), 1, CASE WHEN r.no = -1 THEN {answer.MAIN_QUOTA} ELSE {answer.SUB_QUOTA} END) AS x FROM m WHERE m.query_id = r.query_id AND m.search_no = r.no + 1 AND NOT list_contains(r.got, m.chunk_id)) WHERE r.no < 3),
owner AS (SELECT c.query_id, c.chunk_id, m.score, c.no * 100 + c.i AS i FROM (SELECT query_id, no, unnest(new) AS chunk_id, unnest(range(len(new))) AS i FROM r) c JOIN m ON m.query_id = c.query_id AND m.search_no = c.no AND m.chunk_id = c.chunk_id),
rest AS (SELECT query_id, chunk_id, score, search_no, hit_rank FROM m WHERE NOT EXISTS (FROM owner c WHERE c.query_id = m.query_id AND c.chunk_id = m.chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, search_no, hit_rank) = 1),
both_ AS (SELECT query_id, chunk_id, score, 0 AS part, i, 0 AS search_no, 0 AS hit_rank FROM owner UNION ALL SELECT query_id, chunk_id, score, 1, 0, search_no, hit_rank FROM rest),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, i, CASE WHEN part = 1 THEN -score END, search_no, hit_rank) AS merged_rank FROM both_)
SELECT query_id, chunk_id, round(score, 6) AS score, merged_rank FROM n WHERE merged_rank <= {answer.MOST_SOURCES}"""

PACK_TEXT = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\s　]+', '', 'g'), '(\d),(\d{3})', '\1\2', 'g'), '(\d),(\d{3})', '\1\2', 'g')"


def unmet(text: str, must: tuple[str, ...]) -> str:
    """Key points that a packed text lacks."""
    return "list_filter([" + ", ".join(lit(m) for m in must) + f"], lambda m: NOT list_bool_or(list_transform(string_split(m, '|'), lambda a: contains({text}, a))))"


KEYPOINTS = f"SELECT doc_id, array_to_string({unmet('t', tables.MUST)}, ',') AS missing FROM (SELECT doc_id, {PACK_TEXT} AS t FROM documents)"
INTENT = f"""WITH {USERS} SELECT query_id, CASE WHEN length(t) >= 10 AND regexp_matches(t, {rx(tables.PLANS)}) THEN 'scenario' ELSE 'qa' END AS intent FROM (SELECT query_id, regexp_replace(text, {rx(tables.ASKING)}, '', 'g') AS t FROM users)"""
LENGTH = """SELECT role AS type, coalesce(CAST(sum(length(text)) FILTER (given) // nullif(count(*) FILTER (given), 0) AS VARCHAR), '-') AS mean_length FROM (SELECT role, text, NOT regexp_matches(text, '^[AEIOU]') AND text <> '' AS given FROM conversations) GROUP BY 1"""

EVAL = f"""{SEARCH}, {CONTAINED.split(', contained AS', 1)[0]}, contained AS{CONTAINED.split(', contained AS', 1)[1]},
golds AS (SELECT item_id AS id, list(DISTINCT doc_id ORDER BY doc_id) AS gold FROM contained GROUP BY 1),
hl AS (SELECT query_id AS id, list(chunk_id ORDER BY hit_rank) AS main FROM hits GROUP BY 1),
cl AS (SELECT query_id AS id, list(case_id || '@' || case_rank ORDER BY case_id || '@' || case_rank) AS cases_shown FROM ccases GROUP BY 1),
base AS (SELECT i.query_id AS id, CASE WHEN i.query_id % 5 = 4 THEN 'out_of_kb' WHEN i.query_id % 5 = 3 THEN 'scenario' ELSE 'normal' END AS type, NOT g.has_evidence OR i.query_id % 7 = 0 AS refused, {PACK_TEXT.replace('text', 'i.text')} AS packed, i.text AS answer_text,
  coalesce(gold, []) AS gold, coalesce(main, []) AS main, coalesce(cases_shown, []) AS cases_shown, CASE WHEN i.query_id % 3 = 0 THEN true WHEN i.query_id % 3 = 1 THEN false END AS expect_case
  FROM items i JOIN gate g USING (query_id) LEFT JOIN golds ON golds.id = i.query_id LEFT JOIN hl ON hl.id = i.query_id LEFT JOIN cl ON cl.id = i.query_id),
more AS (SELECT *, CASE WHEN type = 'out_of_kb' THEN 'refuse' ELSE 'answer' END AS expect, CASE WHEN refused THEN 'no_evidence' ELSE '' END AS reason, CASE WHEN refused THEN [] ELSE main[1:3] END AS cited,
  CASE WHEN id % 4 = 1 THEN ['S1 x'] ELSE [] END AS dropped_detail, CASE WHEN refused THEN ['tion|ment', '1000'] ELSE {unmet('packed', ('tion|ment', '1000'))} END AS missing_points FROM base),
evals AS (SELECT id, type, expect, refused, reason, round(coalesce((SELECT score FROM hits h WHERE h.query_id = id AND hit_rank = 1), 0), 3) AS top_score,
  coalesce(list_contains(gold, main[1]), false) AS hit_at_1, list_has_any(gold, main) AS hit_at_k, list_min(list_filter(list_transform(gold, lambda g: list_position(main, g)), lambda p: p > 0)) AS gold_rank, len(gold) > 0 AS has_gold, gold, cited,
  list_has_any(gold, cited) AS cited_gold, len(dropped_detail) AS dropped_citations, dropped_detail, missing_points, len(missing_points) = 0 AS points_ok, expect_case, cases_shown,
  CASE WHEN expect_case IS NOT NULL THEN (len(cases_shown) > 0) = expect_case END AS case_ok, main AS retrieved FROM more)"""
ROWS = f"""WITH {EVAL} SELECT * EXCLUDE (gold, cited, missing_points, cases_shown, retrieved, dropped_detail), {", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("gold", "cited", "missing_points", "cases_shown", "retrieved"))} FROM evals"""
SUMS = """count(*) AS n, count_if(expect = 'answer') AS n_answerable, count_if(expect = 'answer' AND has_gold) AS n_gold, count_if(type = 'out_of_kb') AS n_out_of_kb, count_if(case_ok IS NOT NULL) AS n_case,
count_if(expect = 'answer' AND has_gold AND hit_at_k) AS hit_at_k, count_if(expect = 'answer' AND has_gold AND hit_at_1) AS hit_at_1, count_if(expect = 'answer' AND has_gold AND NOT refused AND cited_gold) AS citation_ok, count_if(expect = 'answer' AND points_ok) AS points_ok,
coalesce(sum(dropped_citations), 0)::BIGINT AS dropped_citations, count_if(type = 'out_of_kb' AND refused) AS refused_right, count_if(expect = 'answer' AND refused) AS refused_wrong, count_if(case_ok) AS case_right"""
METRICS = f"WITH {EVAL} SELECT type, {SUMS} FROM evals GROUP BY 1 UNION ALL SELECT 'all' AS type, {SUMS} FROM evals"
SHOWN = (("retrieval hit", "hit_at_k", "n_gold"), ("retrieval hit, first", "hit_at_1", "n_gold"), ("citation accuracy", "citation_ok", "n_gold"), ("key-point coverage", "points_ok", "n_answerable"), ("refused rightly", "refused_right", "n_out_of_kb"), ("refused wrongly", "refused_wrong", "n_answerable"), ("case shown as expected", "case_right", "n_case"))
RATIOS = f"WITH {EVAL}, s AS (SELECT {SUMS} FROM evals) " + " UNION ALL ".join(f"SELECT {lit(m)} AS metric, CASE WHEN {d} > 0 THEN {n} || '/' || {d} || ' = ' || CAST(round_even({n} * 100 / {d}, 0) AS BIGINT) || '%' ELSE '-' END AS value FROM s" for m, n, d in SHOWN)
TOP = "printf('%.3f', top_score)"
E_ = evaluate
FAILED = f"""WITH {EVAL}, f AS (SELECT id, list_filter([
  CASE WHEN expect = 'answer' AND has_gold AND NOT hit_at_k THEN '{E_.NOT_RETRIEVED}' END, CASE WHEN expect = 'answer' AND refused THEN '{E_.REFUSED}(' || reason || ', top=' || {TOP} || ')' END,
  CASE WHEN expect = 'answer' AND NOT refused AND has_gold AND NOT cited_gold THEN '{E_.NO_GOLD_CITED}：' || array_to_string(cited, ',') END, CASE WHEN expect = 'answer' AND NOT refused AND len(dropped_detail) > 0 THEN '{E_.DROPPED}：' || array_to_string(dropped_detail, '；') END,
  CASE WHEN expect = 'answer' AND NOT refused AND len(missing_points) > 0 THEN '{E_.POINTS}：' || array_to_string(missing_points, '、') END, CASE WHEN expect <> 'answer' AND NOT refused THEN '{E_.NOT_REFUSED}(top=' || {TOP} || ')' END,
  CASE WHEN NOT case_ok THEN CASE WHEN expect_case THEN '{E_.CASE_MISSING}' ELSE '{E_.CASE_UNWANTED}：' || array_to_string(cases_shown, '、') END END], lambda x: x IS NOT NULL) AS why,
  list_filter([CASE WHEN expect = 'answer' AND has_gold AND NOT hit_at_k THEN '{E_.NOT_RETRIEVED}' END, CASE WHEN expect = 'answer' AND refused THEN '{E_.REFUSED}' END, CASE WHEN expect = 'answer' AND NOT refused AND has_gold AND NOT cited_gold THEN '{E_.NO_GOLD_CITED}' END,
  CASE WHEN expect = 'answer' AND NOT refused AND len(missing_points) > 0 THEN '{E_.SHORT_POINTS}：' || array_to_string(missing_points, '、') END, CASE WHEN expect <> 'answer' AND NOT refused THEN '{E_.NOT_REFUSED}' END, CASE WHEN NOT case_ok THEN '{E_.SHORT_CASE}' END], lambda x: x IS NOT NULL) AS tags FROM evals)
SELECT id, array_to_string(why, '；') AS why, array_to_string(tags, '；') AS tags FROM f WHERE len(why) > 0"""
SWEEP = f"""WITH {EVAL} SELECT threshold, count_if(type = 'out_of_kb' AND top_score < threshold) AS refused_right, count_if(expect = 'answer' AND top_score < threshold) AS refused_wrong, count_if(type = 'out_of_kb') AS n_out_of_kb, count_if(expect = 'answer') AS n_answerable,
  min(top_score) FILTER (expect = 'answer') AS lowest_answerable, coalesce(max(top_score) FILTER (type = 'out_of_kb'), 0) AS highest_out_of_kb
FROM evals, (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in evaluate.THRESHOLDS)}]) AS threshold) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "clean_junk_lines": CLEAN,
        "running_lines": RUNNING,
        "page_boilerplate": BOILER,
        "classify_level": LEVEL,
        "normalize_text": NORMAL,
        "stable_ids": IDS,
        "char_shingles": SHINGLES,
        "near_dup_pairs": NEAR,
        "dedupe_survivors": SURVIVE,
        "benchmark_containment": CONTAIN,
        "segment_by_marker": SEGMENT,
        "chunk_citation": CITE,
        "corpus_report": REPORT,
        "expand_query": EXPAND,
        "required_evidence": REQUIRE,
        "definition_terms": DEFINE,
        "case_aggregate": CASES,
        "dense_topk": DENSE,
        "dense_lists": DENSE,
        "sparse_topk": f"WITH {CORPUS} SELECT query_id, chunk_id, rank, score FROM lex",
        "rrf_fuse": f"WITH {CORPUS} SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf, 9) AS rrf, fused_rank FROM fused",
        "rerank_cap_topk": f"WITH {SEARCH} SELECT query_id, chunk_id, pinned, required, round(score, 6) AS score, hit_rank FROM hits",
        "case_search": f"WITH {SEARCH} SELECT query_id, case_id, chunk_id, round(score, 6) AS score, array_to_string(list_sort(matched), ',') AS matched, case_rank FROM ccases",
        "evidence_gate": f"WITH {SEARCH} SELECT query_id, round(top_score, 6) AS top_score, has_evidence FROM gate",
        "hybrid_search": f"WITH {SEARCH} SELECT h.query_id, hit_rank, chunk_id, '《' || d.source || '》 ' || d.doc_type || ' ' || chunk_id AS citation, h.dense_rank, h.sparse_rank, round(h.score, 6) AS score, has_evidence FROM hits h JOIN gate USING (query_id) JOIN chunks d USING (chunk_id)",
        "route_intent": INTENT,
        "merge_searches": MERGE,
        "number_sources": f"WITH {SEARCH} SELECT query_id, source, chunk_id, tag FROM sources",
        "verify_quotes": f"WITH {CHECKED} SELECT query_id, ord, source, chunk_id, valid, reason FROM checked",
        "scrub_marks": SCRUB,
        "keypoint_coverage": KEYPOINTS,
        "eval_rows": ROWS,
        "eval_metrics": METRICS,
        "metric_ratios": RATIOS,
        "answer_length": LENGTH,
        "failure_list": FAILED,
        "threshold_sweep": SWEEP,
    }
