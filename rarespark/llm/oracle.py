"""DuckDB SQL of the queries that SQL can express."""

_URL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace('&' || regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM parts
), named AS (
  SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www\.|m\.)', '')
           || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '')
           || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical
  FROM split
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE (starts_with(md5(url), '0') OR regexp_matches(host, 'casino|pills|bets|adult')) AND canonical IS NOT NULL
), rules(verdict, rule, site, start) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM named JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id
)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN n.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fitting f USING (page_id)
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


_CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length({_escaped('role')}) + length(replace(role, chr(10), chr(10) || chr(10))) - length(role)
                + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_NEAR = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)
"""

_SEARCH = r"""
WITH said AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), sizes AS (
  SELECT d, doc_id, len(w) AS n FROM said WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes
), tfs AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM said) GROUP BY d, t
), asked AS (
  SELECT DISTINCT item_id, text, unnest(list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t
  FROM benchmark
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY t, docs
), scored AS (
  SELECT item_id, text, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN sizes USING (d), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _way(state: str, cost: str, edit: str, line: str) -> str:
    """``state`` one edit further: a struct of ``cost|audit`` (compared first) and the repaired text."""
    said = f"CASE WHEN {line} IS NULL THEN {state}.r WHEN {state}.r IS NULL THEN {line} ELSE {state}.r || chr(10) || {line} END"
    label = f"lpad(CAST(CAST(substr({state}.k, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}.k, 10) || '{edit}'"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {label}, 'r': {said}}} END"


def _when(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} END"


_STAY, _LINE = "fault NOT IN (1, 2)", "role || ':' || text"
_ROW = {
    "z": [_way("z", "2", "D", "NULL")],
    "s": [_way("s", "2", "D", "NULL"), _when(f"{_STAY} AND i = 's'", _way("z", "more", "K", _LINE))],
    "u": [_way("u", "2", "D", "NULL")]
    + [_when(f"{_STAY} AND i = 'u'", _way(x, "more", "K", _LINE)) for x in "zsa"]
    + [_when(_STAY, _way(x, "1 + more", "R", "'user:' || text")) for x in "zsa"],
    "a": [_way("a", "2", "D", "NULL"), _when(f"{_STAY} AND i = 'a'", _way("u", "more", "K", _LINE)), _when(_STAY, _way("u", "1 + more", "R", "'assistant:' || text"))],
}
_PUT = {
    "z": ["z"], "s": ["s"],
    "u": ["u", *[_way(x, "5", "I", "'user:'") for x in "zsa"]],
    "a": ["a", _way("u", "5", "I", "'assistant:'")],
}
# an empty row put in before each row and at the end is enough: two in a row are never cheapest
_REPAIR = rf"""
WITH RECURSIVE bits(x, c, n) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT x, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY x) AS t FROM bits WHERE n = 8
), spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT s.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda b: CAST(ascii(b) AS BIGINT))),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fate FROM spaced s, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, substr(role, 1, 1) AS i FROM damaged
), faulty AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
         regexp_replace(text, '[ 	-
]+$', '') AS said, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed
), rows AS (
  SELECT *, CASE WHEN said = '' THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(said, '[.!?]$') THEN 3 ELSE 0 END AS fault FROM faulty
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id
), walk AS (
  SELECT conv_id, n, 0::BIGINT AS p, {{'k': '000000000', 'r': NULL::VARCHAR}} AS z, NULL::STRUCT(k VARCHAR, r VARCHAR) AS s,
         NULL::STRUCT(k VARCHAR, r VARCHAR) AS u, NULL::STRUCT(k VARCHAR, r VARCHAR) AS a FROM counted
  UNION ALL
  SELECT w.conv_id, n, w.p + 1, {", ".join(_best(*_ROW[x]) for x in "zsua")}
  FROM (SELECT conv_id, n, p, {", ".join(f"{_best(*_PUT[x])} AS {x}" for x in "zsua")} FROM walk) w
  JOIN (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM rows) r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p = w.p + 1
), ended AS (
  SELECT conv_id, list_min(list_filter([z, {_best(*_PUT["a"])}], lambda x: x IS NOT NULL)) AS best FROM walk WHERE p = n
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best.k, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best.k, 10), '') AS audit,
       sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SQL: dict[str, str] = {"op11_ranked_search": _SEARCH, "op12_repair": _REPAIR, "op7_near_dup": _NEAR, "op1_url_filter": _URL, "op6_chat_format": _CHAT}
