"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .chat import ESCAPES, OTHER, TEMPLATE
from .licenses import KNOWN
from .mixing import WEIGHTS

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, peer) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.peer = e.u),
m AS (SELECT doc_id, min(peer) AS component_id FROM r GROUP BY ALL)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT doc_id, p, md5(b[p:p + 199]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)),
t AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
i AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
      FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM t)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 199 AS z FROM i GROUP BY doc_id, k),
g AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS start FROM s
  UNION ALL
  SELECT doc_id, NULL, NULL, coalesce(max(z), 0) + 1 FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
r AS (
  SELECT doc_id, coalesce(sum(z - a + 1), 0)::BIGINT AS n_removed, count(a) AS n_spans,
    string_agg(hex(b[start:coalesce(a - 1, octet_length(b))]), '' ORDER BY start) AS x
  FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN r USING (doc_id)
"""


def _secret_scan() -> str:
    base = ("assign", "access", "hex")
    rules = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 0),
        ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    )
    parts = []
    for i, (kind, pattern, group, least) in enumerate(rules):
        p = pattern.replace("'", "''")
        keep = f"length(regexp_extract(m[i], '{p}', {group})) >= {least}"
        parts.append(rf"""
SELECT doc_id, '{kind}' AS kind, {i} AS place, CAST(coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM (
  SELECT doc_id, m, unnest(range(2, len(m) + 1, 2)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(64976), chr(64977)), '({p})', chr(64976) || '\1' || chr(64976), 'g'), chr(64976)) AS m FROM documents)) WHERE {keep}""")
    named = ", ".join(f"'{x}'" for x in base)
    item = "kind || ':' || a || ':' || (a + n)"
    return rf"""
WITH f AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)},
    string_agg({item}, ',' ORDER BY a, place) FILTER (kind IN ({named})) AS b, string_agg({item}, ',' ORDER BY a, place) AS s
  FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


SECRET_SCAN = _secret_scan()

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


_COPYRIGHT = (
    r"(?m)^[^\p{L}\n©]*(?:(?:(?i:copyright)[ \t]*(?:(?i:\(c\))|©|[12][0-9]{3}|\[|<)|(?i:\(c\))[ \t]*(?:(?i:copyright)|[12][0-9]{3})|©)[^\n]*?(?:\.[ \t]+((?i:licen[sc]ed|released|distributed|this [a-z]+ is licen)[^\n]*))?"
    r"|(?i:copyright)[ \t]+(?:(?i:by)[ \t]+)?\p{Lu}[\p{Ll}.]+(?:[ \t,&.]+\p{Lu}[\p{Ll}.]+)*[ \t\r]*|(?i:all rights reserved)[. \t\r]*)$"
)


def _unified(text: str) -> str:
    out = f"lower(regexp_replace({text}, '{_COPYRIGHT}', ' \\1', 'g'))"
    for pattern, form in (
        ("licenc", "licens"), (r"\bnon[ -]?infringement\b", "noninfringement"), (r"\bnon[ -]commercial\b", "noncommercial"), (r"\bsub[ -]licens", "sublicens"), (r"\borganisation", "organization"),
        (r"\bauthoris", "authoriz"), (r"\backnowledgement", "acknowledgment"), (r"\bhttps\b", "http"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{form}', 'g')"
    return out


def _bare(text: str) -> str:
    return f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"


def _license_scan() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH k AS (SELECT sha256({_bare(_unified("t"))}) AS digest, min(l) AS license FROM (VALUES {rows}) x(l, t) GROUP BY 1),
d AS (
  SELECT doc_id, u, sha256({_bare("u")}) AS digest, n_copyright_lines FROM (
    SELECT doc_id, {_unified("coalesce(text, '')")} AS u, CAST(len(regexp_extract_all(coalesce(text, ''), '{_COPYRIGHT}')) AS BIGINT) AS n_copyright_lines FROM documents)),
l AS (
  SELECT doc_id, unnest(string_split(u, chr(10))) AS piece FROM d
  UNION ALL SELECT doc_id, unnest(string_split_regex(u, '\\n[ \\t\\r]*\\n')) FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM (SELECT doc_id, sha256({_bare("piece")}) AS digest FROM l) JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, d.digest, license, n_copyright_lines, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n USING (doc_id)
"""


LICENSE_SCAN = _license_scan()
LICENSE_FIXTURE = "SELECT CAST(d AS BIGINT) AS doc_id, license, CAST(1 AS BIGINT) AS n_copyright_lines FROM (VALUES " + ", ".join(f"({3 * i + j}, '{name}')" for i, (name, _) in enumerate(KNOWN) for j in range(3)) + ") x(d, license)"


_MEASURED = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) > 2)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT w) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS w FROM c) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) AS n_chars
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeated_windows, n_words > 0 AND n_symbols > 0.4 * n_words AS symbols,
    n_lines > 0 AND n_dup_lines > 0.6 * n_lines AS duplicate_lines, word_chars < 2 * n_words AS short_words, word_chars > 14 * n_words AS long_words, n_words > 1000000 AS many_words FROM m)
"""

QUALITY_RULES = _MEASURED + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_chars,
  few_words::INTEGER + 2 * repeated_windows::INTEGER + 4 * symbols::INTEGER + 8 * duplicate_lines::INTEGER + 16 * short_words::INTEGER + 32 * long_words::INTEGER + 64 * many_words::INTEGER AS fail_bits,
  2 AS policy_version, few_words OR repeated_windows AS base_failed,
  NOT (few_words OR repeated_windows OR symbols OR duplicate_lines OR short_words OR long_words) AS kept FROM f
"""


def _ablations() -> str:
    parts = []
    for version, rules in ((1, ("few_words", "repeated_windows")), (2, ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"))):
        for rule in rules:
            others = " OR ".join(r for r in rules if r != rule)
            parts.append(f"SELECT {version} AS policy_version, '{rule}' AS rule, count(*) FILTER ({rule}) AS n_failed, count(*) FILTER ({rule} AND NOT ({others})) AS n_only, count(*) FILTER (NOT ({others})) AS n_kept_without FROM f")
    return _MEASURED + " UNION ALL ".join(parts)


ABLATIONS = _ablations()


def _chat_format() -> str:
    def escape(x: str) -> str:
        for plain, code in ESCAPES:
            x = f"replace({x}, '{plain}', '{code}')"
        return x

    marks = " ".join(f"WHEN '{role}' THEN {len(o) + len(c)}" for role, (o, c, _) in TEMPLATE.items())
    losing = ", ".join(f"'{role}'" for role, spec in TEMPLATE.items() if spec[2])
    other = f"{sum(map(len, OTHER))} + length({escape('role')})"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(role, 1, '') OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE
    WHEN role = 'system' THEN place <> 0
    WHEN role = 'user' THEN before NOT IN ('', 'system', 'assistant') OR (before = '' AND place <> 0)
    WHEN role = 'assistant' THEN before <> 'user' ELSE true END AS bad FROM o),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({losing})), '') AS loss,
    CAST(sum(length({escape('text')}) + CASE role {marks} ELSE {other} END) AS BIGINT) AS formatted_chars,
    coalesce(min(place) FILTER (bad), CASE WHEN max_by(role, place) <> 'assistant' THEN count(*) END) AS first_error
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, first_error IS NULL AS valid, first_error FROM g
"""


CHAT_FORMAT = _chat_format()


def _mixing(share: float = 0.5, epochs: int = 4, seed: int = 17) -> str:
    keys = ("domain", "lang_", "source_")
    given = ", ".join(f"({level}, {', '.join('NULL' if x is None else repr(x) for x in names)}, {weight})" for level, *names, weight in WEIGHTS)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ctes = []
    for depth in (1, 2, 3):
        own, parent, n = ", ".join(keys[:depth]), ", ".join(keys[: depth - 1]) or "1", f"l{depth}"
        nodes = f"SELECT {own}, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap, max(w{depth}) AS weight FROM alive GROUP BY {own}"
        budget = "CAST(least(t, sum(cap) OVER ()) AS BIGINT) AS b FROM n CROSS JOIN total" if depth == 1 else f"budget AS b FROM n JOIN l{depth - 1} USING ({parent})"
        select = "n.*" if depth == 1 else f"{own}, n.cap, n.weight"
        ctes.append(f"""
{n}0 AS (WITH n AS ({nodes}) SELECT {select}, {budget}),
{n}1 AS (SELECT *, coalesce(sum(cap) OVER (o {before}), 0) AS taken, sum(weight) OVER p - coalesce(sum(weight) OVER (o {before}), 0) AS remaining
  FROM {n}0 WINDOW o AS (PARTITION BY {parent} ORDER BY cap / weight, {own}), p AS (PARTITION BY {parent})),
{n}2 AS (SELECT *, cap <= weight * ((b - taken) / remaining) AS f FROM {n}1),
{n}3 AS (SELECT *, f AND coalesce(cap / weight < min(cap / weight) FILTER (NOT f) OVER (PARTITION BY {parent}), true) AS g FROM {n}2),
{n}4 AS (SELECT *, CASE WHEN g THEN CAST(cap AS DOUBLE) ELSE (b - coalesce(sum(cap) FILTER (g) OVER (PARTITION BY {parent}), 0)) * weight / sum(weight) FILTER (NOT g) OVER (PARTITION BY {parent}) END AS share FROM {n}3),
{n}5 AS (SELECT *, least(cap, CAST(floor(share + 1e-6) AS BIGINT)) AS low FROM {n}4),
{n}6 AS (SELECT *, least(b, sum(cap) OVER q) - sum(low) OVER q AS over, row_number() OVER (PARTITION BY {parent} ORDER BY low >= cap, round(share - low, 6) DESC, {own}) AS place
  FROM {n}5 WINDOW q AS (PARTITION BY {parent})),
{n} AS (SELECT {own}, low + CASE WHEN place <= over AND low < cap THEN 1 ELSE 0 END AS budget FROM {n}6)""")
    weights = ", ".join(f"coalesce((SELECT min(weight) FROM wt WHERE level = {d} AND {' AND '.join(f'wt.{k} = s.{k}' for k in keys[:d])}), 1) AS w{d}" for d in (1, 2, 3))
    return rf"""
WITH wt AS (SELECT level, domain, lang_, source_, CAST(weight AS DOUBLE) AS weight FROM (VALUES {given}) x(level, domain, lang_, source_, weight)),
k AS (
  SELECT doc_id, lang, source, 'domain' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INTEGER) % 3) AS domain, coalesce(lang, '') AS lang_, coalesce(source, '') AS source_,
    CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS BIGINT) AS n, md5(coalesce(text, '')) AS print FROM documents),
s AS (SELECT domain, lang_, source_, CAST(sum(n) AS BIGINT) AS tokens FROM k GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS t FROM s),
alive AS (SELECT * FROM (SELECT s.*, {weights} FROM s) WHERE w1 > 0 AND w2 > 0 AND w3 > 0),{",".join(ctes)},
e AS (SELECT s.*, budget // tokens AS epochs, budget % tokens AS rest FROM s JOIN l3 USING (domain, lang_, source_)),
h AS (SELECT k.*, epochs, rest, md5('{seed}:' || (epochs + 1) || ':' || doc_id || ':' || print || ':' || n) AS h FROM k JOIN e USING (domain, lang_, source_)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang_, source_ ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, lang, source, domain, n AS n_tokens, CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST(CASE WHEN before < rest THEN least(n, rest - before) ELSE n END AS BIGINT) AS last_tokens
FROM c WHERE epochs > 0 OR before < rest
"""


MIXING = _mixing()

LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
i AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS x FROM p JOIN w USING (t), c),
s AS (SELECT item_id, r, doc_id, sum(x)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY ALL HAVING sum(x) > 0),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50
"""

CHANGE_APPLIER = r"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS step, i AS v FROM range(256) t(i) UNION ALL SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE step < 8),
lookup AS (SELECT list(v ORDER BY i) AS x FROM bits WHERE step = 8),
ids AS (SELECT DISTINCT change_id FROM client_changes WHERE change_id IS NOT NULL),
crc AS (
  SELECT change_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(change_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a // 256, x[xor(a, b) % 256 + 1])), 4294967295::BIGINT) AS h
  FROM ids, lookup),
base AS (
  SELECT d.*, dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n, datediff('day', DATE '1970-01-01', valid_at::DATE) + 9 * (h % 4) AS day, h
  FROM (SELECT DISTINCT * FROM client_changes) d LEFT JOIN crc USING (change_id)),
kept AS (SELECT *, least(12, 1 + (day - 19723) * 12 // 160) AS batch FROM base WHERE valid_at IS NOT NULL AND h % 11 <> 0),
heads AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY client_id, n ORDER BY day, change_id) = 1),
highs AS (SELECT b, (SELECT max(day) FROM kept WHERE batch < b) AS high FROM range(1, 13) t(b) UNION ALL SELECT 13, 1000000000),
runs AS (  -- stretches of numbers of which each is there by batch b
  SELECT client_id, b, min(n) AS a, max(n) AS z FROM (
    SELECT client_id, b, n, n - row_number() OVER (PARTITION BY client_id, b ORDER BY n) AS g FROM heads, range(1, 14) t(b) WHERE batch <= b)
  GROUP BY client_id, b, g),
-- phase 0 of batch b: what is due jumps, one jump a step; phase 1: the batch's own rows
state(client_id, b, phase, next, first, upto, missed, step) AS (
  SELECT DISTINCT client_id, 1, 0, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM heads
  UNION ALL
  SELECT s.client_id, CASE WHEN s.phase = 1 THEN s.b + 1 ELSE s.b END,
    CASE WHEN s.phase = 1 THEN 0 WHEN due THEN 0 ELSE 1 END,
    CASE WHEN s.phase = 1 THEN coalesce(own.z + 1, s.next) WHEN due THEN held.z + 1 ELSE s.next END,
    CASE WHEN s.phase = 1 THEN s.next WHEN due THEN held.n ELSE 0 END,
    CASE WHEN s.phase = 1 THEN coalesce(own.z, 0) WHEN due THEN held.z ELSE 0 END,
    CASE WHEN s.phase = 0 AND due THEN held.n - s.next ELSE 0 END, s.step + 1
  FROM state s JOIN highs USING (b)
  LEFT JOIN runs own ON own.client_id IS NOT DISTINCT FROM s.client_id AND own.b = s.b AND s.phase = 1 AND s.next BETWEEN own.a AND own.z
  LEFT JOIN LATERAL (
    SELECT min(x.n) AS n, min(x.day) + 3 <= high AS due, min(y.z) AS z FROM heads x JOIN runs y ON y.client_id IS NOT DISTINCT FROM x.client_id AND y.b = s.b - 1 AND x.n BETWEEN y.a AND y.z
    WHERE s.phase = 0 AND x.client_id IS NOT DISTINCT FROM s.client_id AND x.batch < s.b AND x.n >= s.next) held ON true
  WHERE s.b < 13 OR s.phase = 0 AND coalesce(due, false)),
steps AS (SELECT client_id, first, upto, missed, step, CASE WHEN lag(b) OVER w < b AND lag(phase) OVER w = 1 THEN b - 1 ELSE b END AS batch FROM state WINDOW w AS (PARTITION BY client_id ORDER BY step)),
done AS (
  SELECT h.*, s.batch AS done_in, CASE WHEN h.n = s.first THEN s.missed ELSE 0 END AS missed
  FROM heads h JOIN steps s ON h.client_id IS NOT DISTINCT FROM s.client_id AND h.n BETWEEN s.first AND s.upto),
grouped AS (SELECT *, sum(CASE WHEN op IN ('I', 'D') THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY n) AS g, max(n) OVER (PARTITION BY client_id) AS z FROM done),
valued AS (
  SELECT change_id, done_in, missed, n = z AND op IS DISTINCT FROM 'D' AS current,
    last_value(CASE WHEN op IN ('I', 'U') THEN city END IGNORE NULLS) OVER w AS city, last_value(CASE WHEN op IN ('I', 'U') AND NOT isnan(balance) THEN balance END IGNORE NULLS) OVER w AS balance
  FROM grouped WINDOW w AS (PARTITION BY client_id, g ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT k.change_id, client_id, CASE WHEN v.change_id IS NULL THEN 'rejected' ELSE 'applied' END AS status, coalesce(done_in, batch)::INTEGER AS batch, coalesce(v.missed, 0)::BIGINT AS missed,
  v.city, floor(100 * v.balance + 0.5)::BIGINT AS cents, coalesce(v.current, false) AS current
FROM kept k LEFT JOIN valued v USING (change_id)
"""
