"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, SYMBOLS, WINDOW
from .sharding import HASH_BITS
from .spelling_variants import LETTERS, LOWER, MIN_COUNT, MIN_LENGTH, RATIO, UPPER

BLANKS = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"



def _nibble(c: int) -> int:
    for _ in range(4):
        c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
    return c


#: crc32 over the nibbles of a text's bytes, low nibble first: the sixteen remainders follow from the polynomial.
CRC_TABLE = "[" + ", ".join(f"{_nibble(c)}::BIGINT" for c in range(16)) + "]"


def crc32(nibbles: str) -> str:
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda c, b: xor(c >> 4, ({CRC_TABLE})[(xor(c, b) & 15) + 1])))"


def _hash(key: str, salt: str) -> str:
    return f"('0x' || substr(md5({key} || ':' || {salt}), 1, {HASH_BITS // 4}))::BIGINT"


def sharding(n_shards: int = 16, per_bucket: int = 2048) -> str:
    digit = "(instr('0123456789ABCDEF', h[i + 1 - 2 * (i % 2) + 1]) - 1)::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, s, {_hash('k', 's::VARCHAR')} AS h FROM d, range({n_shards + 1}) x(s)),
a AS (SELECT r, CAST(arg_max(s, (h, -s)) FILTER (s < {n_shards}) AS INTEGER) AS shard, CAST(arg_max(s, (h, -s)) AS INTEGER) AS grown_shard FROM s GROUP BY r),
b AS (SELECT d.*, shard, grown_shard, {_hash('k', "'slot'")} % greatest(1, CAST(ceil((SELECT count(*) FROM d) / {float(n_shards * per_bucket)}) AS BIGINT)) AS bucket FROM d JOIN a USING (r)),
n AS (SELECT r, list_transform(range(2 * strlen(t)), lambda i: {digit}) AS nib FROM (SELECT r, t, string_split(hex(encode(t)), '') AS h FROM d)),
c AS (SELECT b.*, {crc32('nib')}::BIGINT AS crc FROM b JOIN n USING (r))
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, crc, strlen(t)) - 1 AS BIGINT) AS slot, grown_shard FROM c"""


def exact_dedup() -> str:
    return """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, coalesce(g.keep_id, doc_id) AS keep_id, group_size, doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON g.t = d.t"""


def quality(source: str = "documents") -> str:
    rules = " AND ".join(
        f"({r.metric}) >= {r.low}" if r.high is None else f"({r.metric}) <= {r.high}" if r.low is None else f"({r.metric}) BETWEEN {r.low} AND {r.high}" for r in RULES
    )
    base = " AND ".join(f"({r.metric}) >= {r.low}" if r.high is None else f"({r.metric}) <= {r.high}" for r in RULES[:2])
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORDS}')) AS l FROM {source}),
win AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
gram AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM win),
rep AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1),
cov AS (SELECT r, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS c FROM rep GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words FROM d LEFT JOIN cov ON cov.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({base}) AS base_failed, ({rules}) AS kept, n_stop_words, n_lines FROM m"""


def _nibbles(text: str) -> str:
    """A text's nibbles, low ones first, as a list."""
    digit = f"(instr('0123456789ABCDEF', substr(hex(encode({text})), CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) - 1)::BIGINT"
    return f"list_transform(range(2 * strlen({text})), lambda i: {digit})"


def conversation_repair() -> str:
    """Paths of the edits state by state: of each state of the grammar the cheapest cost, its edits and the turns kept."""
    far = "{'c': 1000000000, 'a': '', 'k': ''}"
    plus = lambda x, cost, label, kept: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{label}', 'k': {x}.k || {kept}}}"
    least = lambda *found: f"list_min([{', '.join(found)}])"
    said = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    insert = lambda x, role: plus(x, 5, "I", said(f"'{role}'"))
    only = lambda when, x: f"CASE WHEN {when} THEN {x} ELSE {far} END"
    fine, more = "fault NOT IN (1, 2)", "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    keep = lambda x: plus(x, more, "K", said("role", "text"))
    to = lambda x, role: f"CASE WHEN NOT ({fine}) THEN {far} WHEN initial = '{role[0]}' THEN {keep(x)} ELSE {plus(x, f'{more} + 1', 'R', said(repr(role), 'text'))} END"
    gone = lambda x: plus(x, 2, "D", "''")
    closed = f"SELECT conv_id, i, e, s, u, {least('a', insert('u', 'assistant'))} AS a FROM (SELECT conv_id, i, e, s, {least('u', *(insert(x, 'user') for x in 'esa'))} AS u, a FROM p)"
    step = f"{gone('e')} AS e, {least(gone('s'), only(f'{fine} AND initial = {chr(39)}s{chr(39)}', keep('e')))} AS s, {least(gone('u'), *(to(x, 'user') for x in 'esa'))} AS u, {least(gone('a'), to('u', 'assistant'))} AS a"
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
n AS (SELECT *, {_nibbles('k')} AS nib FROM d), x AS (SELECT conv_id, turn, role, text, {crc32('nib')} % 20 AS kind FROM n),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM r),
f AS (SELECT conv_id, turn, role, text, i, initial, CASE WHEN NOT regexp_matches(text, '{WORDS}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?]{BLANKS}*$') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS met FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'k': ''}} AS e, {far} AS s, {far} AS u, {far} AS a FROM ids
  UNION ALL SELECT q.conv_id, f.i, {step} FROM ({closed}) q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1),
z AS (SELECT conv_id, i, {least('e', 'a')} AS best FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.k, 2)) AS repaired_sha256 FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


def spelling_variants() -> str:
    """Near words by equal single deletions at one place, or a word and another's deletion; roots by recursion."""
    return f"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '{LETTERS}{{{MIN_LENGTH},}}')) AS run FROM documents),
w AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') AS word, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT word, c, {crc32('nib')} AS h FROM (SELECT word, c, {_nibbles("id || ':' || word")} AS nib FROM w)),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
k AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT DISTINCT a.word, a.n, b.word, b.n FROM n a JOIN k b ON a.word = b.key
  UNION ALL SELECT DISTINCT b.word, b.n, a.word, a.n FROM n a JOIN k b ON a.word = b.key),
b AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT word, n_near, CASE WHEN -best[1] >= {RATIO} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {RATIO} * n THEN -best[1] END AS form_n FROM b),
t AS (SELECT word, form AS root, 1 AS hops FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form, hops + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, hops) AS root FROM t GROUP BY word)
SELECT n.word, form, coalesce(root, n.word) AS root, n.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM n LEFT JOIN f ON f.word = n.word LEFT JOIN e ON e.word = n.word"""


ORACLE_SQL = {"op2_sharding": sharding(), "op3_exact_dedup": exact_dedup(), "op6_quality": quality(), "op11_conversation_repair": conversation_repair(), "op12_spelling_variants": spelling_variants()}
