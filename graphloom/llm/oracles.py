"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from .chat import END, START
from .common import LOWER, UPPER
from .mixing import CELL_ROWS
from .quality import TRANSITIONS, WEIGHTS
from .sharding import ID_BITS
from .urlfilter import GLOBS, RULES

FOLD = f"'{UPPER}', '{LOWER}'"


def sharding_sql(limit: int) -> str:
    return f"""WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS bits FROM documents),
sums AS (SELECT d, bits >> ({ID_BITS} - d)::INT AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM h, range(0, {ID_BITS + 1}) t(d) GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, d, p, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS rank
  FROM h JOIN sums ON p = bits >> ({ID_BITS} - d)::INT WHERE shard_bytes <= {limit} OR shard_docs = 1)
SELECT doc_id, n_bytes, d AS depth, CASE WHEN d > 0 THEN lpad(bin(p), d::INT, '0') ELSE '' END AS shard, shard_docs, shard_bytes, shard_bytes > {limit} AS oversized FROM leaf WHERE rank = 1"""


def chat_sql() -> str:
    said = "<|im_end|><|im_start|>assistant ok"
    order = "ORDER BY turn NULLS FIRST, role, text"
    longer = lambda c: f"length({c}) + len(regexp_extract_all({c}, '<\\\\*\\|'))"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + {longer("role")} + {longer("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def quality_sql(min_share: float = 0.5) -> str:
    """The lines of a text are folded: of the best labelling that ends in either label, its
    score and its content words are carried, which gives what tracing the labels back gives."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    of = lambda chars: f"(strlen(line) - strlen(regexp_replace(line, '[{chars}]', '', 'g')))"
    real = lambda x: f"{float(x)!r}::DOUBLE"
    features = (
        "1", "(n = 1)::INT", "(n <= 3)::INT", f"least(1, {real(4)} * {of('#*$%&|<>')} / size)", f"least(1, {real(2)} * {of('A-Z')} / size)", f"least(1, {real(4)} * {of('0-9')} / size)",
        f"least(1, {of('!')}::DOUBLE / n)", "CASE WHEN n > 5 THEN 1 - len(list_distinct(ws))::DOUBLE / n ELSE 0 END", "seen::INT", "(size > 40 * n)::INT",
    )
    score = " + ".join(f"{real(w)} * {x}" for w, x in zip(WEIGHTS, features))
    (bb, bc), (cb, cc) = [[real(x) for x in row] for row in TRANSITIONS]
    to_b, to_c = f"a.b + {bb} >= a.c + {cb}", f"a.c + {cc} >= a.b + {bc}"
    step = f"""{{'b': CASE WHEN {to_b} THEN a.b + {bb} ELSE a.c + {cb} END, 'c': CASE WHEN {to_c} THEN a.c + {cc} ELSE a.b + {bc} END + x.c,
  'nb': CASE WHEN {to_b} THEN a.nb ELSE a.nc END, 'nc': CASE WHEN {to_c} THEN a.nc ELSE a.nb END + x.nc}}"""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
g AS (SELECT rid, k, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) > 5)),
t AS (SELECT rid, k FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest(range(k, k + 5)) AS place FROM t) GROUP BY rid),
x AS (SELECT rid, no, string_split(text, chr(10))[no] AS line FROM (SELECT rid, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM d)),
l AS (SELECT *, regexp_extract_all(line, {word}) AS ws, row_number() OVER (PARTITION BY rid, line ORDER BY no) > 1 AS seen FROM x WHERE regexp_matches(line, {word})),
f AS (SELECT rid, no, seen, n, {score} AS score FROM (SELECT *, len(ws) AS n, strlen(line) AS size FROM l)),
v AS (SELECT rid, count(*) FILTER (seen) AS n_dup_lines, list_reduce(list({{'b': 0::DOUBLE, 'c': score, 'nb': 0::BIGINT, 'nc': n}} ORDER BY no), lambda a, x: {step}) AS e FROM f GROUP BY rid),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, strlen(text) - strlen(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(CASE WHEN e.c >= e.b THEN e.nc ELSE e.nb END / len(w)::DOUBLE, 0) AS content_share FROM d LEFT JOIN r USING (rid) LEFT JOIN v USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, content_share,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND content_share >= {min_share} AS kept FROM q"""


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if p == "**" else "[^/?]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", glob)) + "$"


def url_sql() -> str:
    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    longest = sorted(range(len(RULES)), key=lambda r: (-len(RULES[r][0]), r))
    case = lambda k: "".join(f" WHEN {fits(RULES[r][0])} THEN '{RULES[r][k]}'" for r in longest)
    blocked = " OR ".join(f"regexp_matches(canonical, '(?s){glob_regex(g)}')" for g in GLOBS)
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {FOLD}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*([^#]*)', 1), '') AS query FROM pages), c AS (SELECT *, host || path || query AS canonical FROM u)
SELECT page_id, host, path, CASE{case(0)} END AS rule, CASE{case(1)} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM c"""


def warc_sql() -> str:
    return """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p), r AS (SELECT *, n >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""


def mixing_sql(seed: int = 42) -> str:
    number = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    return f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM per),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS seq FROM w),
b AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM o),
l AS (SELECT *, first_value(CASE WHEN rest * w < cap * rest_w THEN rest / rest_w END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS level FROM b),
t AS (SELECT source, source_size, coalesce(level * w, cap) AS target FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN floor(log2(size) * 2) ELSE -1 END,
  {number("coalesce(doc_id::VARCHAR, '')")} % (SELECT greatest(1, -(-count(*) // {CELL_ROWS})) FROM s), size, doc_id) AS place FROM s),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, place, {number(f"'{seed}:' || coalesce(r.source, chr(10))")} / {1 << 32}.0::DOUBLE AS off
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(off + rate * place) - floor(off + rate * (place - 1)))::BIGINT AS n_copies FROM c)
SELECT doc_id, size, source_size, target, n_copies, size * n_copies AS taken FROM n"""


def decontamination_sql(window: int = 10) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
im AS (SELECT item_id, w, least({window}, len(w)) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM im)),
dw AS (SELECT rid, k, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM im) WHERE len(w) >= m)),
hit AS (SELECT rid, k, m, item_id FROM dw JOIN iw USING (m, win)),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS place FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)"""


def repeats_sql(window: int = 50) -> str:
    """Bytes are pairs of hex digits, so that every place can be a start."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {(1 << 63) - 1}) AS place, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT rid, place, n, b, substr(h, 512 * b + 1, {512 + 2 * window}) AS h FROM (SELECT rid, place, n, h, unnest(range(0, (n - {window - 1} + 255) // 256)) AS b FROM d WHERE n >= {window})),
w AS (SELECT rid, place, 256 * b + j AS k, substr(h, 2 * j + 1, {2 * window}) AS s FROM (SELECT *, unnest(range(0, least(256, n - {window - 1} - 256 * b))) AS j FROM part)),
f AS (SELECT s, min(place) AS first FROM w GROUP BY s), hit AS (SELECT rid, k FROM w JOIN f USING (s) WHERE first < place),
new AS (SELECT rid, k, CASE WHEN k <= lag(k) OVER (PARTITION BY rid ORDER BY k) + {window} THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT rid, k, sum(new) OVER (PARTITION BY rid ORDER BY k) AS g FROM new), span AS (SELECT rid, min(k) AS a, max(k) + {window} AS b FROM run GROUP BY rid, g),
cut AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM span),
c AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM cut JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN c USING (rid)"""


#: Primes of XXH64; fixed values.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def simhash_sql(shingle: int = 3, seed: int = 42, radius: int = 3) -> str:
    """XXH64 is written out in 128-bit arithmetic: a shingle's bytes are hex digits, its steps a
    list that is folded. Fingerprints link where they differ in few bits; components by recursion."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    m = "18446744073709551616::UHUGEINT"
    mul = lambda a, b: f"((({a}) * {b}) % {m})"
    add = lambda a, b: f"((({a}) + {b}) % {m})"
    rot = lambda a, r: f"((({a}) * {1 << r}::UHUGEINT) % {m} + ({a}) // {1 << (64 - r)}::UHUGEINT)"
    lane = lambda at, n: "('0x' || " + " || ".join(f"substr(h, {at} + {2 * (n - 1 - k)}, 2)" for k in range(n)) + ")::UBIGINT::UHUGEINT"
    round_ = lambda acc, x: mul(rot(add(acc, mul(x, p2)), 31), p1)
    # the four sums of a text of 32 bytes or more, folded over its stripes
    start = (f"{(seed + PRIMES[0] + PRIMES[1]) % (1 << 64)}", f"{(seed + PRIMES[1]) % (1 << 64)}", f"{seed}", f"{(seed - PRIMES[0]) % (1 << 64)}")
    sums = [f"list_reduce(list_prepend({start[i]}::UHUGEINT, list_transform(range(0, n // 32), lambda s: {lane(f'(64 * s + {16 * i + 1})', 8)})), lambda acc, x: {round_('acc', 'x')})" for i in range(4)]
    joined = add(add(add(rot("v1", 1), rot("v2", 7)), rot("v3", 12)), rot("v4", 18))
    for v in ("v1", "v2", "v3", "v4"):
        joined = add(mul(f"xor({joined}, {round_('0::UHUGEINT', v)})", p1), p4)
    eight = f"list_transform(range(0, (n % 32) // 8), lambda s: {lane('(64 * (n // 32) + 16 * s + 1)', 8)})"
    four = lane("(16 * (n // 8) + 1)", 4)
    one = "list_transform(range(0, n % 4), lambda s: ('0x' || substr(h, 8 * (n // 4) + 2 * s + 1, 2))::UBIGINT::UHUGEINT)"
    words = f"regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\\x20\\x09-\\x0D]+')"
    bits = "(" + " + ".join(f"CASE WHEN 2 * sum((hash >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64)) + ")::UBIGINT"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
g AS (SELECT rid, array_to_string(w[k : k + {shingle - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
u AS (SELECT DISTINCT s, strlen(s) AS n, hex(encode(s)) AS h FROM g),
a AS (SELECT *, CASE WHEN n >= 32 THEN {sums[0]} END AS v1, CASE WHEN n >= 32 THEN {sums[1]} END AS v2, CASE WHEN n >= 32 THEN {sums[2]} END AS v3, CASE WHEN n >= 32 THEN {sums[3]} END AS v4 FROM u),
x0 AS (SELECT s, n, h, {add(f"CASE WHEN n >= 32 THEN {joined} ELSE {(seed + PRIMES[4]) % (1 << 64)}::UHUGEINT END", "n::UHUGEINT")} AS x FROM a),
x1 AS (SELECT s, n, h, list_reduce(list_prepend(x, {eight}), lambda acc, l: {add(mul(rot(f"xor(acc, {round_('0::UHUGEINT', 'l')})", 27), p1), p4)}) AS x FROM x0),
x2 AS (SELECT s, n, h, CASE WHEN n % 8 >= 4 THEN {add(mul(rot(f"xor(x, {mul(four, p1)})", 23), p2), p3)} ELSE x END AS x FROM x1),
x3 AS (SELECT s, list_reduce(list_prepend(x, {one}), lambda acc, l: {mul(rot(f"xor(acc, {mul('l', p5)})", 11), p1)}) AS x FROM x2),
x4 AS (SELECT s, {mul(f"xor(x, x // {1 << 33}::UHUGEINT)", p2)} AS x FROM x3), x5 AS (SELECT s, {mul(f"xor(x, x // {1 << 29}::UHUGEINT)", p3)} AS x FROM x4),
hs AS (SELECT s, xor(x, x // {1 << 32}::UHUGEINT)::UBIGINT AS hash FROM x5),
f AS (SELECT rid, {bits} AS fp FROM g JOIN hs USING (s) GROUP BY rid), fps AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN f USING (rid)),
node AS (SELECT fp, min(doc_id) AS least FROM fps GROUP BY fp), link AS (SELECT a.fp AS x, b.fp AS y FROM node a JOIN node b ON bit_count(xor(a.fp, b.fp)) <= {radius}),
reach AS (SELECT fp AS x, fp AS y FROM node UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
c AS (SELECT x AS fp, min(least) AS component_id FROM reach JOIN node ON node.fp = y GROUP BY x)
SELECT doc_id, lower(printf('%016x', fp)) AS fingerprint, component_id FROM fps JOIN c USING (fp)"""


def lines_sql(shingle: int = 5) -> str:
    """All alike pairs, by exact similarity: two sets of similarity 0.8 share one of the rarest
    ``n - ceil(0.8 n) + 1`` shingles of each. Ids are taken to be unique."""
    return f"""WITH RECURSIVE x AS (SELECT doc_id, no - 1 AS no, string_split(text, chr(10))[no] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL)),
l AS (SELECT * FROM x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
u AS (SELECT line, row_number() OVER (ORDER BY min(doc_id) NULLS LAST, line) AS i FROM l GROUP BY line),
sh AS (SELECT DISTINCT i, substr(line, k, {shingle}) AS g FROM (SELECT i, line, unnest(range(1, len(line) - {shingle - 2})) AS k FROM u WHERE len(line) >= {shingle})),
n AS (SELECT i, count(*) AS n FROM sh GROUP BY i), fr AS (SELECT g, count(*) AS f FROM sh GROUP BY g),
pre AS (SELECT i, g, n FROM sh JOIN n USING (i) JOIN fr USING (g) QUALIFY row_number() OVER (PARTITION BY i ORDER BY f, g) <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.i AS a, b.i AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b USING (g) WHERE a.i < b.i AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
pair AS (SELECT a, b FROM cand JOIN sh x ON x.i = a JOIN sh y ON y.i = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 10 * count(*) >= 8 * (na + nb - count(*))),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT a AS i, a AS root FROM link UNION SELECT b, root FROM reach JOIN link ON a = i),
root AS (SELECT i, min(root) AS root FROM reach GROUP BY i),
p AS (SELECT doc_id, no, row_number() OVER (PARTITION BY coalesce(root, i) ORDER BY doc_id NULLS LAST, no) AS place FROM l JOIN u USING (line) LEFT JOIN root USING (i)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (place = 1) AS n_kept, string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (place = 1) AS kept_lines FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(kept_lines, '') AS kept_lines FROM documents LEFT JOIN k USING (doc_id)"""


def pipeline_sql(limit: int) -> str:
    """The stages in a row, each query over what the one before keeps. Ids are taken to be
    unique, and no document to pass half a shard (the copies of one cannot be told apart here)."""
    of = lambda sql, name: sql.replace("FROM documents", f"FROM {name}")
    return f"""WITH good AS MATERIALIZED (SELECT * FROM documents SEMI JOIN (SELECT doc_id FROM ({quality_sql()}) WHERE kept) USING (doc_id)),
single AS MATERIALIZED (SELECT * FROM good SEMI JOIN (SELECT doc_id FROM ({of(simhash_sql(), "good")}) WHERE doc_id = component_id) USING (doc_id)),
clean AS MATERIALIZED (SELECT * FROM single SEMI JOIN (SELECT doc_id FROM ({of(decontamination_sql(), "single")}) WHERE NOT contaminated) USING (doc_id)),
mixed AS MATERIALIZED (SELECT clean.* FROM (SELECT doc_id, unnest(range(n_copies)) FROM ({of(mixing_sql(), "clean")})) JOIN clean USING (doc_id)),
place AS MATERIALIZED (SELECT doc_id, shard, shard_bytes FROM ({of(sharding_sql(limit), "mixed")}))
SELECT mixed.*, shard, shard_bytes FROM mixed JOIN place USING (doc_id)"""
