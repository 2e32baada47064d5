"""DuckDB SQL for the corpus queries that SQL can express on small tables."""

from .licenses import PHRASES, TEMPLATES, THRESHOLD, template_words

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
x AS (SELECT p.page_id, g.keep, octet_length(encode(p.h)) AS n, sha1(p.h) AS s FROM p JOIN g USING (h))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM x
"""

OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT t, min(doc_id) AS least FROM v GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN m USING (t) WHERE least < doc_id),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM o ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP7 = (
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(LOWER_D, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(LOWER_D, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS t
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS t
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(ids.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
).replace("LOWER_D", _LOWER.format("coalesce(text, '')"))


def _level(name: str, parent: list[str], path: list[str], weights: str, above: str, columns: str = "") -> str:
    """CTEs that split the budgets of `above` among the children at one level, by whole-number water-filling."""
    over = f"PARTITION BY {', '.join(parent) or '0'}"
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    child = path[-1]
    return f"""
{name}_n AS (SELECT {', '.join(path)}, capacity, tokens, given, {weights}::HUGEINT AS weight
  FROM (SELECT {', '.join(path)}, sum(capacity)::HUGEINT AS capacity, sum(tokens)::HUGEINT AS tokens FROM tree GROUP BY ALL) {join}),
{name}_s AS (SELECT *, coalesce(sum(capacity) OVER ({over} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
  sum(weight) OVER ({over} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS left_weight FROM {name}_n),
{name}_f AS (SELECT *, capacity * left_weight <= (given - used) * weight AS fits FROM {name}_s),
{name}_r AS (SELECT *, min(CASE WHEN NOT fits THEN used END) OVER ({over}) AS ru, max(CASE WHEN NOT fits THEN left_weight END) OVER ({over}) AS rw FROM {name}_f),
{name} AS (SELECT {', '.join(path)}, tokens, CASE WHEN fits THEN capacity ELSE ((given - ru) * weight) // rw END AS given FROM {name}_r)"""


_WEIGHTS = {"domain": "CASE domain WHEN 'web' THEN 3 WHEN 'curated' THEN 2 ELSE 1 END", "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "source": "1"}

OP4 = rf"""
WITH rows_ AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_matches(source, '[02468]$') THEN 'web' ELSE 'curated' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM rows_ GROUP BY ALL),
tree AS (SELECT *, tokens * 2 AS capacity FROM leaves),
root AS (SELECT least((sum(tokens) * 3)::HUGEINT // 5, sum(capacity)::HUGEINT) AS given FROM tree),
{_level("l1", [], ["domain"], _WEIGHTS["domain"], "root")},
l1g AS (SELECT domain, given FROM l1),
{_level("l2", ["domain"], ["domain", "lang"], _WEIGHTS["lang"], "l1g")},
l2g AS (SELECT domain, lang, given FROM l2),
{_level("l3", ["domain", "lang"], ["domain", "lang", "source"], _WEIGHTS["source"], "l2g")},
budget AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM l3),
placed AS (SELECT r.*, whole, rest, md5('mix-1:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM rows_ r JOIN budget USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS start FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CASE WHEN n_tokens > 0 THEN whole + CASE WHEN start < rest THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies FROM run
"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.replace('LOWER', _LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
ph(label, pw) AS (VALUES {', '.join(f"('{label}', {_list(p.split())})" for p, label in PHRASES.items())}),
hit AS (SELECT r, label, i - 1 AS place FROM (SELECT r, ws, label, pw, unnest(range(1, len(ws) - len(pw) + 2)) AS i FROM d, ph WHERE len(ws) >= len(pw)) WHERE list_slice(ws, i, i + len(pw) - 1) = pw),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r),
tm(label, tw) AS (VALUES {', '.join(f"('{k}', {_list(sorted(w.decode() for w in v))})" for k, v in template_words(TEMPLATES).items())}),
paras AS (SELECT r, unnest(string_split_regex(t, '\n[\x20\x09\x0b-\x0d]*\n')) AS p FROM d),
bl AS (SELECT r, {_WORDS.replace('LOWER', _LOWER.format("b"))} AS bs FROM (SELECT r, p AS b FROM paras UNION ALL SELECT r, unnest(string_split(p, chr(10))) FROM paras)),
met AS (SELECT r, label, max(share) AS share FROM (SELECT r, label, len(list_intersect(list_distinct(bs), tw))::DOUBLE / len(tw) AS share FROM bl, tm) WHERE share >= {THRESHOLD} - 1e-12 GROUP BY ALL),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hit UNION ALL SELECT r, label FROM met) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.z::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""

#: Unsigned CRC-32 of the string {0}, byte by byte over the 256 remainders that the reversed polynomial gives.
_CRC = """xor(list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::BIGINT),
  lambda c, b: xor(c >> 8, [REMAINDERS][(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _remainder(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_CRC = _CRC.replace("REMAINDERS", ", ".join(f"{_remainder(i)}::BIGINT" for i in range(256)))

OP11 = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format("s")} AS h FROM runs),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)::INT[]) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (other_n, -o)) AS other, max(other_n) AS other_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other) AS o FROM near) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS last, form AS further FROM f UNION ALL SELECT steps.word, f.word, f.form FROM steps JOIN f ON steps.further = f.word)
SELECT word, f.form, last AS root, n, n_near, form_n FROM f JOIN steps USING (word) WHERE further IS NULL
"""

OP12 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CASE WHEN doc_id IS NULL THEN 1 ELSE {_CRC.format("doc_id::VARCHAR")} END AS h FROM documents),
g AS (SELECT *, h // 10 AS g, len(ws)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w),
x AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS ws FROM g),
grp AS (SELECT r, i, hash(list_slice(ws, i + 1, i + 8)) AS k, list_slice(ws, i + 1, i + 8) AS t FROM (SELECT r, ws, unnest(range(0, n - 7)) AS i FROM x WHERE n >= 24)),
pair AS (SELECT a.r, a.i, b.i - a.i AS q FROM grp a JOIN grp b ON a.r = b.r AND a.k = b.k AND a.i < b.i AND a.t = b.t),
isle AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 8 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair) GROUP BY r, q, island),
run AS (SELECT r, s, length, min(q) AS q FROM isle WHERE length >= greatest(24, 3 * q) GROUP BY r, s, length),
best AS (SELECT r, s, length, q FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE a.r = b.r AND (b.length * a.q > a.length * b.q OR (b.length * a.q = a.length * b.q AND (b.s, b.q) < (a.s, a.q))))),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + length)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(ws) AS word, unnest(range(0, n)) AS i FROM x) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (r) LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op1_exact_dedup": OP1, "op3_warc": OP3, "op4_mixing": OP4, "op5_substring_dedup": OP5, "op7_decontam": OP7, "op10_license": OP10, "op11_spelling_variants": OP11, "op12_periodic_runs": OP12}
