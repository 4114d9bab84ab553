"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from cardloom.llm.owned_secrets import ACCESS, HEX, KINDS, LEAST_BITS, MAX_OWNERS, MAX_REPOSITORIES, MIXED, RUN

# SQL's case-insensitive flag folds more than ASCII, so each letter is spelt out both ways.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_KEYWORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _spans(pattern: str, kind: int, group: int, least: int) -> str:
    found, values, parts = f"regexp_extract_all(t, '{pattern}', 0)", f"regexp_extract_all(t, '{pattern}', {group})", f"string_split_regex(t, '{pattern}')"
    start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT list_transform(list_filter(range(1, len(f) + 1), lambda i: length(v[i]) >= {least}),
      lambda i: {{'s': CAST({start} AS INT), 'k': {kind}, 'e': CAST({start} + length(f[i]) AS INT), 'v': f[i]}}) FROM (SELECT {found} AS f, {values} AS v, {parts} AS g))"""


def _joined(spans: str) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"array_to_string(list_transform({spans}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"


_BITS = "-list_sum(list_transform(list_distinct(string_split(r, '')), lambda c: (length(r) - length(replace(r, c, ''))) / length(r) * log2((length(r) - length(replace(r, c, ''))) / length(r))))"
_RANDOM = f"len(list_filter(regexp_extract_all(x.v, '{RUN}'), lambda r: regexp_matches(r, '{MIXED}') AND round({_BITS}, 6) >= {LEAST_BITS})) > 0"
_COPIED = f"(owners > {MAX_OWNERS} OR repositories > {MAX_REPOSITORIES})"

SECRETS = f"""WITH d AS (SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, owner, repository,
  list_sort(list_concat(list_concat({_spans(_ASSIGN, 0, 2, 12)}, {_spans(ACCESS, 1, 0, 18)}), {_spans(HEX, 2, 0, 16)})) AS base,
  {_spans('[A-Za-z0-9_-]{20,}', 3, 0, 20)} AS more FROM d),
rows AS (SELECT doc_id, owner, repository, base, list_filter(more, lambda x: {_RANDOM}
  AND len(list_filter(base, lambda b: b.s < x.e AND x.s < b.e)) = 0) AS others FROM raw),
each AS (SELECT doc_id, owner, repository, unnest(list_concat(base, others)) AS x FROM rows),
known AS (SELECT x.v AS value, count(DISTINCT coalesce(owner, '')) AS owners, count(DISTINCT (coalesce(owner, ''), repository)) AS repositories FROM each GROUP BY x.v),
told AS (SELECT doc_id, list(x) FILTER (x.k = 3 AND NOT {_COPIED}) AS added, count(*) FILTER (x.k < 3 AND {_COPIED}) AS n_copied,
  count(*) FILTER (x.k < 3 AND NOT {_COPIED}) AS n_live FROM each JOIN known ON value = x.v GROUP BY doc_id)
SELECT doc_id, CAST(len(list_filter(base, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda x: x.k = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(base, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256({_joined('base')}) AS base_sha256,
  {_joined('list_sort(list_concat(base, coalesce(added, [])))')} AS spans, CAST(coalesce(len(added), 0) AS BIGINT) AS n_owned,
  CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM rows LEFT JOIN told USING (doc_id)"""

NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

# CRC-32 by a table from its polynomial, then the published jump loop on unsigned 64-bit states.
SHARDS = r"""WITH RECURSIVE digits AS (SELECT 0 AS step, i AS c, i AS v FROM range(256) t(i) UNION ALL
  SELECT step + 1, c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM digits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY c) AS tbl FROM digits WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT r, xor(list_reduce(list_concat([4294967295], list_transform(range(n), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
  lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc_table),
jump AS (SELECT r, shards, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, CAST((CAST(coalesce(doc_id, -1) AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS UHUGEINT) AS state FROM d, (VALUES (8), (9)) s(shards)
  UNION ALL SELECT r, shards, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT), next
  FROM (SELECT *, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS next FROM jump WHERE j < shards)),
placed AS (SELECT r, shards, b FROM jump WHERE j >= shards)
SELECT d.doc_id, n + 1 AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(p.b AS INT) AS shard,
  row_number() OVER (PARTITION BY p.b ORDER BY d.doc_id NULLS FIRST) - 1 AS slot, CAST(g.b AS INT) AS grown_shard
FROM d JOIN crc USING (r) JOIN placed p ON p.r = d.r AND p.shards = 8 JOIN placed g ON g.r = d.r AND g.shards = 9"""
