"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from vitals.llm.licenses import (
    BLOCK_END,
    BREAK,
    LONG_LINE,
    LOWER,
    PHRASES,
    TEMPLATES,
    UPPER,
    needed,
    template_tokens,
)
from vitals.llm.near_dedup import SIMILARITY
from vitals.llm.quality import (
    BASE_RULES,
    MAX_HOST_RATE,
    MAX_WEIGHT,
    MIN_WEIGHT,
    RULES,
)
from vitals.llm.shards import HASH_BITS, LIMIT_BYTES
from vitals.llm.url_filter import GLOB_RULES, HOST_RULES
from vitals.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_RATES = ", ".join(
    f"(f_{r} + m_{r} * w_{r}) / (n_docs + w_{r}) AS rate_{r}" for r in RULES
)

NEAR_DEDUP = f"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM word WHERE len(w) > 1)
    UNION ALL SELECT doc_id, w[1] FROM word WHERE len(w) = 1)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= {SIMILARITY} * (p.n + q.n - c)
), reach(id, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT link.b, low FROM reach JOIN link ON link.a = id AND low < link.b
), lowest AS (
  SELECT id, min(low) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN lowest ON lowest.id = d.doc_id
"""

QUALITY = f"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents
), word AS (
  SELECT row_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM doc
), win AS (
  SELECT row_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT row_id, words, unnest(range(1, greatest(1, len(words) - 1))) AS i FROM word)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM win) WHERE c > 1
), repeated AS (
  SELECT row_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT row_id, i + d AS p FROM twice, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY row_id
), counted AS (
  SELECT d.row_id, d.doc_id, d.source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM doc d JOIN word USING (row_id) LEFT JOIN repeated USING (row_id)
), marked AS (
  SELECT *, {", ".join(f"({rule}) AS fails_{name}" for name, rule in RULES.items())} FROM counted
), host AS (
  SELECT source, count(*) AS n_docs, {", ".join(f"sum(fails_{r}::INT)::DOUBLE AS f_{r}" for r in RULES)}
  FROM marked WHERE source IS NOT NULL GROUP BY source
), mean AS (
  SELECT {", ".join(f"sum(f_{r}) / sum(n_docs) AS m_{r}, sum(f_{r} * f_{r} / n_docs) / sum(n_docs) AS s_{r}" for r in RULES)}
  FROM host
), prior AS (
  SELECT *, {", ".join(f"least(greatest(m_{r} * (1 - m_{r}) / greatest(s_{r} - m_{r} * m_{r}, 1e-9) - 1, {MIN_WEIGHT}), {MAX_WEIGHT}) AS w_{r}" for r in RULES)}
  FROM mean
), rate AS (
  SELECT source, greatest({", ".join(f"rate_{r}" for r in RULES)}) AS host_rate
  FROM (SELECT source, {_RATES} FROM host, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({" OR ".join(f"fails_{r}" for r in BASE_RULES)}) AS base_failed,
       NOT ({" OR ".join(f"fails_{r}" for r in BASE_RULES)})
         AND NOT coalesce(host_rate > {MAX_HOST_RATE}, false) AS kept
FROM marked LEFT JOIN rate USING (source)
"""

SHARDS = f"""
WITH item AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         row_number() OVER (PARTITION BY doc_id, coalesce(strlen(text), 0)) - 1 AS copy FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, {HASH_BITS // 4}))::BIGINT AS bits
  FROM item
), laid AS (
  SELECT doc_id, n_bytes, copy, bits, d AS depth, bits >> ({HASH_BITS} - d) AS prefix
  FROM hashed, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS d)
), bucket AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM laid GROUP BY depth, prefix
  HAVING sum(n_bytes) <= {LIMIT_BYTES} OR count(*) = 1 OR depth = {HASH_BITS}
), ended AS (
  SELECT doc_id, n_bytes, copy, depth, bits, shard_bytes
  FROM laid JOIN bucket USING (depth, prefix)
  QUALIFY row_number() OVER (PARTITION BY doc_id, n_bytes, copy ORDER BY depth) = 1
)
SELECT doc_id, n_bytes, copy, substr(right(lpad(to_binary(bits), 64, '0'), {HASH_BITS}), 1, depth::INT) AS shard,
       depth::INT AS depth, shard_bytes
FROM ended
"""


def _host_fit(rule) -> str:
    host, slash, path = rule.name.partition("/")
    return f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '{slash + path}'))"


_HOST_RULES = sorted(HOST_RULES, key=lambda r: -len(r.name))

URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), stem AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS stem FROM cut
), part AS (
  SELECT page_id, translate(regexp_extract(stem, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(stem, length(regexp_extract(stem, '^[^/]*')) + 1) AS path FROM stem
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_host_fit(r)} THEN '{r.name}'" for r in _HOST_RULES)} END AS rule FROM part
)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in _HOST_RULES)}
       {" ".join(f"WHEN contains('.' || host || ' ' || path, '{r.name.strip('*')}') THEN '{r.verdict}'" for r in GLOB_RULES)}
       ELSE 'allow' END AS verdict
FROM ruled
"""

def _strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '')"


_TEMPLATES = ", ".join(
    f"('{t.label}', {_strings(own)}, {needed(len(own))})" for t in TEMPLATES if (own := template_tokens(t.text))
)

LICENSES = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), word AS (
  SELECT rid, doc_id, text, {_words("text")} AS w FROM doc
), phrase(label, p) AS (
  VALUES {", ".join(f"('{label}', {_strings(phrase.split(' '))})" for label, phrase in PHRASES)}
), place AS (
  SELECT rid, label, i FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM word)
  JOIN phrase ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY rid
), block AS (
  SELECT rid, {_words("b")} AS w
  FROM (SELECT rid, unnest(list_concat(regexp_extract_all(text, '{LONG_LINE}'), string_split_regex(text, '{BLOCK_END}'))) AS b FROM doc)
), held AS (
  SELECT rid, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS tokens
  FROM block WHERE len(w) > 0
), template(label, t, needed) AS (
  VALUES {_TEMPLATES}
), met AS (
  SELECT rid, label, len(list_intersect(t, tokens)) / len(t) AS containment FROM held, template
  WHERE len(tokens) >= needed AND len(list_intersect(t, tokens)) >= needed
), named AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label, true AS is_base FROM place UNION ALL SELECT rid, label, false FROM met) GROUP BY rid
), best AS (
  SELECT rid, max(containment) AS containment FROM met GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM word LEFT JOIN base USING (rid) LEFT JOIN named USING (rid) LEFT JOIN best USING (rid)
"""

def _nearest(n: int) -> str:
    """Parts with their nearest entry of book n, ties to the lower one."""
    return f"""near{n} AS MATERIALIZED (
  SELECT rid, part, any_value(p) AS p, min(struct_pack(d := d, entry := entry)).entry AS entry, min(d) AS d FROM (
    SELECT rid, part, p, entry,
           list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - b[i]) * (p[i] - b[i])))::BIGINT AS d
    FROM cut JOIN book{n} USING (part)) GROUP BY rid, part
)"""


def _moved(n: int) -> str:
    """Book n + 1: means rounded down; an entry without parts stays."""
    return f"""book{n + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, b) AS b FROM book{n} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m FROM (
      SELECT part, entry, i, sum(p[i]) AS s, count(*) AS n
      FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS i FROM near{n}) GROUP BY part, entry, i)
    GROUP BY part, entry) USING (part, entry)
)"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT rid, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p
  FROM (SELECT rid, v, unnest(range(0, {PARTS})) AS part FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, p AS b FROM cut WHERE rid <= {ENTRIES}
), {", ".join(f"{_nearest(n)}, {_moved(n)}" for n in range(ROUNDS))}, {_nearest(ROUNDS)}, coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY rid
), hashed AS (
  SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), hashed
"""

ORACLE = {
    "op2_near_dedup": NEAR_DEDUP,
    "op3_quality": QUALITY,
    "op6_shards": SHARDS,
    "op10_url_filter": URLS,
    "op11_licenses": LICENSES,
    "op13_vector_codes": VECTOR_CODES,
}
