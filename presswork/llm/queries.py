"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, filter_audit, language, main_text, mixing, ogg, pii, secrets, simhash, substrings, token_counts, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    return decontamination.digest(found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(table(spark, sf_dir, "documents")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicate(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.digest(docs, language.train(docs))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.store_texts(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
  x AS (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda s: w[s:s + 9]) END) AS v FROM i),
  win AS (SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS k FROM x),
  p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win)),
  g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM p),
  hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM g JOIN win USING (n, k)),
  c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY 1),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1),
  every AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d), freq AS (SELECT word, count(*) AS f FROM every GROUP BY word),
  q AS (SELECT item_id, v, unnest(v) AS word, generate_subscripts(v, 1) AS k FROM (SELECT DISTINCT item_id, v FROM x)),
  rare AS (SELECT item_id, v, arg_min(word, (f, k)) AS word FROM q JOIN freq USING (word) GROUP BY item_id, v HAVING count(*) = len(v)),
  close AS (SELECT DISTINCT e.doc_id, r.item_id::VARCHAR AS item FROM every e JOIN rare r USING (word) JOIN d USING (doc_id) WHERE list_has_all(d.w[greatest(e.pos - {decontamination.SLOP}, 1):e.pos + {decontamination.SLOP}], r.v)),
  a AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM close GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near, '') AS near
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN a USING (doc_id)"""

OP4 = r"""WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15) AS h FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
  w AS (SELECT *, ([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::BIGINT AS w, 3 * source_size AS cap FROM s),
  f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_, (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM w),
  l AS (SELECT arg_min(left_ / w_left, (cap / w, coalesce(source, '~~~~'))) FILTER (cap / w >= left_ / w_left) AS level FROM f),
  t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM f, l),
  n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
  m AS (SELECT *, round(target - copies * source_size)::BIGINT AS need FROM n),
  g AS (SELECT source, h, sum(size)::BIGINT AS s, count(*) AS k FROM b GROUP BY 1, 2),
  u AS (SELECT *, (sum(s) OVER (PARTITION BY source ORDER BY h) - s)::BIGINT AS before FROM g),
  e AS (SELECT m.source, u.h AS cut, m.need - u.before AS edge_take, u.s AS edge_size, u.k AS edge_rows FROM m JOIN u ON m.source IS NOT DISTINCT FROM u.source WHERE u.before <= m.need AND u.before + u.s > m.need)
  SELECT b.doc_id, b.size, m.source_size, m.target, (m.copies * b.size + CASE WHEN b.h < coalesce(e.cut, 'g') THEN b.size WHEN b.h = e.cut AND e.edge_rows = 1 AND 2 * e.edge_take >= e.edge_size AND e.edge_take > 0 THEN b.size
    WHEN b.h = e.cut AND e.edge_rows > 1 THEN b.size * e.edge_take // e.edge_size ELSE 0 END)::BIGINT AS taken
  FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM m.source"""


def _op8() -> str:
    kinds = {**secrets.BASE, **secrets.ADDED}
    rows = []
    for rank, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        p = pattern.replace("'", "''")
        rows.append(
            f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, unnest(hits) AS hit, unnest(vals) AS value, unnest(starts) AS start FROM ("
            f"SELECT doc_id, source, hits, vals, list_transform(range(1, len(hits) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)) AS starts FROM ("
            f"SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{p}') AS hits, regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS vals, string_split_regex(coalesce(text, ''), '{p}') AS gaps FROM documents)) "
        )
    least = " ".join(f"WHEN {i} THEN {spec[2]}" for i, spec in enumerate(kinds.values()))
    return f"""WITH every AS ({' UNION ALL '.join(rows)}), s AS (SELECT *, (start + length(hit))::BIGINT AS "end" FROM every WHERE length(value) >= CASE rank {least} END),
      o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT doc_id) AS repositories FROM s GROUP BY 1),
      v AS (SELECT s.*, kind || ':' || start::BIGINT || ':' || "end" AS span, owners <= {secrets.MAX_LIVE_OWNERS} AND repositories <= {secrets.MAX_LIVE_REPOSITORIES} AS live FROM s JOIN o USING (value)),
      g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM v GROUP BY 1)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
      FROM documents d LEFT JOIN g USING (doc_id)"""


# The given pages have one article each, of a heading and paragraphs; SQL cuts it out by its tags.
OP11 = r"""WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?h1>|</?p>') AS parts FROM pages),
  b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g')) AS parts FROM a),
  d AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g')) AS parts FROM b),
  c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\xA0]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)
  SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
  k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
  c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN k USING (doc_id) GROUP BY 1, 2),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[:step - 1] AS earlier FROM o, range(1, 6) AS r(step)),
  r AS (SELECT part, filter_order, step, n, good, toxic, contains(fails, f) AS own, len(translate(earlier, fails, '')) < len(earlier) AS gone, fails = f AS alone, 120 // greatest(len(fails), 1) AS share FROM s, c)
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost, coalesce(sum(n * share) FILTER (own), 0)::BIGINT AS shapley
  FROM r GROUP BY 1, 2, 3"""


OP13 = r"""WITH RECURSIVE
  k AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT), 4294967295) % 20 AS damage FROM conversations),
  d AS (SELECT conv, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE damage <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS seen FROM d),
  f AS (SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS dup, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM o),
  r AS (SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND NOT regexp_matches(seen, '[.!?]$') AS cut FROM f),
  n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM r GROUP BY 1),
  p AS (SELECT conv, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS q0, {'c': 1000000000000::BIGINT, 'a': ''} AS q1, {'c': 3::BIGINT, 'a': 'I'} AS q2, {'c': 6::BIGINT, 'a': 'II'} AS q3 FROM n
    UNION ALL SELECT conv, i, q0, q1, q2, list_sort([q3, {'c': q2.c + 3, 'a': q2.a || 'I'}])[1] FROM (
      SELECT conv, i, q0, q1, list_sort([q2, {'c': q0.c + 3, 'a': q0.a || 'I'}, {'c': q1.c + 3, 'a': q1.a || 'I'}, {'c': q3.c + 3, 'a': q3.a || 'I'}])[1] AS q2, q3 FROM (
        SELECT p.conv, r.i, {'c': q0.c + 4, 'a': q0.a || 'D'} AS q0,
          list_sort([{'c': q1.c + 4, 'a': q1.a || 'D'}, {'c': CASE WHEN gone OR x <> 's' THEN 1000000000000 ELSE q0.c + 3 * cut::INT END, 'a': q0.a || 'K'}])[1] AS q1,
          list_sort([{'c': q2.c + 4, 'a': q2.a || 'D'}] || list_transform([q0, q1, q3], lambda q: {'c': CASE WHEN gone THEN 1000000000000 WHEN x = 'u' THEN q.c + 3 * cut::INT ELSE q.c + 3 + 3 * cut::INT END, 'a': q.a || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END}))[1] AS q2,
          list_sort([{'c': q3.c + 4, 'a': q3.a || 'D'}, {'c': CASE WHEN gone THEN 1000000000000 WHEN x = 'a' THEN q2.c + 3 * cut::INT ELSE q2.c + 3 + 3 * cut::INT END, 'a': q2.a || CASE WHEN x = 'a' THEN 'K' ELSE 'R' END}])[1] AS q3
        FROM p JOIN r ON r.conv = p.conv AND r.i = p.i + 1))),
  b AS (SELECT conv, list_sort([q0, q3])[1] AS best FROM p JOIN n USING (conv) WHERE i = last),
  e AS (SELECT conv, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM b),
  g AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv ORDER BY j) AS i FROM e),
  h AS (SELECT g.conv, edit, r.role, r.text, row_number() OVER (PARTITION BY g.conv ORDER BY j) AS k, count(*) OVER (PARTITION BY g.conv) AS m FROM g LEFT JOIN r ON r.conv = g.conv AND r.i = g.i WHERE edit <> 'D' AND edit <> ''),
  s AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines FROM h GROUP BY 1),
  c AS (SELECT min(conv_id) AS conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations GROUP BY 2)
  SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
  FROM c LEFT JOIN n USING (conv) LEFT JOIN b USING (conv) LEFT JOIN s USING (conv)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; doc_id is unique in its tables."""
    return {"op1_decontamination": OP1, "op4_mixing": OP4, "op8_secrets": _op8(), "op11_main_text": OP11, "op12_filter_audit": OP12, "op13_conversation_repair": OP13}
