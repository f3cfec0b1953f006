"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import udfs as U
from ..operators import gazetteer
from ..sources import articles as A
from ..sources.tables import table
from .registered import Plans, sql_list

plans = Plans()


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z가-힣]+'), lambda t: lower(t)), lambda t: length(t) >= 3 AND NOT list_contains({sql_list(L.TITLE_STOPWORDS)}, t)))"


def bigrams_sql(tokens: str) -> str:
    return f"list_distinct(flatten(list_transform({tokens}, lambda w: CASE WHEN length(w) <= 2 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END)))"


def phrase_sql(text: str, phrase: str) -> str:
    escaped = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in phrase.lower())
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9]){escaped}($|[^a-z0-9])')"


def grounded_sql(text: str, name: str) -> str:
    return "(" + " OR ".join(phrase_sql(text, a) for a in L.ALIASES[name]) + ")"


def first_line_sql(c: str = "text") -> str:
    return f"coalesce(split_part({c}, chr(10), 1), '')"


@plans.add("SELECT page_id, substr(md5(url), 1, 12) AS news_id FROM pages")
def news_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.news_id(F.col("url")).alias("news_id"))


@plans.add("SELECT doc_id, CASE WHEN coalesce(regexp_matches(text, '[가-힣]'), false) THEN 'ko' ELSE 'en' END AS language FROM documents")
def language_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.language_flag(F.col("text")).alias("language"))


@plans.add(f"SELECT doc_id, len({tokens_sql('text')})::BIGINT AS n_tokens, md5(array_to_string(list_sort({tokens_sql('text')}), ' ')) AS tokens_md5 FROM documents")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    return table(spark, sf, "documents").select("doc_id", T.title_tokens(F.col("text")).alias("tokens")).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens_md5"))


@plans.add(f"SELECT doc_id, len({bigrams_sql(tokens_sql(first_line_sql()))})::BIGINT AS n_bigrams, md5(array_to_string(list_sort({bigrams_sql(tokens_sql(first_line_sql()))}), ' ')) AS bigrams_md5 FROM documents")
def title_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    b = T.bigrams(T.title_tokens(F.element_at(F.split("text", "\n"), 1)))
    return table(spark, sf, "documents").select("doc_id", F.size(b).cast("long").alias("n_bigrams"), F.md5(F.array_join(F.array_sort(b), " ")).alias("bigrams_md5"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation beside the next one."""
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    return a.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


TURNS = f"""WITH p AS (SELECT x.conv_id, x.turn, {tokens_sql('x.text')} AS a, {tokens_sql('y.text')} AS b
    FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""


@plans.add(
    TURNS
    + f""", g AS (SELECT conv_id, turn, a, b, {bigrams_sql('a')} AS ga, {bigrams_sql('b')} AS gb FROM p)
    SELECT conv_id, turn,
      round(CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) ELSE 0 END, 6) AS dice,
      round(CASE WHEN len(ga) > 0 THEN len(list_intersect(ga, gb))::DOUBLE / len(ga) ELSE 0 END, 6) AS containment,
      round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM g"""
)
def turn_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = _turns(spark, sf).select("conv_id", "turn", T.title_tokens(F.col("a")).alias("a"), T.title_tokens(F.col("b")).alias("b"))
    p = p.withColumns({"ga": T.bigrams(F.col("a")), "gb": T.bigrams(F.col("b"))})
    return p.select(
        "conv_id", "turn", F.round(T.dice(F.col("ga"), F.col("gb")), 6).alias("dice"), F.round(T.containment(F.col("ga"), F.col("gb")), 6).alias("containment"),
        F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"),
    )


@plans.add("SELECT doc_id, md5(regexp_replace(lower(text), '[^0-9a-z가-힣%.]', '', 'g')) AS compact_md5, md5(regexp_replace(lower(text), '[^0-9A-Za-z가-힣]+', '', 'g')) AS title_key_md5, length(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))::BIGINT AS signal FROM documents")
def compact_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.compact_key(c)).alias("compact_md5"), F.md5(T.title_key(c)).alias("title_key_md5"), T.signal_length(c).cast("long").alias("signal"))


@plans.add(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md5,
    md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS paragraphs_md5 FROM documents""")
def normal_spaces(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.collapse(c)).alias("collapsed_md5"), F.md5(T.paragraphs(c)).alias("paragraphs_md5"))


@plans.add("""SELECT p_partkey, CASE WHEN regexp_matches(t, '^[0-9][0-9A-Z]{5}$') THEN t END AS ticker FROM (
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '^(KRX|KOSPI|KOSDAQ|KONEX):', ''), '\\.(KS|KQ)$', ''), '^A([0-9]{6})$', '\\1') AS t FROM (
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'krx:' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 1 THEN 'A' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 2 THEN lpad(p_partkey::VARCHAR, 6, '0') || '.ks' WHEN 3 THEN ' ' || p_brand ELSE '0' || upper(substr(p_type, 1, 5)) END AS raw FROM part))""".replace("\\\\", "\\"))
def ticker_codes(spark: SparkSession, sf: str) -> DataFrame:
    k, code = F.col("p_partkey") % 5, F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    raw = F.when(k == 0, F.concat(F.lit("krx:"), code)).when(k == 1, F.concat(F.lit("A"), code)).when(k == 2, F.concat(code, F.lit(".ks"))).when(k == 3, F.concat(F.lit(" "), "p_brand")).otherwise(F.concat(F.lit("0"), F.upper(F.substring("p_type", 1, 5))))
    return table(spark, sf, "part").select("p_partkey", T.ticker(raw).alias("ticker"))


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    spellings = tuple((n, a) for n, some in L.ALIASES.items() for a in some)
    return table(spark, sf, "documents").select("doc_id", gazetteer.names_in(F.col("text"), spellings).alias("words"))


WORDS_SQL = "[x for x in [" + ", ".join(f"CASE WHEN {grounded_sql('text', n)} THEN '{n}' END" for n in L.ALIASES) + "] if x IS NOT NULL]"


@plans.add(f"SELECT doc_id, array_to_string({WORDS_SQL}, ',') AS words FROM documents")
def grounded_words(spark: SparkSession, sf: str) -> DataFrame:
    return _grounded(spark, sf).select("doc_id", F.array_join("words", ",").alias("words"))


GAZETTEER = """WITH g AS (SELECT 'n' || r_regionkey AS name, lower(r_name) AS spelling FROM region UNION SELECT 'n' || n_nationkey, lower(left(n_name, 3)) FROM nation UNION SELECT 'w' || l, w FROM (VALUES (1, 'the'), (2, 'than'), (3, 'la'), (4, 'in')) AS v(l, w)),
    d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, name, unnest(regexp_extract_all(t, '(^|[^a-z0-9])' || spelling || '($|[^a-z0-9])')) FROM (SELECT doc_id, name, spelling, regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g') AS t FROM d, g)) GROUP BY 1, 2"""


@plans.add(GAZETTEER)
def gazetteer_names(spark: SparkSession, sf: str) -> DataFrame:
    """How often each name of a table of spellings stands in each document."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    some = r.select(F.concat(F.lit("n"), "r_regionkey").alias("name"), F.lower("r_name").alias("spelling")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.lower(F.substring("n_name", 1, 3)).alias("spelling")))
    words = F.inline(F.array(*[F.struct(F.lit(f"w{i}").alias("name"), F.lit(w).alias("spelling")) for i, w in enumerate(("the", "than", "la", "in"), 1)]))
    spellings = some.unionByName(r.limit(1).select(words))
    hits = gazetteer.found(table(spark, sf, "documents"), "doc_id", "text", spellings, exclusive=False, bordered=True)
    return hits.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def _category_sql() -> str:
    score = {name: " + ".join(f"CASE WHEN {grounded_sql('text', c)} THEN 1 ELSE 0 END" for c in some) for name, some in L.CATEGORY_CUES.items()}
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{n}' AS name, {s} AS score FROM documents" for i, (n, s) in enumerate(score.items()))
    return f"""WITH s AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n FROM s WHERE score > 0)
        SELECT d.doc_id, coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM r WHERE r.doc_id = d.doc_id AND n <= 2), '') AS categories FROM documents d"""


@plans.add(_category_sql())
def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _grounded(spark, sf).select("doc_id", F.array_join(T.rule_categories(F.col("words")), ",").alias("categories"))


@plans.add("""SELECT doc_id, md5(CASE WHEN t = '' AND d = '' THEN '' ELSE 'Title: ' || t || chr(10) || 'Description: ' || d END) AS map_text_md5, news_id, published_at FROM (
    SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 500) AS t, substr(array_to_string(string_split(text, chr(10))[2:], ' '), 1, 6000) AS d,
      substr(md5('https://' || source || '.example.com/' || doc_id), 1, 12) AS news_id, strftime(make_timestamp((1767225600 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM documents)""")
def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    a = A.article_view(table(spark, sf, "documents"))
    return a.select("doc_id", F.md5(T.map_text(F.col("title"), F.col("description"))).alias("map_text_md5"), "news_id", "published_at")


@plans.add("""SELECT c_custkey, CASE WHEN regexp_matches(ltrim(x), '^[=+@-]') THEN '''' || x ELSE x END AS guarded FROM (
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN ' +' || c_name WHEN 2 THEN '-' || floor(c_acctbal)::BIGINT ELSE c_name END AS x FROM customer)""")
def formula_guard(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat(F.lit(" +"), "c_name")).when(k == 2, F.concat(F.lit("-"), F.floor("c_acctbal").cast("long").cast("string"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", T.guard_formula(x).alias("guarded"))


@plans.add("SELECT o_orderkey, o_orderdate AS parsed, o_orderdate AS compact_parsed FROM orders")
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    rfc = F.concat(F.lit("Mon, "), F.date_format("d", "dd"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in A.MONTHS]), F.month("d")), F.lit(" "), F.date_format("d", "yyyy HH:mm:ss"), F.lit(" +0000"))
    short = F.date_format("d", "yyyyMMdd'T'HHmmss'Z'")
    return o.select("o_orderkey", A.rfc822(rfc).cast("timestamp_ntz").alias("parsed"), F.try_to_timestamp(short, F.lit("yyyyMMdd'T'HHmmssX")).cast("timestamp_ntz").alias("compact_parsed"))


URLS = """WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS q FROM pages),
    k AS (SELECT *, list_sort(list_filter(q, lambda x: contains(x, '=') AND split_part(x, '=', 2) <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid'))) AS few,
      list_sort(list_filter(q, lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'source'))) AS wide FROM u)
    SELECT page_id, lower(scheme) || '://' || lower(host) || rtrim(path, '/') || CASE WHEN len(few) > 0 THEN '?' || array_to_string(few, '&') ELSE '' END AS canonical,
      regexp_replace(lower(host), '^(www|m)[.]', '') || CASE WHEN rtrim(path, '/') = '' THEN path ELSE rtrim(path, '/') END || CASE WHEN len(wide) > 0 THEN '?' || array_to_string(wide, '&') ELSE '' END AS host_key FROM k"""


@plans.add(URLS)
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.canonical_url("url").alias("canonical"), U.host_url_key("url").alias("host_key"))


#: For texts without entities, tags, compatibility forms and press tags, as the table's are.
CLEAN = r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents),
    s AS (SELECT *, trim(regexp_replace(replace(replace(text, 's&p', 'snp'), '⋯', '...'), '\s+', ' ', 'g')) AS n FROM c)
    SELECT doc_id, md5(c) AS clean_md5, md5(CASE WHEN ends_with(n, '...') THEN regexp_replace(n, '\s*\S*\.{3,}$', '') ELSE n END) AS normal_md5 FROM s"""


@plans.add(CLEAN)
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(U.clean_text("text")).alias("clean_md5"), F.md5(U.normalise("text")).alias("normal_md5"))


def content_tokens_sql(c: str) -> str:
    cut = lambda w, some: f"regexp_replace({w}, '^(.{{2,}}?)({'|'.join(sorted(some, key=len, reverse=True))})$', '\\1')"
    stem = f"CASE WHEN regexp_matches(w, '^[0-9]') THEN w ELSE {cut(cut('w', L.ENDINGS), L.PARTICLES)} END"
    found = f"regexp_extract_all(lower(coalesce({c}, '')), '[가-힣]+|[a-z][a-z0-9+]*|[0-9]+(?:[.][0-9]+)?%?')"
    return f"list_filter(list_transform({found}, lambda w: {stem}), lambda w: length(w) >= 2 AND NOT list_contains({sql_list(L.CONTENT_STOPWORDS)}, w))"


@plans.add(f"SELECT doc_id, len({content_tokens_sql('text')})::BIGINT AS n, md5(array_to_string({content_tokens_sql('text')}, ' ')) AS tokens_md5 FROM documents")
def content_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    return table(spark, sf, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("tokens")).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


QUERIES, ORACLE = plans.queries, plans.oracle
