"""Article documents: mapping, metadata, cards, images, vectors and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import vectors as V
from ..sources.html import is_article_image

#: Fixed values. Most keywords and categories, seconds before a fallback is tried again, canned images.
MAX_KEYWORDS, MAX_CATEGORIES, RETRY_SECONDS, FALLBACK_IMAGES = 5, 2, 60, 5
SNAPSHOT = (
    "news_id", "title", "description", "summary", "source", "published_at", "url", "naver_url", "thumbnail_url", "keywords", "categories", "search_keyword", "search_rank", "searched_at",
)
PRIVATE = ("news_map_embedding", "embedding", "embedding_metadata", "cleaned_content", "generation_key", "worker_token")


def filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def article_id(df: DataFrame) -> Column:
    """The given id, else one made of the url or of the map text."""
    made = F.coalesce(filled("url"), T.map_text(F.col("title"), F.col("description")))
    return F.coalesce(filled("news_id"), T.news_id(made)) if "news_id" in df.columns else T.news_id(made)


def parse_time(c: Column) -> Column:
    """Timestamp of an ISO text or of YYYYMMDDTHHMMSSZ; no zone is UTC, else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmssX")), c.try_cast("timestamp"))


def source_struct(name: Column, domain: Column) -> Column:
    """struct<name, domain>: the name is the domain where it is missing, and 'unknown' without both."""
    n, d = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(domain), F.lit(""))
    return F.struct(F.coalesce(n, d, F.lit("unknown")).alias("name"), F.coalesce(d, F.lit("")).alias("domain"))


def to_documents(df: DataFrame, now: Column) -> DataFrame:
    """Stored form: nested source, timestamps, language, status."""
    return df.select(
        article_id(df).alias("news_id"), "url", "title", "description", source_struct(F.col("source"), F.try_parse_url("url", F.lit("HOST"))).alias("source"), parse_time(F.col("published_at")).alias("published_at"),
        T.language_flag(F.concat_ws(" ", "title", "description")).alias("language"), F.lit("active").alias("status"), F.lit(False).alias("is_deleted"), now.alias("collected_at"), now.alias("created_at"), now.alias("updated_at"),
    )


def from_documents(df: DataFrame) -> DataFrame:
    """Article form of live documents: missing texts empty, times as UTC text."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[-1])
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("published_at")
    return df.where(~F.coalesce("is_deleted", F.lit(False))).select("news_id", text("url"), text("title"), text("description"), F.coalesce("source.name", F.lit("")).alias("source"), when, F.coalesce("language", F.lit("en")).alias("language"))


def candidates(documents: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Newest live documents of a search, without bodies and vectors; a top-k, no full sort."""
    kept = documents.where((F.col("search_keyword") == keyword) & ~F.coalesce("is_deleted", F.lit(False)))
    return kept.drop(*PRIVATE).orderBy(F.col("published_at").desc_nulls_last(), "news_id").limit(limit)


def looked_up(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of a list of ids in the list's order (position); unknown ids are dropped."""
    return ids.join(articles, "news_id").orderBy("position")


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first by publication text, then id."""
    return df.orderBy(F.col("published_at").desc(), "news_id").offset(offset).limit(limit)


def stamped(df: DataFrame, sort: Column) -> DataFrame:
    """Search rank and end are kept for relevance order only: other orders can't be continued."""
    keep = sort == "relevance"
    return df.withColumns({c: F.when(keep, F.col(c)) for c in ("search_rank", "search_end") if c in df.columns})


def merged_pools(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Both pools, the first one's row where an id is in both."""
    return memory.unionByName(stored.join(memory.select("news_id"), "news_id", "left_anti"), allowMissingColumns=True)


def metadata_input(df: DataFrame) -> DataFrame:
    """meta_title (500), meta_body (6000) and basis: the body, else the description, else the title alone."""
    title = F.substring(T.collapse(F.coalesce(filled("title_original"), F.col("title"))) if "title_original" in df.columns else T.collapse(F.col("title")), 1, 500)
    body, desc = T.collapse(F.col("cleaned_content")), T.collapse(F.col("description"))
    chosen = F.when(body != "", body).otherwise(desc)
    alone = (chosen == "") | (chosen == title)
    basis = F.when(alone, "title").when(body != "", "body").otherwise("description")
    return df.withColumns({"meta_title": title, "meta_body": F.when(alone, "").otherwise(F.substring(chosen, 1, 6000)), "basis": basis})


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def canonical_name(word: Column) -> Column:
    """Name of a spelling, the word itself if it is none."""
    pairs = F.create_map(*[F.lit(x) for n, some in L.ALIASES.items() for a in some for x in (a.lower(), n)])
    clean = T.collapse(word)
    return F.coalesce(F.try_element_at(pairs, F.lower(clean)), clean)


def parsed_metadata(raw: Column, lowered: Column) -> Column:
    """struct<keywords, categories> of a model's answer: one JSON object, maybe fenced; keywords
    canonical, of 2 to 50 characters, in the text and distinct; known categories. Null if nothing is left."""
    bare = F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", "")
    answer = F.from_json(bare, "keywords array<string>, categories array<string>")
    pairs = F.create_map(*[F.lit(x) for n, some in L.ALIASES.items() for x in (n, F.array(*[F.lit(a.lower()) for a in some]))])
    spelled = lambda w: F.coalesce(F.try_element_at(pairs, w), F.array(F.lower(w)))
    ok = lambda w: F.length(w).between(2, 50) & ~F.lower(w).isin(*L.KEYWORD_STOPWORDS) & F.exists(spelled(w), lambda a: lowered.contains(a))
    words = F.array_distinct(F.filter(F.transform(F.coalesce(answer["keywords"], F.array().cast("array<string>")), canonical_name), ok))
    names = F.array_distinct(F.filter(F.transform(F.coalesce(answer["categories"], F.array().cast("array<string>")), T.collapse), lambda c: c.isin(*L.CATEGORY_CUES)))
    empty = (F.size(words) == 0) & (F.size(names) == 0) & (F.size(answer["keywords"]) + F.size(answer["categories"]) > 0)
    return F.when(answer["keywords"].isNotNull() & answer["categories"].isNotNull() & ~empty, F.struct(F.slice(words, 1, MAX_KEYWORDS).alias("keywords"), F.slice(names, 1, MAX_CATEGORIES).alias("categories")))


def reusable_metadata(state: Column, fingerprint: Column, now: Column) -> Column:
    """Whether stored metadata (input_hash, method, retry_after) still holds."""
    method = state["method"].isin("llm", "rules") | ((state["method"] == "fallback") & (state["retry_after"] > now))
    return F.coalesce((state["input_hash"] == fingerprint) & method, F.lit(False))


def chosen_metadata(stored: Column, reusable: Column, model: Column, rules: Column) -> Column:
    """struct<keywords, categories, method>: what is stored and holds, the model's answer, else the rules'."""
    made = lambda m, how: F.struct(m["keywords"].alias("keywords"), m["categories"].alias("categories"), F.lit(how).alias("method"))
    return F.when(reusable, made(stored, "reused")).when(model.isNotNull(), made(model, "llm")).otherwise(made(rules, "rules"))


def image_choice(naver: Column, meta: Column, primary: Column, others: Column) -> Column:
    """The page's own image first for portal articles; else primary, other images, the page's own."""
    usable = lambda c: F.when(is_article_image(c), c)
    other = F.try_element_at(F.filter(F.coalesce(others, F.array().cast("array<string>")), lambda u: u.rlike("^https?://") & ~u.rlike("(?i)qr[-_]?code")), F.lit(1))
    return F.when(naver, F.coalesce(usable(meta), usable(primary), other)).otherwise(F.coalesce(usable(primary), other, usable(meta)))


def thumbnail(url: Column, index: Column) -> Column:
    """struct<url, fallback_used, fallback>: the image, or the number of a canned one."""
    ok = is_article_image(url)
    return F.struct(F.when(ok, url).alias("url"), (~ok).alias("fallback_used"), F.when(~ok, F.pmod(index, F.lit(FALLBACK_IMAGES)).cast("int")).alias("fallback"))


def card(df: DataFrame) -> DataFrame:
    """What a card shows; the summary is the description where there is one."""
    return df.select("news_id", "title", F.coalesce(filled("description"), F.col("summary"), F.lit("")).alias("summary"), "source", F.nullif("published_at", F.lit("")).alias("published_at"), F.coalesce(filled("naver_url"), filled("url")).alias("source_url"))


def snapshot(df: DataFrame) -> DataFrame:
    """The private fields that a map keeps of an article, of those that df has."""
    return df.select(*[c for c in SNAPSHOT if c in df.columns])


def public(df: DataFrame) -> DataFrame:
    return df.drop(*PRIVATE)


def vector_matches(record: Column, metadata: Column, dims: int) -> Column:
    """Whether a stored vector was made of this input the same way, and is usable."""
    return F.coalesce((F.to_json(record["metadata"]) == F.to_json(metadata)) & V.is_valid(record["values"], dims), F.lit(False))


def vector_slot(purpose: Column, map_slot: Column, rag_slot: Column) -> Column:
    return F.when(purpose == "news_map", map_slot).when(purpose == "rag", rag_slot)


def with_cached_vectors(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (input_hash) with vector and reused; each missing input once in missing_inputs()."""
    return wanted.join(cache.select("input_hash", "vector"), "input_hash", "left").withColumn("reused", F.col("vector").isNotNull())


def missing_inputs(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.select("input_hash", "input").distinct().join(cache.select("input_hash"), "input_hash", "left_anti")


def summary_or_cut(summary: Column, title: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.substring(F.coalesce(F.nullif(F.trim(description), F.lit("")), title, F.lit("")), 1, 120))


def summary_key(title: Column, description: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))


def rag_rows(neighbours: DataFrame, requested: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The first k neighbours of each report that weren't asked for, each article once."""
    fresh = neighbours.join(requested.select(*by, "news_id"), [*by, "news_id"], "left_anti")
    best = fresh.groupBy(*by, "news_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "news_id"))).where(F.col("n") <= k)


def rag_block(rows: Column) -> Column:
    """Lines of title and text of an array of (title, description)."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["title"], F.lit(": "), F.coalesce(r["description"], F.lit("")))), "\n")


def extraction(payload: Column) -> Column:
    """First object of an extraction payload with text, images and error class."""
    p = F.from_json(payload, "errorCode int, objects array<struct<title:string,text:string,images:array<struct<url:string,primary:boolean>>>>")
    first = F.try_element_at(p["objects"], F.lit(1))
    error = F.when(p["errorCode"] == 429, "rate_limited").when(p["errorCode"].isin(401, 403), "unauthorized").when(p["errorCode"] >= 500, "server_error").when(p["errorCode"].isNotNull(), "api_error")
    return F.struct(T.paragraphs(first["text"]).alias("text"), first["images"].alias("images"), F.coalesce(error, F.when(first.isNull() | (F.trim(F.coalesce(first["text"], F.lit(""))) == ""), "empty")).alias("error"))


def with_body(df: DataFrame, text: str = "new_text") -> DataFrame:
    """Body fields replaced only where there is a text; a picture that looks like a code is cleared."""
    has = F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    return df.withColumns({"cleaned_content": F.when(has, F.col(text)).otherwise(F.col("cleaned_content")), "thumbnail_url": F.when(is_article_image(F.col("thumbnail_url")), F.col("thumbnail_url"))})


def shared_tokens(a: Column, b: Column, limit: int = 5) -> Column:
    """The first shared title tokens in order of text."""
    return F.slice(F.array_sort(F.array_intersect(T.title_tokens(a), T.title_tokens(b))), 1, limit)


def usage(provider: Column, payload: Column) -> Column:
    """struct<input_tokens, output_tokens> by the provider's own field names; what isn't a count is null."""
    get = lambda path: F.get_json_object(payload, path).try_cast("long")
    pair = lambda i, o: F.struct(F.when(get(i) >= 0, get(i)).alias("input_tokens"), F.when(get(o) >= 0, get(o)).alias("output_tokens"))
    return F.when(provider == "gemini", pair("$.prompt_token_count", "$.candidates_token_count")).otherwise(pair("$.input_tokens", "$.output_tokens"))


def embedding_tokens(response: Column, statistics: Column, counted: Column, limit: int = 2040) -> Column:
    """struct<tokens, basis, maybe_truncated>: the response's usage, else the statistics' sum, else a count."""
    total = F.aggregate(statistics, F.lit(0).cast("long"), lambda s, x: s + x)
    tokens = F.coalesce(response, total, counted)
    basis = F.when(response.isNotNull(), "response").when(total.isNotNull(), "statistics").when(counted.isNotNull(), "counted")
    return F.struct(tokens.alias("tokens"), basis.alias("basis"), F.coalesce(F.exists(statistics, lambda x: x > limit), tokens > limit, F.lit(False)).alias("maybe_truncated"))
