"""Article sources: raw payloads of several providers to one article shape, and the test tables' view.

Every normaliser gives: news_id, title, description, url, naver_url, source, published_at (ISO text,
UTC), image. Missing fields are empty texts, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SHAPE = ("news_id", "title", "description", "url", "naver_url", "source", "published_at", "image")

NEWSAPI = (
    "array<struct<source:struct<id:string,name:string>,author:string,title:string,description:string,url:string,urlToImage:string,publishedAt:string,content:string>>"
)


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    made = {c: columns.get(c, F.lit("")) for c in SHAPE[1:]}
    url = F.coalesce(F.nullif(made["url"], F.lit("")), made["title"])
    return df.select(T.news_id(url).alias("news_id"), *[F.coalesce(v, F.lit("")).alias(k) for k, v in made.items()])


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the articles array of a multi-line JSON payload."""
    payload = spark.read.schema(f"status string, totalResults int, articles {NEWSAPI}").option("multiLine", True).json(path)
    return from_newsapi(payload.select(F.inline("articles")))


def from_newsapi(rows: DataFrame) -> DataFrame:
    return shaped(rows, title=F.col("title"), description=F.col("description"), url=F.col("url"), source=F.col("source.name"), published_at=F.col("publishedAt"), image=F.col("urlToImage"))


def relevant_or_all(rows: DataFrame, terms: tuple[str, ...], least: int = 2) -> DataFrame:
    """Rows that hold a term, if there are least or more of them, else all rows."""
    marked = rows.withColumn("__hit", T.relevant_terms(terms, F.col("title"), F.col("description")))
    enough = marked.agg((F.count_if("__hit") >= least).alias("__enough"))
    return marked.join(F.broadcast(enough)).where(F.col("__hit") | ~F.col("__enough")).drop("__hit", "__enough")


def from_gdelt(rows: DataFrame) -> DataFrame:
    """seendate of 16 characters; the body replaces the description, else the title does."""
    when = F.date_format(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmssX")), ISO)
    text = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("title"))
    return shaped(rows.where(T.text_or_empty(F.col("url")) != ""), title=F.col("title"), description=text, url=F.col("url"), source=F.col("domain"), published_at=when, image=F.col("socialimage"))


def gdelt_query(query: Column, language: str = "Korean") -> Column:
    """The query with a source language, once."""
    return F.when(~F.lower(query).contains("sourcelang:"), F.concat_ws(" ", F.trim(query), F.lit(f"sourcelang:{language}"))).otherwise(F.trim(query))


def web_url(c: Column) -> Column:
    """The url if it is http or https with a host, else an empty text."""
    proto, host = F.try_parse_url(c, F.lit("PROTOCOL")), F.try_parse_url(c, F.lit("HOST"))
    return F.when(F.lower(proto).isin("http", "https") & (host != ""), c).otherwise("")


def is_naver(c: Column) -> Column:
    host, user = F.lower(F.try_parse_url(c, F.lit("HOST"))), F.try_parse_url(c, F.lit("USERINFO"))
    return F.coalesce(((host == "news.naver.com") | host.endswith(".news.naver.com")) & user.isNull(), F.lit(False))


#: RFC 822 month names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def rfc822(c: Column) -> Column:
    """UTC timestamp of an RFC 822 date, null if it is none."""
    m = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+([+-]\d{2})(\d{2})$"
    part = lambda i: F.regexp_extract(T.text_or_empty(c), m, i)
    month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.initcap(part(2)))
    iso = F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), part(5), F.lit(":"), part(6))
    return F.when(c.rlike(m) & (month > 0), iso.try_cast("timestamp"))


def from_naver(rows: DataFrame) -> DataFrame:
    """title, originallink, link, description, pubDate of a search page; links elsewhere and blank titles go."""
    kept = rows.where(is_naver(F.col("link")))
    out = shaped(
        kept, title=U.plain_text("title"), description=U.plain_text("description"), naver_url=F.col("link"),
        url=F.coalesce(F.nullif(web_url(F.col("originallink")), F.lit("")), F.col("link")), published_at=F.date_format(rfc822(F.col("pubDate")), ISO),
    )
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return out.withColumn("source", host).where("title <> ''")


def search_page(ranked: DataFrame, start: int, size: int, by: list[str], url: str = "url", position: str = "position") -> DataFrame:
    """Rows start..start+size-1 of each search with search_rank and search_end; urls repeat once, ranks keep gaps."""
    if not (1 <= size <= 100 and 1 <= start <= 1000):
        raise ValueError("size must be 1 to 100 and start 1 to 1000")
    w = Window.partitionBy(*by).orderBy(position)
    page = ranked.withColumn("search_rank", F.row_number().over(w)).where(F.col("search_rank").between(start, start + size - 1))
    page = page.withColumn("search_end", F.max("search_rank").over(Window.partitionBy(*by)))
    first = F.row_number().over(Window.partitionBy(*by, url).orderBy("search_rank"))
    return page.withColumn("__n", first).where("__n = 1").drop("__n")


def first_available(sources: list[DataFrame]) -> DataFrame:
    """The first source that has a row; sources are tried in order, never mixed."""
    return next((s for s in sources if not s.isEmpty()), sources[-1])


def from_provider(provider: str, sources: dict[str, DataFrame], mock: bool = False) -> DataFrame:
    """Articles (of one shape) of the provider that is set: its own alone, but gdelt falls back to newsapi
    and then to the fixtures where it gives no titled article; fixtures alone where mock is set."""
    if mock:
        return sources["mock"]
    if provider != "gdelt":
        return sources[provider]
    order = [sources["gdelt"].where("title <> ''"), *[sources[s] for s in ("newsapi", "mock") if s in sources]]
    return first_available(order)


def translated(query: Column, dictionary: dict[str, str]) -> Column:
    """Whole phrase, else word by word, else as it is."""
    pairs = F.create_map(*[F.lit(x) for k, v in dictionary.items() for x in (k, v)])
    by_word = F.array_join(F.transform(F.split(query, " "), lambda w: F.coalesce(pairs[w], w)), " ")
    return F.coalesce(pairs[query], by_word)


def allowed_categories(labels: Column, excluded: tuple[str, ...] = ("정치", "사회")) -> Column:
    """Known labels, none of them excluded; unknown labels don't pass."""
    return F.coalesce((F.size(labels) > 0) & ~F.arrays_overlap(labels, F.array(*[F.lit(x) for x in excluded])), F.lit(False))


def status_class(status: Column) -> Column:
    return F.when(status == 429, "rate_limited").when(status.isin(401, 403), "unauthorized").when(status >= 500, "server_error").otherwise("api_error")


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))


def retry_after_seconds(c: Column) -> Column:
    """Seconds of a plain number or of [d days,] hh:mm:ss; null else."""
    clock = r"^(?:(\d+)\s*days?,\s*)?(\d{1,2}):(\d{2}):(\d{2})$"
    part = lambda i: F.coalesce(F.regexp_extract(c, clock, i).try_cast("long"), F.lit(0))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long")).when(c.rlike(clock), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))


def article_view(documents: DataFrame) -> DataFrame:
    """Articles made of the test documents: the first line is the title, the rest the description."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    published = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("doc_id") * 600), ISO)
    return documents.select(
        F.col("doc_id"), T.news_id(F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id")).alias("news_id"), F.element_at(lines, 1).alias("title"),
        F.array_join(F.slice(lines, 2, F.size(lines)), " ").alias("description"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("url"), "source", F.col("lang").alias("search_keyword"), published.alias("published_at"),
    )
