"""Ordered first-wins dedupes: rows that are dropped contribute no key.

What a row meets depends on which rows before it stayed: the rows that stay are the first maximal independent set, in
order, of rows that conflict. It is found in rounds over a table of keys or token postings, however large a group is. In each
round those rows stay that conflict with no earlier row still open, and what conflicts with them goes; rows without an open
conflict before them are found by aggregates of keys and semi joins of postings, never by pairs that are written. When
SMALL rows or fewer are open (in all groups together), one pass reads them in order, group by group, as it does for small
tables from the beginning; with MAX_ROUNDS rounds done (long chains of conflicts, one after the other by
meaning) it reads what is still open, sorted by Spark and batch by batch. Dedupes with a single key are windows or aggregates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored

#: Open rows that one pass reads in order, and rounds after which it reads however many there are.
SMALL, MAX_ROUNDS = 20_000, 40
#: Most frequent tokens that are told apart from the others; they come last in a title's order. It changes the work only.
COMMON = 128
PLACE = "__at"


def group_of(by: list[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def identity_keys(article_id: Column, *urls: Column) -> Column:
    """'id:' and 'url:' keys of a row, blank urls left out."""
    keys = [F.concat(F.lit("id:"), article_id)]
    keys += [F.when(T.text_or_empty(u) != "", F.concat(F.lit("url:"), u)) for u in urls]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def kept_in_order(df: DataFrame, by: list[str], order: list[Column], reads: list[Column], judge: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows of df that a group's judge accepts, asked in order; judge() begins a group, its result takes
    the values of reads (one row's) and remembers what it accepts."""
    n, k = len(df.columns), len(by)
    names = [*(f"__by{i}" for i in range(k)), *(f"__read{i}" for i in range(len(reads)))]
    work = df.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(x) for c, x in zip([*map(F.col, by), *reads], names, strict=True)])
    sort = [*names[:k], *order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, accepts = None, None
        for batch in batches:
            told = [c.to_pylist() for c in batch.columns[n:]]
            keep = []
            for values in zip(*told, strict=True):
                if accepts is None or values[:k] != group:
                    group, accepts = values[:k], judge()
                keep.append(bool(accepts(*values[k:])))
            yield batch.select(list(range(n))).filter(pa.array(keep, pa.bool_()))

    return work.repartition(*names[:k]).sortWithinPartitions(*sort).mapInArrow(rows, df.schema)


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df, written, with its rows' places in order; a group's rows lie side by side."""
    keys = [F.col(b) for b in by]
    return stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(PLACE, F.monotonically_increasing_id()), "numbered")


def in_rounds(numbered: DataFrame, rows: DataFrame, small: int, settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The numbered rows that stay, by their open counterparts (column at). settle: of the open rows, (places of those that stay
    now, open rows left); finish: places of those that stay of the last open rows. The result's ``rounds`` is how often rows were settled."""
    stays, done = [], 0
    while rows.count() > small and done < MAX_ROUNDS:
        now, rows = settle(rows)
        stays.append(now)
        done += 1
    stays.append(stored(finish(rows), "stays"))
    every = reduce(DataFrame.unionByName, stays).withColumnRenamed("at", PLACE)
    out = numbered.join(every, PLACE, "left_semi").drop(PLACE)
    out.rounds = done
    return out


def without(rows: DataFrame, *gone: DataFrame) -> DataFrame:
    return reduce(lambda d, g: d.join(g, "at", "left_anti"), gone, rows)


def heads(rows: DataFrame, keys: str = "keys") -> DataFrame:
    """Places of the rows that come first on all of their keys (an array, distinct); each key is an aggregate, not a group."""
    first = rows.select("at", F.explode(keys).alias("k")).groupBy("k").agg(F.min("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("__first"))
    return rows.join(first, "at", "left").where(F.size(keys) == F.coalesce("__first", F.lit(0))).select("at")


def sharing(rows: DataFrame, stays: DataFrame, keys: str = "keys") -> DataFrame:
    """Places of rows that have a key of a row that stays."""
    taken = stays.select(F.explode(keys).alias("k"))  # each key once: rows that stay share none
    return rows.select("at", F.explode(keys).alias("k")).join(taken, "k", "left_semi").select("at").distinct()


def identity_dedupe(df: DataFrame, by: list[str], order: list[Column], keys: str = "keys", seed: str | None = None, usable: str | None = None, small: int = SMALL) -> DataFrame:
    """First row of each identity within by: a row goes if one of its keys was seen on a kept row.

    seed: array column of keys that count as seen (the same in a whole group); usable: boolean
    column, rows without it are passed over. An empty group stays empty; of rows equal in order any may be first.
    """
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.array_compact(F.coalesce(F.col(keys), none)))
    if usable:
        df = df.where(F.coalesce(F.col(usable), F.lit(False)))
    if seed:
        df = df.where(~F.arrays_overlap(own, F.array_compact(F.coalesce(F.col(seed), none))))

    def judge() -> Callable[..., bool]:
        seen: set[str] = set()

        def accepts(own: list[str]) -> bool:
            if not seen.isdisjoint(own):
                return False
            seen.update(own)
            return True

        return accepts

    if df.count() <= small:
        return kept_in_order(df, by, order, [own], judge)

    def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = stored(heads(rows), "stays")
        gone = sharing(rows, rows.join(now, "at", "left_semi"))
        return now, stored(without(rows, now, gone), "open")

    rows = numbered(df, by, order)
    group = group_of(by)
    told = rows.select(F.col(PLACE).alias("at"), group.alias("g"), F.transform(own, lambda k: F.concat(k, F.lit("\u0000"), group)).alias("keys"))
    return in_rounds(rows, told, small, settle, lambda rest: kept_in_order(rest, ["g"], [F.col("at")], [F.col("keys")], judge).select("at"))


def postings(rows: DataFrame) -> DataFrame:
    """at, g, n, tokens, token, early: a row for each token; early ones are so many that two titles whose overlap reaches
    the threshold share one that is early in the shorter."""
    return rows.select("at", "g", F.size("tokens").alias("n"), "tokens", "early_count", F.posexplode("tokens").alias("__pos", "token")).withColumn("early", F.col("__pos") < F.col("early_count")).drop("__pos", "early_count")


def overlapping(rows: DataFrame, others: DataFrame, threshold: float, earlier: bool) -> DataFrame:
    """Places of rows whose tokens overlap with one of the others' (with an earlier one's) by the threshold or more.

    Semi joins by group and token stop at the first such row; a token that isn't early in many titles meets only those few where it is.
    """
    a = postings(rows)
    b = postings(others)
    b = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    enough = F.size(F.array_intersect("tokens", "tokens_")) / F.least("n", "n_") >= threshold
    before = (F.col("at_") < F.col("at")) if earlier else F.lit(True)
    met = (F.col("g") == F.col("g_")) & (F.col("token") == F.col("token_")) & before & enough
    shorter = a.where("early").join(b, met & (F.col("n") <= F.col("n_")), "left_semi")
    longer = a.join(b.where("early_"), met & (F.col("n") > F.col("n_")), "left_semi")
    return shorter.select("at").unionByName(longer.select("at")).distinct()


def title_overlap_dedupe(df: DataFrame, by: list[str], order: list[Column], url: str = "url", title: str = "title", threshold: float = 0.4, small: int = SMALL) -> DataFrame:
    """First row of each url whose title tokens overlap with no kept title's by the threshold or more."""
    address = F.trim(T.text_or_empty(F.col(url)))
    df = df.where(address != "")

    def judge() -> Callable[..., bool]:
        urls: set[str] = set()
        sizes: list[int] = []
        listed: dict[str, list[int]] = defaultdict(list)

        def accepts(own: list[str], tokens: list[str]) -> bool:
            common = Counter(i for t in tokens for i in listed.get(t, ()))
            if own[0] in urls or any(c / min(len(tokens), sizes[i]) >= threshold for i, c in common.items()):
                return False
            urls.add(own[0])
            for t in tokens:
                listed[t].append(len(sizes))
            sizes.append(len(tokens))
            return True

        return accepts

    tokens = T.title_tokens(F.col(title))
    if df.count() <= small:
        return kept_in_order(df, by, order, [F.array(address), tokens], judge)

    def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        now = stored(without(heads(rows), overlapping(rows, rows, threshold, True)), "stays")
        kept = rows.join(now, "at", "left_semi")
        left = stored(without(rows, now, sharing(rows, kept)), "open")
        return now, stored(without(left, overlapping(left, kept, threshold, False)), "open")

    rows = numbered(df, by, order)
    told = rows.select(F.col(PLACE).alias("at"), group_of(by).alias("g"), F.array(F.concat(address, F.lit("\u0000"), group_of(by))).alias("keys"), tokens.alias("tokens"))
    common = [r.token for r in told.select(F.explode("tokens").alias("token")).groupBy("token").count().orderBy(F.col("count").desc(), "token").limit(COMMON).collect()]
    if common:
        ranks = F.map_from_arrays(F.lit(common), F.lit([len(common) - i for i in range(len(common))]))
        told = told.withColumn("tokens", F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(F.coalesce(ranks[t], F.lit(0)).alias("r"), t.alias("t")))), lambda s: s["t"]))
    n = F.size("tokens")
    told = stored(told.withColumn("early_count", n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1), "titles")
    return in_rounds(rows, told, small, settle, lambda rest: kept_in_order(rest, ["g"], [F.col("at")], [F.col("keys"), F.col("tokens")], judge).select("at"))


def url_or_title_dedupe(df: DataFrame, by: list[str], order: list[Column], url_key: str = "url_key", title_key: str = "title_key", least: int = 12, small: int = SMALL) -> DataFrame:
    """First row by url key, and by title key where that is long enough to tell articles apart."""
    u = F.when(F.col(url_key) != "", F.concat(F.lit("u:"), F.col(url_key)))
    t = F.when(F.length(title_key) >= least, F.concat(F.lit("t:"), F.col(title_key)))
    free = "__keys"
    return identity_dedupe(df.withColumn(free, F.array_compact(F.array(u, t))), by, order, free, small=small).drop(free)


def first_by_key(df: DataFrame, key: Column, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """First row of each key; row_number with a rank filter, so only that row leaves a sort."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def corpus_rows(df: DataFrame, by: list[str], position: str, url: str = "url", other_url: str = "naver_url", title: str = "title") -> DataFrame:
    """First row of each url (or of position and title without one); blank titles go after that."""
    address = F.coalesce(F.nullif(F.trim(F.col(url)), F.lit("")), F.nullif(F.trim(F.col(other_url)), F.lit("")))
    key = F.coalesce(address, F.concat_ws("-", F.lit("idx"), F.col(position), T.text_or_empty(F.col(title))))
    first = first_by_key(df, key, [F.col(position)], tuple(by))
    stripped = F.trim(F.regexp_replace(T.text_or_empty(F.col(title)), r"^(?:(?U)\s*(?:\[[^\]]{1,16}\]|【[^】]{1,16}】|＜[^＞]{1,16}＞|〈[^〉]{1,16}〉))+(?U)\s*", ""))
    shown = F.coalesce(F.nullif(stripped, F.lit("")), F.trim(F.col(title)))
    return first.withColumn("clean_title", shown).where(T.text_or_empty(shown) != "")


def distinct_inputs(df: DataFrame, inputs: list[str], process) -> DataFrame:
    """process() run once per distinct input, its result joined back to every row."""
    once = process(df.select(*inputs).distinct())
    return df.join(once, inputs, "left")


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def without_excluded(candidates: DataFrame, excluded: DataFrame, keys: str = "keys") -> DataFrame:
    """Candidates that share no identity key with an excluded row."""
    gone = excluded.select(F.explode(keys).alias("k")).distinct()
    hit = candidates.select("row_id", F.explode(keys).alias("k")).join(gone, "k", "left_semi").select("row_id").distinct()
    return candidates.join(hit, "row_id", "left_anti")
