"""Relevance, gates and diverse top-k of candidates around centre articles.

Scores, gates and ranks are expressions and windows; only the greedy choice, where each pick
changes what may follow, runs per centre in a grouped function, on at most MAX_CANDIDATES rows
that a rank filter has let through before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import vectors as V
from . import judgment as J

#: Query vectors that are broadcast at once.
CENTRE_BLOCK = 1000


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def relevance(cosine: Column, centre_tokens: Column, tokens: Column, entities: Column, weight: float = L.KEYWORD_WEIGHT, penalty: float = L.ENTITY_ONLY_PENALTY) -> Column:
    """Cosine blended with the overlap of non-entity tokens, less a penalty where only entities are shared."""
    a, b = F.array_except(centre_tokens, entities), F.array_except(tokens, entities)
    only_entity = F.arrays_overlap(F.array_intersect(centre_tokens, tokens), entities) & (F.size(F.array_intersect(a, b)) == 0)
    score = (1 - weight) * F.greatest(F.lit(0.0), cosine) + weight * jaccard(a, b) - F.when(F.coalesce(only_entity, F.lit(False)), penalty).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def gate(score: Column, centre_tokens: Column, tokens: Column, entities: Column, threshold: float = L.MIN_RELEVANCE) -> Column:
    """Why a candidate is out: 'below_threshold', 'entity_only' or null."""
    shared = F.array_intersect(centre_tokens, tokens)
    only = (F.size(shared) > 0) & (F.size(F.array_except(shared, entities)) == 0)
    return F.when(score < threshold, "below_threshold").when(only, "entity_only")


def keyword_tokens(title: Column, description: Column, keywords: Column | None = None) -> Column:
    """Names found under any spelling, other latin and Hangul words, grounded metadata words; no stop words."""
    text = F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(description))
    rest, names = F.lower(text), []
    for name, aliases in L.ALIASES.items():
        names.append(F.when(T.grounded(F.lower(text), name), name.lower()))
        for alias in sorted(aliases, key=len, reverse=True):
            rest = F.regexp_replace(rest, f"(?<![a-z0-9]){alias.lower()}(?![a-z0-9])", " ")
    found = F.concat(F.array_compact(F.array(*names)), F.regexp_extract_all(rest, F.lit("[a-z][a-z0-9]*|[가-힣]{2,}"), F.lit(0)))
    if keywords is not None:
        held = F.filter(keywords, lambda k: F.lower(text).contains(F.lower(k)))
        found = F.concat(found, F.flatten(F.transform(held, lambda k: F.regexp_extract_all(F.lower(k), F.lit("[a-z][a-z0-9]*|[가-힣]{2,}"), F.lit(0)))))
    return F.array_except(F.array_distinct(found), T.words((*L.KEYWORD_STOPWORDS, *L.EXTRA_KEYWORD_STOPWORDS)))


def pool_order(searched: str = "searched_at", rank: str = "search_rank", published: str = "published_at", row_id: str = "news_id") -> list[Column]:
    """Newest search first, then its rank (none last), newest publication text, id."""
    place = F.when(F.coalesce(F.col(rank), F.lit(0)) == 0, 10**9).otherwise(F.col(rank))
    return [F.coalesce(F.col(searched), F.lit("")).desc(), place, F.coalesce(F.col(published), F.lit("")).desc(), F.coalesce(F.col(row_id), F.lit(""))]


def initial_cut(df: DataFrame, by: list[str], order: list[Column], fresh: str, count: int = L.INITIAL_CANDIDATES) -> DataFrame:
    """df with stage 0 for the rows up to the first count fresh ones in order, else 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = F.sum(F.col(fresh).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("stage", F.when((seen > count) | ((seen == count) & ~F.col(fresh)), 1).otherwise(0))


def latest_session_end(df: DataFrame, by: list[str], searched: str = "searched_at", end: str = "search_end", rank: str = "search_rank") -> DataFrame:
    """Per group the last raw position that its newest search asked for."""
    newest = F.max(F.coalesce(F.col(searched), F.lit(""))).over(Window.partitionBy(*by))
    rows = df.withColumn("__newest", newest).where(F.coalesce(F.col(searched), F.lit("")) == F.col("__newest"))
    return rows.groupBy(*by).agg(F.max(F.coalesce(F.when(F.col(end) != 0, F.col(end)), F.col(rank))).alias("raw_end"), F.first("__newest").alias("session"))


def top_by_relevance(df: DataFrame, by: list[str], limit: int, score: str = "score", description: str = "description", keys: tuple[str, ...] = ("news_id",)) -> DataFrame:
    """The limit best rows of each group: score, then longer description, then article key."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.length(T.text_or_empty(F.col(description))).desc(), *keys)
    return df.withColumn("relevance_rank", F.row_number().over(w)).where(F.col("relevance_rank") <= limit)


def vector_top_k(every: DataFrame, centres: DataFrame, k: int, vector: str = "embedding", row_id: str = "vec_id", dims: int = 64) -> DataFrame:
    """centre, row_id, cosine, rank: the k nearest of each centre, itself excluded; ties by row_id.

    centres is a stated query set: it goes through the driver in blocks of CENTRE_BLOCK, each block is
    multiplied with all rows batch by batch, and a task hands on its k best of each centre only.
    """
    centres = centres.where(V.is_valid(F.col(vector), dims)).select(F.col(row_id).alias("centre"), V.normalised(F.col(vector), dims).alias("v"))
    valid = every.where(V.is_valid(F.col(vector), dims)).select(row_id, V.normalised(F.col(vector), dims).alias("v"))
    kind = every.schema[row_id].dataType.simpleString()
    schema = f"centre {kind}, `{row_id}` {kind}, cosine double"
    parts = [valid.mapInPandas(nearest(*some, row_id, k), schema) for some in centre_blocks(centres, CENTRE_BLOCK)]
    scored = reduce(DataFrame.unionByName, parts) if parts else valid.select(F.col(row_id).alias("centre"), row_id, F.lit(0.0).alias("cosine")).where(F.lit(False))
    w = Window.partitionBy("centre").orderBy(F.round("cosine", 12).desc(), row_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centre_blocks(centres: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of at most ``most`` centres at a time."""
    ids, rows = [], []
    for r in centres.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def nearest(ids: np.ndarray, centres: np.ndarray, row_id: str, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: the k rows of a task that are nearest to each centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"at": np.empty(0, np.int64), row_id: ids[:0], "cosine": np.empty(0)})
        for batch in batches:
            if not len(batch):
                continue
            own = batch[row_id].to_numpy()
            score = np.clip(centres @ np.array(batch["v"].tolist(), np.float64).T, -1.0, 1.0)
            score[ids[:, None] == own[None, :]] = -2.0
            bar = np.partition(score, -k, axis=1)[:, -k, None] - 1e-12 if score.shape[1] > k else -1.5
            at, col = np.nonzero((score >= bar) & (score > -1.5))
            best = pd.concat([best, pd.DataFrame({"at": at, row_id: own[col], "cosine": score[at, col]})], ignore_index=True)
            best = best.iloc[np.lexsort((best[row_id], -best["cosine"].round(12), best["at"]))].groupby("at", sort=False).head(k)
        yield pd.DataFrame({"centre": ids[best["at"].to_numpy(np.int64)], row_id: best[row_id].to_numpy(), "cosine": best["cosine"].to_numpy()})

    return run


def route(occurrence: Column, contribution: Column, helpfulness: Column) -> Column:
    """struct<bucket, reason, role> from a candidate's answer probabilities (maps)."""
    useful = reduce(lambda a, b: a + b, [contribution[k] for k in L.USEFUL_ROLES])
    off, helps = contribution["tangential"] + contribution["unrelated"], helpfulness["2"] + helpfulness["3"]
    best = F.greatest(*[contribution[k] for k in L.USEFUL_ROLES])
    role = reduce(lambda out, k: F.when(contribution[k] == best, k).otherwise(out), reversed(L.USEFUL_ROLES), F.lit(None).cast("string"))
    p = L.POLICY
    table = [
        ((contribution["repeat"] >= p["repeat_min"]) & (occurrence["same"] >= p["same_occurrence_min"]), "center_group", "repeat", None),
        ((occurrence["same"] >= p["same_occurrence_strict"]) & (useful < p["useful_min"]) & (off < p["offtopic_min"]), "center_group", "same_occurrence_no_new_angle", None),
        ((useful >= p["useful_min"]) & (helps >= p["help_min"]), "candidate", "useful", role),
        (off >= p["offtopic_min"], "excluded", "off_topic", None),
    ]
    row = lambda b, r, x: F.struct(F.lit(b).alias("bucket"), F.lit(r).alias("reason"), (F.lit(None).cast("string") if x is None else x).alias("role"))
    out = row("withheld", "uncertain", None)
    for test, bucket, reason, which in reversed(table):
        out = F.when(test, row(bucket, reason, which)).otherwise(out)
    return out


def expected(probabilities: Column) -> Column:
    """Mean level of a distribution over numbered levels."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + e["key"].cast("int") * e["value"])


def is_distribution(probabilities: Column, keys: tuple[str, ...], slack: float = 0.04) -> Column:
    """Exactly these keys, each probability within 0 and 1, all summing to 1 within slack."""
    values = F.map_values(probabilities)
    whole = F.abs(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) - 1) <= slack
    same = F.array_sort(F.map_keys(probabilities)) == F.array(*[F.lit(k) for k in sorted(keys)])
    return F.coalesce(same & F.forall(values, lambda v: v.between(0, 1)) & whole, F.lit(False))


def redundant(probabilities: Column) -> Column:
    return probabilities["redundant"] >= L.POLICY["redundant_min"]


def unit_rows(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


PICK = "picked int, pick_order int, pick_reason string"


def mmr_picks(scores: list[float], cosines: np.ndarray, keys: list, limit: int, weight: float, blocked=lambda chosen, i: None, chosen: list[int] | None = None) -> tuple[list[int], dict[int, str]]:
    """Greedy picks: first by score, then by weight * score - (1 - weight) * nearest pick.

    blocked(chosen, i) may give a reason to drop i for good once something was picked. chosen holds
    earlier rounds' picks, which stay.
    """
    chosen, left, dropped = list(chosen or []), [i for i in range(len(scores)) if i not in (chosen or [])], {}
    while True:
        for i in left:
            reason = blocked(chosen, i)
            if reason:
                dropped[i] = reason
        left = [i for i in left if i not in dropped]
        if not left or len(chosen) >= limit:
            return chosen, dropped
        value = lambda i: round(weight * scores[i] - (1 - weight) * max(cosines[i, j] for j in chosen), 12) if chosen else round(scores[i], 12)
        best = min(left, key=lambda i: (-value(i), keys[i]))
        chosen.append(best)
        left.remove(best)


def mmr(df: DataFrame, by: list[str], limit: int, score: str = "score", vector: str = "embedding", key: str = "vec_id", weight: float = L.MMR_LAMBDA, most: int = L.MAX_CANDIDATES) -> DataFrame:
    """pick_order of the limit picks of each group, from its most best rows by score."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    few = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select(*by, key, score, vector)
    kinds = ", ".join(f"{c} {few.schema[c].dataType.simpleString()}" for c in (*by, key))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        unit = unit_rows(g[vector].tolist())
        chosen, _ = mmr_picks(g[score].tolist(), unit @ unit.T, g[key].tolist(), limit, weight)
        out = g.iloc[chosen][[*by, key]].copy()
        out["pick_order"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return few.groupBy(*by).applyInPandas(pick, f"{kinds}, pick_order int")


def role_picks(df: DataFrame, by: list[str], limit: int, key: str = "news_id", score: str = "score", role: str = "role", rank: str = "search_rank", most: int = L.MAX_CANDIDATES) -> DataFrame:
    """Picks by helpfulness (score * 3) less a penalty for each earlier pick of the same role."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    few = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select(*by, key, score, role, rank)
    kinds = ", ".join(f"{c} {few.schema[c].dataType.simpleString()}" for c in (*by, key))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        rows = list(g[[key, score, role, rank]].itertuples(index=False))
        chosen: list = []
        while rows and len(chosen) < limit:
            order = lambda r: (-round(r[1] * 3 - L.POLICY["role_penalty"] * sum(c[2] == r[2] for c in chosen), 12), r[3] if r[3] and r[3] > 0 else 10**9, r[0])
            best = min(rows, key=order)
            rows.remove(best)
            chosen.append(best)
        out = pd.DataFrame({b: [g[b].iloc[0]] * len(chosen) for b in by} | {key: [c[0] for c in chosen]})
        out["pick_order"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return few.groupBy(*by).applyInPandas(pick, f"{kinds}, pick_order int")


def staged_map(df: DataFrame, target: int, stages: str = "stage", most: int = L.MAX_CANDIDATES) -> DataFrame:
    """The whole selection of each centre: gate, judgment against the centre, diverse picks, in stages.

    df: centre_id, query, centre_title, centre_description, centre_published_at, news_id, title,
    description, published_at, score, cosine, embedding, gate (reason or null), stage (0 first); a
    centre's candidates are at most ``most`` (with a pool_rank, those up to it). A later stage is looked
    at only while picks are missing, and never replaces earlier picks. All judgments are joins of the articles' evidence;
    only the greedy choice among a centre's judged candidates is a grouped function.
    Gives centre_id, news_id, outcome (picked or why not), pick_order.
    """
    few = df.where(F.col("pool_rank") <= most) if "pool_rank" in df.columns else df
    texts = ("title", "description", "published_at")
    name = lambda *some: F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in some])
    few = few.withColumns({"__own": name(*texts), "__centre": name(*(f"centre_{c}" for c in texts))})
    articles = few.select(F.col("__own").alias("news"), *texts).unionByName(few.select(F.col("__centre").alias("news"), *[F.col(f"centre_{c}").alias(c) for c in texts])).dropDuplicates(["news"])
    told = J.evidence(articles, "news")
    judged = J.judge(few, told, "__centre", "__own", "cosine", "query")
    state = F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("relation") == "repeat", "center_repeat").when(F.col("withheld"), "withheld").when(~F.col("features.is_connected"), "unconnected")
    judged = judged.withColumn("__state", state)
    ready = judged.where(F.col("__state").isNull()).select("centre_id", "news_id", "__own", "embedding")
    other = ready.select(F.col("centre_id").alias("__c"), F.col("news_id").alias("by"), F.col("__own").alias("__by"), F.col("embedding").alias("__v"))
    pairs = ready.join(other, (F.col("centre_id") == F.col("__c")) & (F.col("news_id") != F.col("by"))).withColumn("__near", V.cosine(F.col("__v"), F.col("embedding"))).select("centre_id", "news_id", "by", "__by", "__own", "__near")
    against = J.judge(pairs, told, "__by", "__own", "__near").where((F.col("relation") == "repeat") | F.col("withheld"))
    against = against.groupBy("centre_id", "news_id").agg(F.map_from_entries(F.collect_list(F.struct("by", F.when(F.col("withheld"), "withheld").otherwise("neighbour_repeat")))).alias("barred"))
    rows = judged.select("centre_id", "news_id", F.col(stages).alias("stage"), "score", F.length(F.coalesce("description", F.lit(""))).alias("size"), "embedding", "__state")
    rows = rows.join(against.withColumnsRenamed({"centre_id": "__c", "news_id": "__n"}), (F.col("centre_id") == F.col("__c")) & (F.col("news_id") == F.col("__n")), "left").drop("__c", "__n")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["stage", "news_id"], ignore_index=True)
        unit = unit_rows(g["embedding"].tolist())
        cosines, ids, outcome = unit @ unit.T, g["news_id"].tolist(), g["__state"].tolist()
        barred = [dict(x) if isinstance(x, (dict, list)) else {} for x in g["barred"]]
        keys = list(zip(-g["score"], -g["size"], ids, strict=True))
        chosen: list[int] = []
        seen: list[int] = []
        reached = -1
        for stage in sorted(set(g["stage"])):
            reached = stage
            seen += [i for i in np.flatnonzero(g["stage"] == stage).tolist() if outcome[i] is None]
            left = [i for i in seen if outcome[i] is None]
            picks, dropped = mmr_picks([g["score"][i] for i in left], cosines[np.ix_(left, left)], [keys[i] for i in left], target, L.MMR_LAMBDA, lambda p, i, at=left: next((barred[at[i]][ids[at[j]]] for j in p if ids[at[j]] in barred[at[i]]), None), [left.index(i) for i in chosen])
            chosen = [left[k] for k in picks]
            for k, reason in dropped.items():
                outcome[left[k]] = reason
            if len(chosen) >= target:
                break
        place = {i: k + 1 for k, i in enumerate(chosen)}
        names = ["not_reached" if s > reached else "picked" if i in place else o or "remaining" for i, (o, s) in enumerate(zip(outcome, g["stage"], strict=True))]
        return pd.DataFrame({"centre_id": g["centre_id"], "news_id": ids, "outcome": names, "pick_order": pd.array([place.get(i) for i in range(len(g))], dtype="Int32")})

    kind = lambda c: df.schema[c].dataType.simpleString()
    return rows.groupBy("centre_id").applyInPandas(run, f"centre_id {kind('centre_id')}, news_id {kind('news_id')}, outcome string, pick_order int")


def selection_status(picked: Column, target: Column, reached_all: Column) -> Column:
    return F.when(picked >= target, "complete").when(reached_all, "insufficient").otherwise("expandable")


def display_target(limit: Column, tier: Column) -> Column:
    """The limit for PAID, at most 3 else."""
    return F.when(tier == "PAID", limit).otherwise(F.least(limit, F.lit(3)))


def tier_allows(tier: Column, needed: str) -> Column:
    rank = F.create_map(*[F.lit(x) for pair in (("FREE", 0), ("BASIC", 1), ("PAID", 2)) for x in pair])
    return F.coalesce(rank[tier], F.lit(0)) >= rank[F.lit(needed)]


def distinct_issues(judged: DataFrame, batch: str = "batch") -> DataFrame:
    """Candidates that are a different event for every centre of theirs, of the first batch that has any."""
    every = judged.groupBy("news_id", batch).agg(F.bool_and(F.col("relation") == "different_event").alias("distinct")).where("distinct")
    first = every.agg(F.min(batch).alias("__first"))
    return every.join(F.broadcast(first), F.col(batch) == F.col("__first")).select("news_id", batch)
