"""Keyword frequencies, and the keyword map of a search: clusters, labels, entities.

Token counts and tf-idf are aggregates. Clustering of one query's articles (at most MAX_ARTICLES,
kept by rank before grouping) and the greedy choices of labels and entities depend on their own
earlier results and run in one grouped function per query. Noun phrases come from the particles
that the content tokenizer strips; a table of analysed words can be joined in their place.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import words as P
from .gazetteer import Spellings, built, flat, longest_first
from .lattice import Model

#: Fixed values. Thresholds of clustering, labels and entities.
MAX_ARTICLES = 50
THRESHOLD, THRESHOLD_MAX, GAIN, BACKGROUND = 0.42, 0.51, 0.25, 0.30
SEMANTIC, LEXICAL, POLAR_DICE = 0.65, 0.35, 0.45
MAX_ISSUES, MAX_ENTITIES, MAX_CLUSTERS, MAX_LABELS = 4, 4, 10, 6


TOKEN = re.compile("[a-z가-힣]+")


def frequent_tokens(docs: DataFrame, by: list[str], text: str, limit: int = 7, least: int = 3) -> DataFrame:
    """token, n, first_pos, rank: most frequent tokens of each group, ties by first occurrence.

    Words are counted batch by batch, so what is shuffled are a batch's distinct words with their counts and first places.
    """
    k = len(by)
    names = [*(f"__by{i}" for i in range(k)), "token", "n", "position", "at"]
    stop = frozenset((*L.TITLE_STOPWORDS, *L.CONTENT_STOPWORDS, *L.KEYWORD_STOPWORDS))
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=False)], F.col("position"), F.lower(T.text_or_empty(F.col(text))).alias("text"))
    kinds = [f.dataType.simpleString() for f in read.schema.fields]
    first = lambda position, at: (False, 0, at) if position is None else (True, position, at)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, list] = {}
            for *group, position, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, word in enumerate(TOKEN.findall(words)):
                    if len(word) < least or word in stop:
                        continue
                    held = counts.get((*group, word))
                    if held is None:
                        counts[*group, word] = [1, position, at]
                    else:
                        held[0] += 1
                        if first(position, at) < first(*held[1:]):
                            held[1:] = position, at
            columns = [pa.array([key[i] for key in counts], batch.schema.field(i).type) for i in range(k)]
            columns += [pa.array([key[k] for key in counts], pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], batch.schema.field(k).type), pa.array([v[2] for v in counts.values()], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {kind}" for n, kind in zip(names, [*kinds[:k], "string", "long", kinds[k], "int"], strict=True))
    counted = read.mapInArrow(rows, schema).groupBy(*names[:k], "token").agg(F.sum("n").alias("n"), F.min(F.struct("position", "at")).alias("first_pos"))
    counted = counted.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=False)], "token", "n", "first_pos")
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first_pos")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def class_tfidf(tokens: DataFrame, cluster: str = "cluster", token: str = "token") -> DataFrame:
    """cluster, token, tf, df, weight: log1p(tf) * (ln((1 + clusters) / (1 + df)) + 1)."""
    tf = tokens.groupBy(cluster, token).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(cluster).alias("k"))
    weight = F.log1p("tf") * (F.log((1 + F.col("k")) / (1 + F.col("df"))) + 1)
    return tf.join(df, token).join(F.broadcast(n)).select(cluster, token, "tf", "df", F.round(weight, 6).alias("weight"))


def centroids(vectors: DataFrame, by: str = "cluster", vector: str = "embedding") -> DataFrame:
    """by, centroid: unit mean of each group, averaged component by component before any shuffle of vectors."""
    each = vectors.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    mean = each.groupBy(by, "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(by, F.transform("m", lambda x: x / F.greatest(length, F.lit(1e-9))).alias("centroid"))


def medoids(vectors: DataFrame, by: str = "cluster", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """by, medoid: the row of each group nearest to its centroid, the least id on a tie."""
    joined = vectors.join(centroids(vectors, by, vector), by)
    near = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return joined.groupBy(by).agg(F.max_by(row_id, F.struct(F.round(near, 9), -F.col(row_id))).alias("medoid"))


def clustered(titles: list[str], vectors: np.ndarray, query: np.ndarray, threshold: float | None = None) -> list[list[int]]:
    """Average-linkage clusters, largest first. What all share with the query is taken out of the
    vectors; the threshold rises with their background similarity; opposite moves only join when
    the titles are close."""
    n = len(titles)
    if n < 2:
        return [[i] for i in range(n)]
    q = query / max(np.linalg.norm(query), 1e-12)
    rest = vectors - np.outer(vectors @ q, q)
    rest = rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)
    semantic = rest @ rest.T
    if threshold is None:
        background = float(semantic[np.triu_indices(n, 1)].mean())
        threshold = min(THRESHOLD_MAX, THRESHOLD + GAIN * max(0.0, background - BACKGROUND))
    grams = [P.grams(P.tokens(t)) for t in titles]
    lexical = np.array([[1.0 if i == j else P.dice(grams[i], grams[j]) for j in range(n)] for i in range(n)])
    signs = [polarity(t) for t in titles]
    sums, words = SEMANTIC * semantic + LEXICAL * lexical, lexical.copy()  # sums over pairs of clusters
    groups, sizes = [[i] for i in range(n)], np.ones(n)
    ways = [{s} - {0} for s in signs]
    while len(groups) > 1:
        share = np.outer(sizes, sizes)
        score = np.where(np.triu(np.ones_like(sums), 1) > 0, sums / share, -np.inf)
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if len(ways[i] | ways[j]) > 1 and words[i, j] / share[i, j] < POLAR_DICE:
                    score[i, j] = -np.inf
        at = int(np.argmax(score))  # the first of equals, row by row
        i, j = divmod(at, len(groups))
        if score[i, j] < threshold or not np.isfinite(score[i, j]):
            break
        for m in (sums, words):
            m[i] += m[j]
            m[:, i] += m[:, j]
        sums, words = (np.delete(np.delete(m, j, 0), j, 1) for m in (sums, words))
        groups[i] += groups.pop(j)
        ways[i] |= ways.pop(j)
        sizes[i] += sizes[j]
        sizes = np.delete(sizes, j)
    return sorted(groups, key=len, reverse=True)


UP = re.compile(f"{L.PRICE_UP}|{L.QUANTITY_UP}|{L.DECISIONS['hike']}")
DOWN = re.compile(f"{L.PRICE_DOWN}|{L.QUANTITY_DOWN}|{L.DECISIONS['cut']}")


def polarity(title: str) -> int:
    return bool(UP.search(title)) - bool(DOWN.search(title))


def clusters(articles: DataFrame, query: str = "query", title: str = "title", vector: str = "embedding", query_vector: str = "query_vector", row_id: str = "news_id", rank: str = "search_rank") -> DataFrame:
    """query, news_id, cluster (0 is the largest) of each query's first MAX_ARTICLES articles."""
    w = Window.partitionBy(query).orderBy(rank, row_id)
    few = articles.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MAX_ARTICLES).select(query, row_id, title, vector, query_vector, "__n")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__n")
        found = clustered(g[title].tolist(), np.array(g[vector].tolist(), float), np.array(g[query_vector].iloc[0], float))
        rows = [(g[query].iloc[0], g[row_id].iloc[i], k) for k, c in enumerate(found) for i in c]
        return pd.DataFrame(rows, columns=[query, row_id, "cluster"])

    kind = lambda c: articles.schema[c].dataType.simpleString()
    return few.groupBy(query).applyInPandas(run, f"{query} {kind(query)}, {row_id} {kind(row_id)}, cluster int")


# Fixed values. Words that can't begin or end a label, and cues of an event.
BOUND_NOUNS = ("속", "앞", "뒤", "중", "간", "내", "외", "후", "전", "상", "하", "위", "아래", "곳", "점", "것", "수", "때", "바", "등", "각종", "만")
WEAK_ENDS = (
    "관련", "대해", "위해", "통해", "따른", "가운데", "이후", "이번", "최근", "올해", "내년", "모습", "상황", "분위기", "얘기", "이유", "배경", "의미", "예정", "주목", "관심",
    "부각", "설명", "참석", "방문", "포석", "수준", "규모", "기준", "입장", "과정", "차원", "일부", "얼마",
)
NOT_FIRST = ("규모", "수준", "가량", "정도", "대비", "이상", "이하", "미만", "초과", "기반", "위주", "중심", "관련", "부문")
EVENT_HEAD = re.compile(
    f"{L.PRICE_UP}|{L.PRICE_DOWN}|{L.QUANTITY_UP}|{L.QUANTITY_DOWN}"
    "|인상|인하|동결|양산|증설|수주|계약|타결|합의|결렬|제재|관세|소송|인수|합병|적자|흑자|호조|부진|둔화|회복|돌파|신고가|차질|규제|지원|중단|재개|도입|출시|수출|수입"
)


def phrases(title: str, query_key: str, model: Model | None = None) -> list[tuple[str, list[str], bool, bool]]:
    """(label, its words, whether it begins a clause, whether it names an event): runs of 2 to 4 words
    of 4 to 16 characters between the marks and predicates of a title. With a model words are cut by it (else by their suffixes),
    and its compounds are labels too."""
    out = []
    for clause in re.split(r"\.{2,}|…+|,|·\s+|/|—|--|\s-\s|[?!:;\"“”‘’]", re.sub(r"\[[^\]]{1,12}\]|\([^)]{1,14}\)", " ", title)):
        run: list[tuple[str, bool]] = []
        runs = [run]
        for word in clause.split():
            if model is not None:
                cut = model.word(word)
                if cut.kind == "STOP":
                    run = []
                    runs.append(run)
                    continue
                if model.compound(cut) and re.sub(r"\s+", "", cut.stem).casefold() != query_key:
                    out.append((cut.stem, list(cut.pieces), not run, bool(EVENT_HEAD.search(cut.stem.casefold().replace(query_key, "")))))
                run.append((cut.stem, not run))
                if cut.kind == "TERM":
                    run = []
                    runs.append(run)
                continue
            base = P.stem(word.casefold())
            shown = word[: len(base)] if base else word
            if re.search(L.PREDICATE, word) or not re.search("[가-힣a-zA-Z0-9]", word):
                run = []
                runs.append(run)
                continue
            run.append((shown, not run))
            if len(base) < len(word):  # a particle ends a noun run
                run = []
                runs.append(run)
        for some in runs:
            for i in range(len(some)):
                if len(some[i][0]) < 2 or some[i][0] in NOT_FIRST or some[i][0] in BOUND_NOUNS:
                    continue
                for size in (2, 3, 4):
                    window = some[i : i + size]
                    label = " ".join(w for w, _ in window)
                    key = re.sub(r"\s+", "", label).casefold()
                    if len(window) < size or window[-1][0] in WEAK_ENDS or any(w in BOUND_NOUNS for w, _ in window) or not 4 <= len(label) <= 16 or key == query_key:
                        continue
                    out.append((label, [w for w, _ in window], window[0][1], bool(EVENT_HEAD.search(key.replace(query_key, "")))))
    return out


def entities_in(text: str, aliases: Spellings) -> set[str]:
    """Names whose spelling stands in the text, longer spellings first, no character used twice."""
    return {m.name for m in longest_first(aliases.matches(text))}


def alias_patterns(names: dict[str, tuple[str, ...]]) -> Spellings:
    """The automaton of all spellings; those of plain characters need borders."""
    return built(flat(names), False)


def label_scores(members: list[int], found: list[list[tuple]], texts: list[str], cluster_df: Counter, clusters_n: int, query_key: str) -> list[tuple[str, float]]:
    """Labels of a cluster with their preliminary scores, best first."""
    per: dict[str, list[tuple]] = defaultdict(list)
    for i in members:
        for p in found[i]:
            per[re.sub(r"\s+", "", p[0]).casefold()].append(p)
    tf = Counter(w for some in per.values() for p in some for w in p[1])
    out = []
    for some in per.values():
        words = [w for w in dict.fromkeys(some[0][1]) if len(w) >= 2 and w.casefold() != query_key]
        if not words:
            continue
        held = sum(sum(w.casefold() in texts[i] for w in words) >= max(1, math.ceil(len(words) * 0.75)) for i in members)
        if len(members) >= 3 and held < 2:
            continue
        label = Counter(p[0] for p in some).most_common(1)[0][0]
        weight = sum(math.log1p(tf[w]) * (math.log((1 + clusters_n) / (1 + cluster_df[w])) + 1) for w in words) / math.sqrt(len(words))
        weight *= 0.45 + 0.55 * held / len(members)
        weight *= (1.15 if any(p[2] for p in some) else 0.82) * (1.25 if any(p[3] for p in some) else 0.88) * (1.10 if 5 <= len(label) <= 13 else 0.92)
        out.append((label, weight))
    return sorted(out, key=lambda x: -x[1])[:MAX_LABELS]


def too_close(label: str, other: str, query_key: str) -> bool:
    a, b = (re.sub(r"\s+", "", x).casefold() for x in (label, other))
    x, y = ({t for t in P.tokens(v) if t != query_key} for v in (label, other))
    near = len(x & y) / min(len(x), len(y)) >= 0.5 if x and y else False
    return a in b or b in a or near or P.dice(P.grams(P.tokens(label)), P.grams(P.tokens(other))) >= 0.55


# Fixed values. The cosine of a label without a vector.
NO_VECTOR = 0.5


def label_cosine(label: str, centre: np.ndarray, known: dict[str, np.ndarray] | None) -> float:
    v = (known or {}).get(label)
    return NO_VECTOR if v is None or len(v) != len(centre) else float(v @ centre / max(np.linalg.norm(v), 1e-9))


def keyword_map_rows(query: str, rows: pd.DataFrame, names: dict[str, tuple[str, ...]], model: Model | None = None, label_vectors: dict[str, np.ndarray] | None = None) -> list[tuple]:
    """(keyword, kind, search_query, article_count, center_news_id, news_ids) of one search, centre first."""
    key = re.sub(r"\s+", "", query).casefold()
    titles, texts = rows["title"].tolist(), rows["description"].fillna("").tolist()
    ids, vectors = rows["news_id"].tolist(), np.array(rows["embedding"].tolist(), float)
    q = np.array(rows["query_vector"].iloc[0], float)
    middle = lambda at: at[int(np.argmax(vectors[at] @ (vectors[at].mean(axis=0) / max(np.linalg.norm(vectors[at].mean(axis=0)), 1e-9))))]
    ask = lambda label: label if key in re.sub(r"\s+", "", label).casefold() else f"{query} {label}"
    groups = [c for c in clustered(titles, vectors, q) if len(c) >= 2]
    found = [phrases(t, key, model) for t in titles]
    folded = [f"{t} {d}".casefold() for t, d in zip(titles, texts, strict=True)]
    cluster_df = Counter(w for c in groups for w in {w for i in c for p in found[i] for w in p[1]})
    ranked = []
    for c in groups[:MAX_CLUSTERS]:
        labels = label_scores(c, found, folded, cluster_df, max(1, len(groups)), key)
        centre = vectors[c].mean(axis=0) / max(np.linalg.norm(vectors[c].mean(axis=0)), 1e-9)
        finals = [(label, score * max(0.1, label_cosine(label, centre, label_vectors)) ** 2) for label, score in labels]
        label, score = max(finals, key=lambda x: x[1], default=("", -1.0))
        ranked.append((len(c) * (1 + 0.12 * math.log1p(max(0.0, score))), label or titles[middle(c)][:14].strip(), c))
    issues: list[tuple] = []
    for _, label, c in sorted(ranked, key=lambda x: -x[0]):
        if len(issues) < MAX_ISSUES and not any(too_close(label, i[0], key) for i in issues):
            issues.append((label, "issue", ask(label), len(c), ids[middle(c)], [ids[i] for i in c]))
    aliases = alias_patterns(names)
    in_title, in_text = [[entities_in(t, aliases) for t in side] for side in (titles, texts)]
    told = " ".join(i[0].casefold() for i in issues)
    pool = []
    for name in sorted(set().union(*in_title, *in_text)):
        at = [i for i in range(len(ids)) if name in in_title[i] or name in in_text[i]]
        n, df = len(ids), len(at)
        norm = re.sub(r"\s+", "", name).casefold()
        if norm == key or norm in {re.sub(r"\s+", "", i[0]).casefold() for i in issues} or df < (2 if n >= 4 else 1) or (n >= 10 and df > int(n * 0.85)):
            continue
        heads = sum(name in in_title[i] for i in at)
        score = (2.0 * heads + (df - heads)) * math.log(1 + n / df) * 1.30 * (0.60 if name.casefold() in told else 1.0)
        pool.append((score, name, at))
    pool.sort(key=lambda x: -x[0])
    entities: list[tuple] = []
    while pool and len(entities) < MAX_ENTITIES:
        sets = [set(e[5]) for e in entities]
        mine = lambda at: {ids[i] for i in at}
        same = lambda p: any((p[1].casefold() in e[0].casefold() or e[0].casefold() in p[1].casefold()) and len(mine(p[2]) & s) / max(1, min(len(p[2]), len(s))) >= 0.65 for e, s in zip(entities, sets, strict=True))
        pool = [p for p in pool if not same(p)]
        if not pool:
            break
        value = lambda p: p[0] * (0.75 - 0.25 * max((len(mine(p[2]) & s) / len(mine(p[2]) | s) for s in sets), default=0.0))
        best = max(pool, key=value)
        pool.remove(best)
        entities.append((best[1], "entity", ask(best[1]), len(best[2]), ids[middle(best[2])], [ids[i] for i in best[2]]))
    return [(query, "center", query, len(ids), ids[int(np.argmax(vectors @ q))], ids), *issues, *entities]


def keyword_map(articles: DataFrame, names: dict[str, tuple[str, ...]] | None = None, model: Model | None = None) -> DataFrame:
    """Nodes of each query's map from its first MAX_ARTICLES articles. model: costs of words (lattice.learn).
    A column label_vectors (map of label to vector, the same in all rows of a query) chooses among a cluster's labels; else each counts as half alike.

    articles: query, query_vector, search_rank, news_id (string), title, description, embedding.
    """
    known = names or L.ALIASES
    w = Window.partitionBy("query").orderBy("search_rank", "news_id")
    few = articles.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MAX_ARTICLES)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        given = g["label_vectors"].iloc[0] if "label_vectors" in g.columns else None
        vectors = {k: np.asarray(v, float) for k, v in dict(given).items() if v is not None} if given is not None else None
        rows = keyword_map_rows(g["query"].iloc[0], g.sort_values("__n"), known, model, vectors)
        out = pd.DataFrame(rows, columns=["keyword", "kind", "search_query", "article_count", "center_news_id", "news_ids"])
        out.insert(0, "position", range(len(out)))
        out.insert(0, "query", g["query"].iloc[0])
        return out

    return few.groupBy("query").applyInPandas(run, "query string, position int, keyword string, kind string, search_query string, article_count int, center_news_id string, news_ids array<string>")


def expansion_terms(raw: Column, own: Column, limit: int = 7) -> Column:
    """Terms of a comma or line separated answer: bullets and blanks stripped, the keyword itself dropped."""
    parts = F.transform(F.split(T.text_or_empty(raw), "[,\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•·0-9.)]+", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.lower(x) != F.lower(own)))), 1, limit)
