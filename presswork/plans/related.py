"""Related-article queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import keywords, selection, vector_index
from ..sources.tables import stored, table
from .registered import Plans

plans = Plans()
DIMS = 64


@plans.add("""WITH c AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c.v), 6) AS cosine FROM embeddings, c WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 10""")
def related_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten vectors nearest to vector 0 by cosine, itself excluded."""
    every = table(spark, sf, "embeddings")
    near = selection.vector_top_k(every, every.where("vec_id = 0"), 10, dims=DIMS)
    return near.select("vec_id", F.round("cosine", 6).alias("cosine"))


@plans.add("""WITH q AS (SELECT vec_id AS centre, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT centre, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS cos FROM embeddings, q WHERE vec_id <> centre),
    r AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY round(cos, 12) DESC, vec_id) AS rank FROM s) SELECT centre, vec_id, round(cos, 6) AS cosine, rank FROM r WHERE rank <= 10""")
def related_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every id divisible by 100, each row compared."""
    every = table(spark, sf, "embeddings")
    near = selection.vector_top_k(every, every.where("vec_id % 100 = 0"), 10, dims=DIMS)
    return near.select("centre", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@plans.add()
def related_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the inverted-file index of all rows: approximate neighbours with exact cosines."""
    every = table(spark, sf, "embeddings")
    model = vector_index.fit(every, dims=DIMS)
    index = stored(vector_index.encoded(every, model).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"), "vector-index")
    near = vector_index.search(index, model, every.where("vec_id % 100 = 0"), 10)
    return near.select("centre", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@plans.add("SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0 AS valid, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_validity(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", V.is_valid(v, DIMS).alias("valid"), F.round(V.norm(v), 6).alias("norm"))


@plans.add("""WITH c AS (SELECT embedding::DOUBLE[] AS v, label AS cl FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c.v), 9) AS cos, 'l' || label AS t, 'l' || cl AS ct FROM embeddings, c WHERE vec_id <> 0),
    r AS (SELECT vec_id, greatest(0, least(1, 0.9 * greatest(0, cos) + 0.1 * (1.0 / CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END) - 0)) AS score FROM s)
    SELECT vec_id, round(score, 6) AS score, CASE WHEN score < 0.1 THEN 'below_threshold' END AS gate FROM r""")
def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine to vector 0 blended with shared words; candidates under 0.1 are out."""
    every = table(spark, sf, "embeddings")
    one = every.where("vec_id = 0").select(F.col("embedding").alias("c"))
    pairs = every.where("vec_id <> 0").join(F.broadcast(one))
    cos = F.round(V.cosine(F.col("embedding"), F.col("c")), 9)
    tokens = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("market"))).otherwise(F.array(F.lit("market"), F.lit("rate")))
    entities, centre = F.array(F.lit("bank")), F.array(F.lit("market"))
    score = selection.relevance(cos, centre, tokens, entities)
    return pairs.select("vec_id", F.round(score, 6).alias("score"), selection.gate(score, centre, tokens, entities, 0.1).alias("gate"))


ROUTE_P = """WITH a AS (SELECT vec_id, list_transform(embedding[1:7]::DOUBLE[], lambda x: abs(x)) AS c, list_transform(embedding[8:10]::DOUBLE[], lambda x: abs(x)) AS o, list_transform(embedding[11:14]::DOUBLE[], lambda x: abs(x)) AS h FROM embeddings),
    n AS (SELECT vec_id, list_transform(c, lambda x: x / list_sum(c)) AS c, list_transform(o, lambda x: x / list_sum(o)) AS o, list_transform(h, lambda x: x / list_sum(h)) AS h FROM a),
    q AS (SELECT vec_id, c[1] AS rep, c[2] AS bac, c[3] AS con, c[4] AS per, c[5] AS det, c[6] + c[7] AS off, o[1] AS same, h[3] + h[4] AS hel, h[2] + 2 * h[3] + 3 * h[4] AS lev FROM n)"""


@plans.add(ROUTE_P + """ SELECT vec_id, CASE WHEN rep >= .5 AND same >= .5 THEN 'center_group' WHEN same >= .8 AND bac + con + per + det < .6 AND off < .6 THEN 'center_group' WHEN bac + con + per + det >= .6 AND hel >= .6 THEN 'candidate' WHEN off >= .6 THEN 'excluded' ELSE 'withheld' END AS bucket,
    CASE WHEN NOT (rep >= .5 AND same >= .5) AND NOT (same >= .8 AND bac + con + per + det < .6 AND off < .6) AND bac + con + per + det >= .6 AND hel >= .6 THEN CASE greatest(bac, con, per, det) WHEN bac THEN 'background' WHEN con THEN 'consequence' WHEN per THEN 'perspective' ELSE 'detail' END END AS role, round(lev, 6) AS helpfulness FROM q""")
def decision_route(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets and roles from distributions made of vector components."""

    def distribution(at: int, names: tuple[str, ...]) -> F.Column:
        part = F.transform(F.slice(F.col("embedding").cast("array<double>"), at, len(names)), F.abs)
        total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.transform(part, lambda x: x / total))

    d = table(spark, sf, "embeddings").select(
        "vec_id", distribution(1, ("repeat", "background", "consequence", "perspective", "detail", "tangential", "unrelated")).alias("c"), distribution(8, ("same", "different", "unclear")).alias("o"), distribution(11, ("0", "1", "2", "3")).alias("h"),
    )
    r = selection.route(F.col("o"), F.col("c"), F.col("h"))
    return d.select("vec_id", r["bucket"].alias("bucket"), r["role"].alias("role"), F.round(selection.expected(F.col("h")), 6).alias("helpfulness"))


@plans.add("""WITH e AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
    l AS (SELECT label, sqrt(sum(m * m)) AS n FROM e GROUP BY 1), v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    d AS (SELECT v.vec_id, v.label, round(sum(v.x * e.m / l.n), 9) AS dot FROM v JOIN e USING (label, i) JOIN l USING (label) GROUP BY 1, 2)
    SELECT label AS cluster, arg_max(vec_id, (dot, -vec_id)) AS medoid FROM d GROUP BY label""")
def cluster_medoids(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.medoids(table(spark, sf, "embeddings").withColumnRenamed("label", "cluster"))


MMR = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS len FROM embeddings),
    e AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM e GROUP BY 1),
    s AS (SELECT v.*, list_cosine_similarity(v, c) AS score FROM v JOIN c USING (label)), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 50),
    p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) / (a.len * b.len) AS cos FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id),
    w AS (SELECT label, 1 AS pick_order, arg_min(vec_id, (-round(score, 12), vec_id)) AS vec_id, [arg_min(vec_id, (-round(score, 12), vec_id))] AS chosen FROM k GROUP BY label
      UNION ALL SELECT label, pick_order + 1, pick, list_append(chosen, pick) FROM (SELECT label, pick_order, chosen, arg_min(i, (-round(0.7 * score - 0.3 * near, 12), i)) AS pick FROM (
        SELECT w.label, w.pick_order, w.chosen, p.i, any_value(k.score) AS score, max(p.cos) AS near FROM w JOIN p ON p.label = w.label AND list_contains(w.chosen, p.j) AND NOT list_contains(w.chosen, p.i) JOIN k ON k.vec_id = p.i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) WHERE pick_order < 10)
    SELECT label, vec_id, pick_order FROM w"""


@plans.add(MMR)
def mmr_select(spark: SparkSession, sf: str) -> DataFrame:
    """Ten diverse picks per label, from its fifty best by cosine to the label's centroid."""
    e = table(spark, sf, "embeddings")
    c = keywords.centroids(e.withColumnRenamed("label", "cluster"))
    scored = e.join(c, e["label"] == c["cluster"]).select("label", "vec_id", "embedding", V.cosine(F.col("embedding"), F.col("centroid")).alias("score"))
    return selection.mmr(scored, ["label"], 10)


# The titles are "vector" and a number, of which their shares of letter pairs follow.
LINKAGE = """WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings QUALIFY i < 50),
    c AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY 1), q AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS q FROM c),
    o AS (SELECT label, vec_id, i, list_transform(list_zip(v, q), lambda z: z[1] - list_dot_product(v, q) * z[2]) AS o FROM e JOIN q USING (label)), r AS (SELECT label, vec_id, i, list_transform(o, lambda x: x / greatest(sqrt(list_dot_product(o, o)), 1e-9)) AS r FROM o),
    p AS (SELECT a.label, a.i, b.i AS j, list_dot_product(a.r, b.r) AS semantic, CASE WHEN a.vec_id < 10 AND b.vec_id < 10 THEN 1 WHEN a.vec_id < 10 OR b.vec_id < 10 THEN 10.0 / 11 ELSE 10.0 / 12 END::DOUBLE AS lexical FROM r a JOIN r b ON a.label = b.label AND a.i < b.i),
    t AS (SELECT label, least(0.51, 0.42 + 0.25 * greatest(0, avg(semantic) - 0.30)) AS threshold FROM p GROUP BY 1),
    w AS (SELECT label, 0 AS step, list(i ORDER BY i) AS own FROM e GROUP BY 1
      UNION ALL SELECT label, step + 1, list_transform(own, lambda x: CASE WHEN x = best.hi THEN best.lo ELSE x END) FROM (
        SELECT label, step, own, arg_max({'lo': lo, 'hi': hi}, (score, -lo, -hi)) AS best, max(score) AS score FROM (
          SELECT w.label, w.step, w.own, least(own[p.i + 1], own[p.j + 1]) AS lo, greatest(own[p.i + 1], own[p.j + 1]) AS hi, avg(0.65 * semantic + 0.35 * lexical) AS score FROM w JOIN p ON p.label = w.label WHERE own[p.i + 1] <> own[p.j + 1] GROUP BY 1, 2, 3, 4, 5)
        GROUP BY 1, 2, 3) JOIN t USING (label) WHERE score >= threshold),
    f AS (SELECT label, unnest(own) AS first, unnest(range(len(own))) AS i FROM (SELECT label, arg_max(own, step) AS own FROM w GROUP BY 1)), n AS (SELECT label, first, count(*) AS n FROM f GROUP BY 1, 2),
    k AS (SELECT label, first, (row_number() OVER (PARTITION BY label ORDER BY n DESC, first) - 1)::INT AS cluster FROM n)
    SELECT label AS query, vec_id AS news_id, cluster FROM e JOIN f USING (label, i) JOIN k USING (label, first)"""


@plans.add(LINKAGE)
def cluster_avg_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of each label's first fifty vectors, the label's first vector as the query."""
    e = table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    a = e.join(q, "label").select(F.col("label").alias("query"), F.col("vec_id").alias("news_id"), F.concat(F.lit("vector "), "vec_id").alias("title"), "embedding", "query_vector", F.col("vec_id").alias("search_rank"))
    return keywords.clusters(a)


QUERIES, ORACLE = plans.queries, plans.oracle
