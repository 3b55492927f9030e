"""Distance, clustering and evaluation queries."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.functions import vectors
from doclens.operators import clustering as K
from doclens.operators import evaluation as E
from doclens.operators import sparse
from doclens.operators import vocab as V
from doclens.plans import clustering_report
from doclens.session import written
from workload import common as C
from workload.common import Registry

R = Registry()
SEEDS = 10

_CENTERS = f"c0 AS (SELECT vec_id::INTEGER AS cluster, vec AS center FROM emb ORDER BY vec_id LIMIT {SEEDS})"


def _distance_sql(distance: str, a: str, b: str) -> str:
    if distance == "euclidean":
        return f"list_distance({a}, {b})"
    return f"1 - list_cosine_similarity({a}, {b})"


def _round_sql(number: int, distance: str = "euclidean") -> str:
    """Assignment ``a{number}`` by the centroids ``c{number}``, and the next centroids."""
    i, j = number, number + 1
    return f"""a{i} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT e.vec_id, c.cluster,
    {_distance_sql(distance, 'e.vec', 'c.center')} AS d FROM emb e, c{i} c) GROUP BY vec_id),
m{j} AS (SELECT cluster, list(x ORDER BY pos) AS center FROM (SELECT cluster, pos, avg(x) AS x FROM
    (SELECT a.cluster, generate_subscripts(e.vec, 1) AS pos, unnest(e.vec) AS x FROM emb e JOIN a{i} a USING (vec_id))
    GROUP BY cluster, pos) GROUP BY cluster),
c{j} AS (SELECT c.cluster, coalesce(m.center, c.center) AS center FROM c{i} c LEFT JOIN m{j} m USING (cluster))"""


def _rounds_sql(rounds: int, distance: str = "euclidean") -> str:
    return ",\n".join([f"WITH {C.EMB}", _CENTERS, *[_round_sql(i, distance) for i in range(rounds)]])


def _seeds(points):
    return K.first_k(points, SEEDS, "vec_id")


def fitted(spark, sf, rounds, distance="euclidean"):
    points = C.embeddings(spark, sf)
    model = K.kmeans_lloyd(points, SEEDS, rounds, distance, "vec_id")
    return points, model


@R.add("l2_norm", f"WITH {C.EMB} SELECT vec_id, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm FROM emb")
def l2_norm(spark, sf):
    return C.embeddings(spark, sf).select("vec_id", F.round(vectors.l2_norm(F.col("vec")), 6).alias("norm"))


def _pair_query(name: str, distance: str, value: str, expression: str):
    @R.add(
        name,
        f"WITH {C.EMB}, {_CENTERS} SELECT e.vec_id, c.cluster, round({expression}, 6) AS {value} FROM emb e, c0 c",
    )
    def query(spark, sf):
        points = C.embeddings(spark, sf)
        pairs = K.pair_distances(points, _seeds(points), distance, "vec_id")
        number = F.col("distance") if value == "distance" else 1 - F.col("distance")
        return pairs.select("vec_id", "cluster", F.round(number, 6).alias(value))


_pair_query("euclidean_pairs", "euclidean", "distance", "list_distance(e.vec, c.center)")
_pair_query("cosine_pairs", "cosine", "similarity", "list_cosine_similarity(e.vec, c.center)")


@R.add("assign_nearest", f"{_rounds_sql(1)} SELECT vec_id, cluster FROM a0")
def assign_nearest(spark, sf):
    points = C.embeddings(spark, sf)
    return K.assign_nearest(points, _seeds(points)).select("vec_id", "cluster")


@R.add("assign_nearest_cosine", f"{_rounds_sql(1, 'cosine')} SELECT vec_id, cluster FROM a0")
def assign_nearest_cosine(spark, sf):
    points = C.embeddings(spark, sf)
    return K.assign_nearest(points, _seeds(points), "cosine").select("vec_id", "cluster")


_MANHATTAN = (
    f"WITH {C.EMB}, {_CENTERS}, parts AS (SELECT e.vec_id, c.cluster, unnest(e.vec) AS x, unnest(c.center) AS y FROM emb e, c0 c), "
    "d AS (SELECT vec_id, cluster, sum(abs(x - y)) AS d FROM parts GROUP BY vec_id, cluster) "
    "SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY vec_id"
)


@R.add("custom_distance", _MANHATTAN)
def custom_distance(spark, sf):
    """Any function of two array columns serves as a distance; here the sum of absolute gaps."""

    def manhattan(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)

    points = C.embeddings(spark, sf)
    return K.assign_nearest(points, _seeds(points), manhattan).select("vec_id", "cluster")


@R.add(
    "centroid_update",
    f"{_rounds_sql(1)}, parts AS (SELECT cluster, generate_subscripts(center, 1) - 1 AS pos, unnest(center) AS x FROM m1), "
    "sizes AS (SELECT cluster, count(*) AS n FROM a0 GROUP BY cluster) "
    "SELECT cluster, n, pos::INTEGER AS pos, round(x, 6) AS x FROM parts JOIN sizes USING (cluster)",
)
def centroid_update(spark, sf):
    points = C.embeddings(spark, sf)
    means = K.cluster_means(K.assign_nearest(points, _seeds(points)))
    return means.select("cluster", "n", F.posexplode("centroid").alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


@R.add("kmeans_lloyd", f"{_rounds_sql(3)} SELECT vec_id, cluster FROM a2")
def kmeans_lloyd(spark, sf):
    """Three rounds."""
    points, model = fitted(spark, sf, 3)
    return model.assignments(points).select("vec_id", "cluster")


@R.add("kmeans_lloyd_cosine", f"{_rounds_sql(2, 'cosine')} SELECT vec_id, cluster FROM a1")
def kmeans_lloyd_cosine(spark, sf):
    points, model = fitted(spark, sf, 2, "cosine")
    return model.assignments(points).select("vec_id", "cluster")


def _settled(assigned, again):
    """Rows in all, and those that one more assignment would move."""
    return assigned.agg(
        F.count("cluster").alias("points"), F.count_if(F.col(again) != F.col("cluster")).alias("moved")
    )


_SETTLED = "SELECT count(*) AS points, 0::BIGINT AS moved FROM embeddings"


@R.add("kmeans_lloyd_converged", _SETTLED)
def kmeans_lloyd_converged(spark, sf):
    """Until no row moves: every row is in a cluster, and one more assignment changes none."""
    points, model = fitted(spark, sf, 1000)
    return _settled(model.predict(model.assignments(points), out="again"), "again")


@R.add("kmeans_fit", _SETTLED)
def kmeans_fit(spark, sf):
    """Library k-means: every row is in the cluster of its nearest centre."""
    from pyspark.ml.functions import array_to_vector

    points = C.embeddings(spark, sf).withColumn("features", array_to_vector("vec"))
    model = K.kmeans_fit(points, 10, seed=1)
    centres = [list(map(float, centre)) for centre in model.clusterCenters()]
    return _settled(K.assign_nearest(model.transform(points), centres, out="nearest"), "nearest")


@R.add(
    "choose_k",
    f"WITH {C.LABELLED}, t AS (SELECT *, {C.words_sql('text')} AS tokens FROM labelled) "
    "SELECT count(DISTINCT label) AS n_labels FROM (SELECT unnest(topics) AS label FROM t WHERE split = 'train' AND len(tokens) < 200)",
)
def choose_k(spark, sf):
    from doclens.operators.lengths import filter_length

    train, _ = V.split_train_test(filter_length(V.with_tokens(C.labelled(spark, sf, "text"))))
    return K.label_count(train)


@R.add(
    "cluster_members",
    f"{_rounds_sql(1)} SELECT cluster, vec_id, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS member_no, "
    "count(*) OVER (PARTITION BY cluster) AS size FROM a0",
)
def cluster_members(spark, sf):
    points = C.embeddings(spark, sf)
    return K.cluster_members(K.assign_nearest(points, _seeds(points)), "vec_id").select(
        "cluster", "vec_id", "member_no", "size"
    )


# --- evaluation: documents clustered by a rule, labels from the labels table ---


def clustered(spark, sf):
    """Documents that have a vector, each in the cluster of its nearest centroid; the centroids are the
    first vectors, and test documents are predicted with them."""
    points = C.embeddings(spark, sf)
    assigned = K.assign_nearest(points, _seeds(points)).select(F.col("vec_id").alias("doc_id"), "cluster")
    return C.labelled(spark, sf).join(assigned, "doc_id")


_CLUSTERED = (
    f"{_rounds_sql(1).removeprefix('WITH ')}, {C.LABELLED}, "
    "clustered AS (SELECT l.doc_id, l.split, l.topics, a0.cluster FROM labelled l JOIN a0 ON l.doc_id = a0.vec_id), "
    "train AS (SELECT * FROM clustered WHERE split = 'train'), test AS (SELECT * FROM clustered WHERE split = 'test'), "
    "counts AS (SELECT cluster, label, count(*) AS n FROM (SELECT cluster, unnest(topics) AS label FROM train) GROUP BY cluster, label), "
    "top AS (SELECT * FROM (SELECT cluster, label, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS rank FROM counts) WHERE rank <= {limit}), "
    "sizes AS (SELECT cluster, count(*) AS size FROM train GROUP BY cluster), "
    "purity AS (SELECT cluster, size, label, coalesce(n, 0) AS n, coalesce(n::DOUBLE / size, 0) AS purity FROM sizes LEFT JOIN "
    "(SELECT * FROM top WHERE rank = 1) USING (cluster))"
)
_EVAL = "WITH " + _CLUSTERED.replace("{limit}", "5")


def _train(spark, sf):
    return V.split_train_test(clustered(spark, sf))[0]


@R.add("cluster_label_counts", f"{_EVAL} SELECT cluster, label, n, size FROM counts JOIN sizes USING (cluster)")
def cluster_label_counts(spark, sf):
    train = _train(spark, sf)
    return E.cluster_label_counts(train).join(F.broadcast(E.cluster_sizes(train)), "cluster")


@R.add("top5_labels", f"{_EVAL} SELECT cluster, label, n, rank FROM top")
def top5_labels(spark, sf):
    return E.top_labels(E.cluster_label_counts(_train(spark, sf)))


@R.add("cluster_purity", f"{_EVAL} SELECT cluster, size, label, n, round(purity, 6) AS purity FROM purity")
def cluster_purity(spark, sf):
    return E.cluster_purities(_train(spark, sf)).withColumn("purity", F.round("purity", 6))


@R.add("pseudo_purity", f"{_EVAL} SELECT round(avg(purity), 6) AS pseudo_purity FROM purity")
def pseudo_purity(spark, sf):
    return E.pseudo_purity(_train(spark, sf)).select(F.round("pseudo_purity", 6).alias("pseudo_purity"))


def _hits_sql(limit: int) -> str:
    return (
        "WITH " + _CLUSTERED.replace("{limit}", str(limit)) + ", truth AS (SELECT doc_id, cluster, len(topics) AS total, unnest(topics) AS label FROM test), "
        "hits AS (SELECT doc_id, any_value(total) AS total, count(top.label) AS hits FROM truth LEFT JOIN top USING (cluster, label) GROUP BY doc_id) "
        f"SELECT round(sum(hits::DOUBLE / least({limit}, total)) / (SELECT count(*) FROM test), 6) AS hit_rate FROM hits"
    )


def _hits(spark, sf, limit):
    train, test = V.split_train_test(clustered(spark, sf))
    top = E.top_labels(E.cluster_label_counts(train), limit)
    return E.top_label_hit_rate(test, top, limit).select(F.round("hit_rate", 6).alias("hit_rate"))


@R.add("top5_hit_rate", _hits_sql(5))
def top5_hit_rate(spark, sf):
    return _hits(spark, sf, 5)


@R.add("top2_hit_rate", _hits_sql(2))
def top2_hit_rate(spark, sf):
    return _hits(spark, sf, 2)


_SILHOUETTE = (
    f"{_rounds_sql(1)}, sample AS (SELECT vec_id, vec, cluster FROM emb JOIN a0 USING (vec_id) "
    f"ORDER BY {C.hex_sql(0, 'vec_id')}, vec_id LIMIT 1000), "
    "sizes AS (SELECT cluster, count(*) AS size FROM sample GROUP BY cluster), "
    "gaps AS (SELECT p.vec_id, p.cluster AS own, q.cluster AS other, sum(list_distance(p.vec, q.vec)) AS total "
    "FROM sample p, sample q GROUP BY p.vec_id, p.cluster, q.cluster), "
    "means AS (SELECT vec_id, own, other, size, CASE WHEN own = other THEN total / nullif(size - 1, 0) ELSE total / size END AS m "
    "FROM gaps JOIN sizes ON other = cluster), "
    "ab AS (SELECT vec_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY vec_id), "
    "s AS (SELECT vec_id, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)"
)


@R.add("silhouette", f"{_SILHOUETTE} SELECT round(avg(s), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    points = C.embeddings(spark, sf)
    assigned = K.assign_nearest(points, _seeds(points))
    return E.silhouette(assigned, id_col="vec_id").select(F.round("silhouette", 6).alias("silhouette"))


@R.add("silhouette_rows", f"{_SILHOUETTE} SELECT vec_id, round(s, 6) AS silhouette FROM s")
def silhouette_rows(spark, sf):
    points = C.embeddings(spark, sf)
    sample = E.silhouette_sample(K.assign_nearest(points, _seeds(points)), id_col="vec_id")
    return E.silhouettes(sample).select("vec_id", F.round("silhouette", 6).alias("silhouette"))


def _as_entries(points: DataFrame) -> DataFrame:
    """Dense rows as sparse ones."""
    return points.withColumn("weights", F.transform("vec", lambda x, i: F.struct(i.alias("idx"), x.alias("weight"))))


@R.add("sparse_silhouette_rows", f"{_SILHOUETTE} SELECT vec_id, round(s, 6) AS silhouette FROM s")
def sparse_silhouette_rows(spark, sf):
    """The same from dot products through an inverted index."""
    points = C.embeddings(spark, sf)
    sample = E.silhouette_sample(K.assign_nearest(points, _seeds(points)), id_col="vec_id")
    return sparse.silhouettes(_as_entries(sample)).select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@R.add("sparse_kmeans", f"{_rounds_sql(3)} SELECT vec_id, cluster FROM a2")
def sparse_kmeans(spark, sf):
    """Three rounds with sparse rows and centroids, from the first rows by id."""
    rows = _as_entries(C.embeddings(spark, sf)).drop("vec")
    first = [row["vec_id"] for row in rows.select("vec_id").orderBy("vec_id").limit(SEEDS).collect()]
    seeds = rows.filter(F.col("vec_id").isin(first))
    items = F.array_position(F.array(*map(F.lit, first)), F.col("vec_id")) - 1
    model = sparse.sparse_kmeans(rows, SEEDS, 2, id_col="vec_id", initial=sparse.entries(seeds.withColumn("_item", items), "_item"))
    return model.predict(rows).select("vec_id", "cluster")


@R.add(
    "squared_silhouette",
    f"{_rounds_sql(1)}, sizes AS (SELECT cluster, count(*) AS size FROM a0 GROUP BY cluster), "
    "placed AS (SELECT vec_id, vec, cluster FROM emb JOIN a0 USING (vec_id)), "
    "gaps AS (SELECT p.vec_id, p.cluster AS own, q.cluster AS other, sum(pow(list_distance(p.vec, q.vec), 2)) AS total "
    "FROM placed p, placed q GROUP BY p.vec_id, p.cluster, q.cluster), "
    "means AS (SELECT vec_id, own, other, CASE WHEN own = other THEN total / nullif(size - 1, 0) ELSE total / size END AS m "
    "FROM gaps JOIN sizes ON other = cluster), "
    "ab AS (SELECT vec_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY vec_id) "
    "SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS score, "
    "count(*) AS n FROM ab",
)
def squared_silhouette(spark, sf):
    """All rows, by squared distance, linear in the data."""
    from pyspark.ml.functions import array_to_vector

    points = C.embeddings(spark, sf).withColumn("features", array_to_vector("vec"))
    assigned = K.assign_nearest(points, _seeds(points))
    score = E.squared_silhouette(assigned)
    return assigned.agg(F.round(F.lit(score), 6).alias("score"), F.count(F.lit(1)).alias("n"))


# --- three clusterings of the vectors: one round, cosine, and the given label ---

_THREE = (
    f"{_rounds_sql(1)}, k AS (SELECT e.vec_id, arg_min(c.cluster, (1 - list_cosine_similarity(e.vec, c.center), c.cluster)) AS cluster "
    "FROM emb e, c0 c GROUP BY e.vec_id), "
    "wide AS (SELECT vec_id, a0.cluster AS euclid, k.cluster AS cosine, label AS truth FROM a0 JOIN k USING (vec_id) JOIN emb USING (vec_id)), "
    "cells AS (SELECT pair, a, b, count(*) AS n FROM (SELECT 'euclid~cosine' AS pair, euclid AS a, cosine AS b FROM wide "
    "UNION ALL SELECT 'euclid~truth', euclid, truth FROM wide UNION ALL SELECT 'cosine~truth', cosine, truth FROM wide) GROUP BY pair, a, b), "
    "ra AS (SELECT pair, a, sum(n)::BIGINT AS na FROM cells GROUP BY pair, a), "
    "rb AS (SELECT pair, b, sum(n)::BIGINT AS nb FROM cells GROUP BY pair, b), "
    "tt AS (SELECT pair, sum(n)::BIGINT AS nn FROM cells GROUP BY pair), "
    "ari AS (SELECT pair, coalesce((s - x * y / t) / nullif((x + y) / 2 - x * y / t, 0), 1) AS ari FROM "
    "(SELECT pair, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM cells GROUP BY pair) JOIN (SELECT pair, sum(na * (na - 1) / 2.0::DOUBLE) AS x FROM ra GROUP BY pair) USING (pair) "
    "JOIN (SELECT pair, sum(nb * (nb - 1) / 2.0::DOUBLE) AS y FROM rb GROUP BY pair) USING (pair) "
    "JOIN (SELECT pair, nn * (nn - 1) / 2.0::DOUBLE AS t FROM tt) USING (pair)), "
    "mi AS (SELECT pair, sum(n::DOUBLE / nn * ln(nn::DOUBLE * n / (na::DOUBLE * nb))) AS mi FROM cells JOIN ra USING (pair, a) JOIN rb USING (pair, b) JOIN tt USING (pair) GROUP BY pair), "
    "ha AS (SELECT pair, -sum(na::DOUBLE / nn * ln(na::DOUBLE / nn)) AS ha FROM ra JOIN tt USING (pair) GROUP BY pair), "
    "hb AS (SELECT pair, -sum(nb::DOUBLE / nn * ln(nb::DOUBLE / nn)) AS hb FROM rb JOIN tt USING (pair) GROUP BY pair), "
    "info AS (SELECT pair, mi, ha, hb FROM mi JOIN ha USING (pair) JOIN hb USING (pair)), "
    "overlap AS (SELECT pair, na, nb, nn, unnest(range(greatest(1, na + nb - nn), least(na, nb) + 1)) AS n FROM ra JOIN rb USING (pair) JOIN tt USING (pair)), "
    "emi AS (SELECT pair, sum(n::DOUBLE / nn * ln(nn::DOUBLE * n / (na::DOUBLE * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(nn - na + 1) + lgamma(nn - nb + 1) "
    "- lgamma(nn + 1) - lgamma(n + 1) - lgamma(na - n + 1) - lgamma(nb - n + 1) - lgamma(nn - na - nb + n + 1))) AS emi FROM overlap GROUP BY pair), "
    "ami AS (SELECT pair, (mi - emi) / ((ha + hb) / 2 - emi) AS ami FROM info JOIN emi USING (pair))"
)


def three(spark, sf):
    points = C.embeddings(spark, sf)
    seeds = _seeds(points)
    by_length = K.assign_nearest(points, seeds, out="euclid")
    return K.assign_nearest(by_length, seeds, "cosine", out="cosine").select(
        "vec_id", "euclid", "cosine", F.col("label").alias("truth")
    )


def cells(spark, sf):
    return written(E.pair_contingency(three(spark, sf), ["euclid", "cosine", "truth"]), "cells")


@R.add("contingency", f"{_THREE} SELECT pair, a, b, n FROM cells WHERE pair = 'euclid~truth'")
def contingency(spark, sf):
    rows = three(spark, sf)
    left = rows.select("vec_id", F.col("euclid").alias("cluster"))
    right = rows.select("vec_id", F.col("truth").alias("cluster"))
    return E.contingency(left, right, "vec_id", "euclid~truth")


@R.add("ari", f"{_THREE} SELECT pair, round(ari, 6) AS ari FROM ari")
def ari(spark, sf):
    return E.adjusted_rand(cells(spark, sf)).withColumn("ari", F.round("ari", 6))


def _nmi(name, average, mean):
    @R.add(name, f"{_THREE} SELECT pair, round(mi / {mean}, 6) AS nmi FROM info")
    def query(spark, sf):
        scores = E.normalised_mutual_information(cells(spark, sf), average)
        return scores.withColumn("nmi", F.round("nmi", 6))


_nmi("nmi", "arithmetic", "((ha + hb) / 2)")
_nmi("nmi_geometric", "geometric", "sqrt(ha * hb)")
_nmi("nmi_max", "max", "greatest(ha, hb)")


@R.add("ami", f"{_THREE} SELECT pair, round(ami, 6) AS ami FROM ami")
def ami(spark, sf):
    return E.adjusted_mutual_information(cells(spark, sf)).withColumn("ami", F.round("ami", 6))


@R.add(
    "compare_all",
    f"{_THREE} SELECT pair, round(ami, 6) AS ami, round(mi / ((ha + hb) / 2), 6) AS nmi, round(ari, 6) AS ari "
    "FROM ami JOIN info USING (pair) JOIN ari USING (pair)",
)
def compare_all(spark, sf):
    scores = E.compare_clusterings(cells(spark, sf))
    return scores.select("pair", *[F.round(name, 6).alias(name) for name in ("ami", "nmi", "ari")])


@R.add(
    "compare_reports",
    "SELECT * FROM (VALUES ('dense~tfidf', true, true), ('dense~small_tfidf', true, true), "
    "('tfidf~small_tfidf', true, true)) AS t(pair, same_scores, in_range)",
)
def compare_reports(spark, sf):
    """The whole comparison: word vectors, tf-idf and small tf-idf, clustered and compared. Each pair's
    scores against those of its two assignments joined by document."""
    docs = C.labelled(spark, sf, "text")
    reports, scores = clustering_report.compare_all(docs, k=6, max_features=C.CAP)
    pairs = [pair.split("~") for pair in ("dense~tfidf", "dense~small_tfidf", "tfidf~small_tfidf")]
    joint = [E.contingency(reports[a].train, reports[b].train, "doc_id", f"{a}~{b}") for a, b in pairs]
    again = E.compare_clusterings(written(reduce(DataFrame.unionByName, joint), "cells"))
    both = scores.join(again.select("pair", *[F.col(s).alias(f"_{s}") for s in ("ami", "nmi", "ari")]), "pair")
    close = [F.abs(F.col(s) - F.col(f"_{s}")) < 1e-9 for s in ("ami", "nmi", "ari")]
    ranged = [F.col(s).between(-1.0, 1.0 + 1e-9) for s in ("ami", "nmi", "ari")]
    return both.select("pair", reduce(and_, close).alias("same_scores"), reduce(and_, ranged).alias("in_range"))
