"""Topics from text vectors: reduce, cluster, describe, merge, inspect."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.vectors import cosine, distance, doubles, literal_vector
from reviewmill.session import materialize

OUTLIER = -1


def reduce_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int = 5) -> DataFrame:
    """(id, reduced): projection on the first principal components."""
    ready = df.select(id_col, array_to_vector(doubles(F.col(vector_col))).alias("__v"))
    model = PCA(k=dimensions, inputCol="__v", outputCol="__r").fit(ready)
    return model.transform(ready).select(id_col, vector_to_array("__r").alias("reduced"))


def cluster_vectors(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 10,
    min_topic_size: int = 20,
    spread: float = 3.0,
    seed: int = 42,
) -> DataFrame:
    """(id, topic, distance): k-means clusters, -1 for rows without a topic.

    Clusters below ``min_topic_size`` become -1, and so do rows farther from their
    centre than the mean of their cluster's distances plus ``spread`` times their
    standard deviation; a tight cluster loses none.  Topics are numbered from 0 by
    size, largest first.
    """
    ready = df.select(id_col, doubles(F.col(vector_col)).alias("__d")).withColumn("__v", array_to_vector("__d"))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c", maxIter=50).fit(ready)
    centres = F.array(*[literal_vector([float(x) for x in centre]) for centre in model.clusterCenters()])
    placed = materialize(
        model.transform(ready).select(
            id_col, "__c", distance(F.col("__d"), F.get(centres, F.col("__c"))).alias("distance")
        ),
        "clusters",
    )
    # One row per cluster, k in all.
    stats = placed.groupBy("__c").agg(
        F.count(F.lit(1)).alias("__n"),
        (F.avg("distance") + spread * F.stddev_pop("distance") + 1e-9).alias("__far"),
    )
    order = Window.orderBy(F.desc("__n"), F.asc("__c"))
    kept = stats.filter(F.col("__n") >= min_topic_size).withColumn("__topic", F.row_number().over(order) - 1)
    joined = placed.join(F.broadcast(kept.select("__c", "__far", "__topic")), "__c", "left")
    near = F.col("distance") <= F.col("__far")
    topic = F.when(near, F.col("__topic")).otherwise(OUTLIER).cast("int")
    return joined.select(id_col, topic.alias("topic"), "distance")


def class_term_counts(df: DataFrame, topic_col: str, tokens_col: str) -> DataFrame:
    """(topic, term, n): counted map-side; the words of a topic are never gathered."""
    words = df.select(F.col(topic_col).alias("topic"), F.explode(tokens_col).alias("term"))
    return words.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))


def class_tfidf(counts: DataFrame) -> DataFrame:
    """(topic, term, weight): share of the term in its topic times ln(1 + A / f).

    f is the term's count over all topics and A the mean number of words a topic.
    """
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("size"))  # one row per topic
    sizes = sizes.withColumn("mean_size", F.avg("size").over(Window.partitionBy()))
    sizes = materialize(sizes, "topic_sizes")
    totals = counts.groupBy("term").agg(F.sum("n").alias("f"))
    return (
        counts.join(totals, "term")
        .join(sizes, "topic")
        .select("topic", "term", (F.col("n") / F.col("size") * F.log1p(F.col("mean_size") / F.col("f"))).alias("weight"))
    )


def class_tfidf_words(counts: DataFrame, n: int = 15) -> DataFrame:
    """(topic, rank, term, weight): best words of each topic."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), F.asc("term"))
    ranked = class_tfidf(counts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("topic", "rank", "term", "weight")


def nearest_topic(counts: DataFrame) -> DataFrame:
    """One row: the smallest topic, the topic most similar to it, their cosine.

    The outlier topic takes no part.  Only the smallest topic's row is compared
    with the others, so the join makes one pair per (term, other topic).
    """
    real = counts.filter(F.col("topic") != OUTLIER)
    weights = materialize(class_tfidf(real), "class_tfidf")
    smallest = (
        real.groupBy("topic").agg(F.sum("n").alias("size")).orderBy("size", F.desc("topic")).limit(1)
        .select(F.col("topic").alias("small"))
    )
    norms = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    chosen = smallest.first()
    if chosen is None:
        raise ValueError("no topic to merge")
    small = chosen["small"]
    mine = weights.filter(F.col("topic") == small).select("term", F.col("weight").alias("w_small"))
    mine_length = F.lit(float(norms.filter(F.col("topic") == small).first()["length"]))
    products = (
        weights.filter(F.col("topic") != small)
        .join(mine, "term", "left")
        .groupBy("topic")
        .agg(F.sum(F.col("weight") * F.coalesce("w_small", F.lit(0.0))).alias("dot"))
    )
    similarity = F.coalesce(F.try_divide(F.col("dot"), F.col("length") * mine_length), F.lit(0.0))
    return (
        products.join(norms, "topic")
        .select(F.lit(small).alias("merged"), F.col("topic").alias("into"), similarity.alias("similarity"))
        .orderBy(F.desc(F.round("similarity", 9)), F.asc("into"))
        .limit(1)
    )


def merge_smallest(counts: DataFrame) -> tuple[DataFrame, int, int] | None:
    """Counts after merging the smallest topic into its nearest, and the two ids."""
    step = nearest_topic(counts).first()
    if step is None:
        return None
    topic = F.when(F.col("topic") == step["merged"], F.lit(step["into"])).otherwise(F.col("topic"))
    merged = counts.withColumn("topic", topic).groupBy("topic", "term").agg(F.sum("n").alias("n"))
    return merged, step["merged"], step["into"]


def reduce_topics(assigned: DataFrame, tokens_col: str, target: int = 5, topic_col: str = "topic") -> DataFrame:
    """Merge topics, smallest first, until ``target`` are left; -1 stays apart.

    ``assigned`` holds one row per text.  Only the (topic, term) counts are
    recomputed in the loop; the texts get their final topic in one projection.
    """
    counts = materialize(class_term_counts(assigned, topic_col, tokens_col), "class_counts")
    topics = [r["topic"] for r in counts.select("topic").filter(F.col("topic") != OUTLIER).distinct().collect()]
    final = {topic: topic for topic in topics}
    while len(set(final.values())) > max(target, 1):
        step = merge_smallest(counts)
        if step is None:
            break
        counts = materialize(step[0], "class_counts")
        final = {old: step[2] if now == step[1] else now for old, now in final.items()}
    moved = {old: now for old, now in final.items() if old != now}
    if not moved:
        return assigned
    table = F.create_map(*[F.lit(part) for pair in moved.items() for part in pair])
    return assigned.withColumn(topic_col, F.coalesce(F.try_element_at(table, F.col(topic_col)), F.col(topic_col)))


def topic_sizes(assigned: DataFrame, topic_col: str = "topic") -> DataFrame:
    return assigned.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def centroid_table(df: DataFrame, topic_col: str, vector_col: str) -> DataFrame:
    """(topic, mean): the mean vector of each topic, summed map-side."""
    vectors = df.select(F.col(topic_col).alias("topic"), array_to_vector(doubles(F.col(vector_col))).alias("__v"))
    means = vectors.groupBy("topic").agg(Summarizer.mean(F.col("__v")).alias("mean"))
    return materialize(means.select("topic", vector_to_array("mean").alias("mean")), "centroids")


def centroids(df: DataFrame, topic_col: str, vector_col: str) -> dict[int, list[float]]:
    """The same on the driver: a vector per topic of a clustering."""
    return {row["topic"]: list(row["mean"]) for row in centroid_table(df, topic_col, vector_col).orderBy("topic").collect()}


def representative_docs(
    df: DataFrame, id_col: str, topic_col: str, vector_col: str, text_col: str | None = None, n: int = 3, chars: int = 200
) -> DataFrame:
    """(topic, rank, id, similarity[, text]): the texts closest to their topic's mean vector.

    Ranking carries ids only; the few winners then fetch their text.
    """
    inside = df.filter(F.col(topic_col) != OUTLIER).select(F.col(topic_col).alias("topic"), id_col, doubles(F.col(vector_col)).alias("__v"))
    near = cosine(F.col("__v"), F.col("mean"))
    rated = inside.join(centroid_table(inside, "topic", "__v"), "topic").select("topic", id_col, F.round(near, 6).alias("similarity"))
    order = Window.partitionBy("topic").orderBy(F.desc("similarity"), F.asc(id_col))
    best = rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    best = best.select("topic", "rank", id_col, "similarity")
    if text_col is None:
        return best
    winners = materialize(best, "winners")  # its size decides how it meets the texts
    return df.select(id_col, F.substring(text_col, 1, chars).alias("text")).join(winners, id_col).select(
        "topic", "rank", id_col, "similarity", "text"
    )


def topic_membership(
    df: DataFrame, id_col: str, vector_col: str, means: dict[int, list[float]]
) -> DataFrame:
    """(id, topic, probability): softmax of the negative distance to each topic's mean.

    The means are literals of the plan, so the whole computation is row-local.
    """
    vector = F.col("__d")
    entries = [
        F.struct(F.lit(topic).alias("topic"), (-distance(vector, literal_vector(mean))).alias("z"))
        for topic, mean in sorted(means.items())
    ]
    scored = df.select(id_col, doubles(F.col(vector_col)).alias("__d")).select(id_col, F.array(*entries).alias("__z"))
    top = F.array_max(F.transform("__z", lambda e: e["z"]))
    weighted = scored.withColumn("__top", top).select(
        id_col,
        F.transform("__z", lambda e: F.struct(e["topic"].alias("topic"), F.exp(e["z"] - F.col("__top")).alias("e"))).alias("__e"),
    )
    total = F.aggregate("__e", F.lit(0.0), lambda acc, e: acc + e["e"])
    return weighted.withColumn("__total", total).select(id_col, "__total", F.inline("__e")).select(
        id_col, "topic", (F.col("e") / F.col("__total")).alias("probability")
    )


def reassign(df: DataFrame, id_col: str, vector_col: str, topic_col: str = "topic") -> DataFrame:
    """Give every row, outliers too, the topic whose mean vector is nearest; ties go to the smaller topic.

    The means of a clustering's topics are one array of the plan, so rows stay where
    they are. Without any topic the rows keep what they have.
    """
    means = centroids(df.filter(F.col(topic_col) != OUTLIER), topic_col, vector_col)
    if not means:
        return df
    vector = doubles(F.col(vector_col))
    near = [F.struct(F.round(distance(vector, literal_vector(mean)), 6).alias("d"), F.lit(topic).alias("t")) for topic, mean in sorted(means.items())]
    return df.withColumn(topic_col, F.array_min(F.array(*near))["t"].cast("int"))


def topic_report(
    df: DataFrame, id_col: str, tokens_col: str, vector_col: str, words: int = 10, **settings: object
) -> DataFrame:
    """(topic, rank, term, weight, n_docs, share, coherence): the pipeline from vectors to described topics.

    Vectors are reduced and clustered, small topics merged, rows assigned anew to the
    topics left; each topic then gets its words, its size and mean membership, and the
    coherence of its words.
    """
    from reviewmill.operators.coherence import topic_coherence

    assigned = materialize(reassign(embedding_topics(df, id_col, tokens_col, vector_col, **settings), id_col, vector_col), "assigned")
    counts = materialize(class_term_counts(assigned.filter(F.col("topic") != OUTLIER), "topic", tokens_col), "class_counts")
    described = materialize(class_tfidf_words(counts, words), "topic_words")
    scores = topic_coherence(assigned, id_col, tokens_col, described.select("topic", F.col("term").alias("word")))
    means = centroids(assigned.filter(F.col("topic") != OUTLIER), "topic", vector_col)
    member = topic_membership(assigned, id_col, vector_col, means).join(assigned.select(id_col, "topic"), [id_col, "topic"])
    sizes = member.groupBy("topic").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("probability").alias("share"))
    return described.join(sizes, "topic").join(scores, "topic")


def embedding_topics(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    vector_col: str,
    k: int = 10,
    dimensions: int = 5,
    min_topic_size: int = 20,
    reduce_to: int | None = 5,
    seed: int = 42,
) -> DataFrame:
    """(id, tokens, vector, topic): reduce, cluster, then merge topics down to ``reduce_to``."""
    reduced = materialize(reduce_vectors(df, id_col, vector_col, dimensions), "reduced")
    clusters = cluster_vectors(reduced, id_col, "reduced", k, min_topic_size, seed=seed)
    assigned = df.join(clusters.select(id_col, "topic"), id_col)
    return assigned if reduce_to is None else reduce_topics(assigned, tokens_col, reduce_to)
