"""Queries on embeddings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.base import query, table


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS sd FROM x GROUP BY i)
SELECT vec_id, i::BIGINT AS i, floor((v - mean) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END * 10000 + 0.5)::BIGINT AS z FROM x JOIN m USING (i)""")
def zscore_embeddings(spark, sf_dir):
    """Standardised components; the moments are one row a dimension."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    m = x.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    z = (F.col("v") - F.col("mean")) / F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd"))
    return x.join(F.broadcast(m), "i").select("vec_id", "i", T.per_myriad(z).alias("z"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, x.label, c.label AS other, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (i) GROUP BY ALL), s AS (SELECT vec_id, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY ALL)
SELECT vec_id, floor((b - a) / greatest(a, b) * 10000 + 0.5)::BIGINT AS silhouette FROM s""")
def centroid_silhouette(spark, sf_dir):
    """Silhouette against cluster centres: linear in the vectors, where all pairs would be a square."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centres = means.agg(F.collect_list(F.struct("label", F.transform("c", lambda x: x["m"]).alias("c")))).scalar()  # one row: as many centres as labels
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    d = v.withColumn("centres", centres).withColumn("d", F.transform("centres", lambda c: F.struct(c["label"].alias("label"), far(F.col("v"), c["c"]).alias("d"))))
    least = lambda same: F.array_min(F.transform(F.filter("d", lambda x: (x["label"] == F.col("label")) == F.lit(same)), lambda x: x["d"]))
    return d.withColumns({"a": least(True), "b": least(False)}).select("vec_id", T.per_myriad((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


@query("""WITH x AS (SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS after FROM embeddings), g AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, floor(list_sum(list_transform(list_zip(a, b), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) * 10000 + 0.5)::BIGINT AS dot FROM g""")
def dot_adjacent(spark, sf_dir):
    """Dot products of neighbours, by an equi-join on the id."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    dot = F.aggregate(F.zip_with("embedding", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.join(b, "vec_id").select("vec_id", T.per_myriad(dot).alias("dot"))


@query()
def kmeans_clusters(spark, sf_dir):
    """k-means over the vectors: cluster sizes under a fixed seed."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=6, seed=1234, maxIter=30).fit(v).transform(v).select("vec_id", F.col("prediction").cast("long").alias("cluster"))
