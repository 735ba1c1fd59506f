"""Training of the coarse index: transform and centroids."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from .pool import sampled


def transform(units: DataFrame, dims: int | None) -> DataFrame:
    """emb projected on its first principal components, or as it is."""
    if not dims:
        return units
    v = units.withColumn("_v", array_to_vector("emb"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v.select("_v"))
    return model.transform(v).withColumn("emb", vector_to_array("_p")).drop("_v", "_p")


def centroids(units: DataFrame, k: int, train_size: int, metric: str = "ip", iterations: int = 25, seed: int = 7) -> DataFrame:
    """(bucket_id, emb): spherical (ip) or Euclidean (l2) k-means on a fixed sample of train_size vectors."""
    s = sampled(units, train_size, "func_id", "pos").select(array_to_vector("emb").alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="cosine" if metric == "ip" else "euclidean").fit(s)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # k rows
    d = units.sparkSession.createDataFrame(rows, "bucket_id int, emb array<double>")
    return d.withColumn("emb", normalized(F.col("emb"))) if metric == "ip" else d


def choose_nlist(n: int) -> int:
    """Buckets for n vectors: the power of two at or above n / 25, within fixed bounds."""
    return min(262144, max(256, 1 << max(0, (max(1, n // 25) - 1).bit_length())))


def train_size(n: int, nlist: int) -> int:
    """Vectors to train nlist centroids on."""
    return min(n, max(16 * nlist, 30000))


def resolve_nlist(n: int, explicit: int | None = None, known: int | None = None) -> tuple[int, str]:
    """(nlist, why): the one asked for, else the one that another index was built with, else by the number of vectors."""
    if explicit and explicit > 0:
        return explicit, "explicit"
    if known and known > 0:
        return known, "as the other index"
    return choose_nlist(n), "by the number of vectors"
