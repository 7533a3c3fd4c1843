"""Location clusters of edits."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwarden.functions.places import nearest_center

N_CLUSTERS = 100
SEED = 42


def fit_clusters(df: DataFrame, k: int = N_CLUSTERS, x: str = "centroid_x", y: str = "centroid_y", seed: int = SEED):
    """Centres as (id, x, y); no more of them than there are rows."""
    points = VectorAssembler(inputCols=[x, y], outputCol="_point").transform(df.select(x, y).dropna())
    rows = points.limit(k).count()
    if rows == 0:
        raise ValueError("no points to cluster")
    model = KMeans(k=min(k, rows), seed=seed, featuresCol="_point", maxIter=300, tol=1e-4).fit(points)
    return [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]


def assign_clusters(df: DataFrame, centers, x: str = "centroid_x", y: str = "centroid_y", name: str = "cluster_label") -> DataFrame:
    """Id of the nearest centre, as one expression of the scan; no model object in the tasks."""
    nearest = nearest_center(F.col(x).cast("double"), F.col(y).cast("double"), centers)
    return df.withColumn(name, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), nearest))
