"""Jobs over the ``embeddings`` table: KNN classifier (M-21), confusion matrix
(M-22), PCA (M-24)."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KnnConfig
from . import evaluate as EV
from . import knn as K


def embedding_vectors(emb: DataFrame) -> DataFrame:
    """(user_key = vec_id, vec as array<double>, label)."""
    return emb.select(F.col("vec_id").alias("user_key"),
                      F.col("embedding").cast("array<double>").alias("vec"), F.col("label"))


def knn_classifier(emb: DataFrame, k: int = 50, n_folds: int = 5) -> DataFrame:
    """M-21: stratified n-fold KNN classification of every embedding.  The
    fold-assigned vectors are written once to the shared checkpoint folder
    and read independently by each role (lineage cut)."""
    from ..session import scratch_path

    spark = emb.sparkSession
    path = scratch_path(spark, "knn_folds")
    EV.stratified_folds(embedding_vectors(emb), "user_key", "label", n_folds).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    v = read()
    return K.knn_classify(v, None, read(), "label", "fold", KnnConfig(k=k))


def classifier_accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def pca(emb: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """M-24: centred PCA; returns (projection per row, component table with
    explained variance and loadings ranked by |loading| on PC1).  The
    covariance is a d x d aggregate (d = 64), independent of the row count."""
    v = embedding_vectors(emb).withColumn("features", array_to_vector("vec"))
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    proj = model.transform(centred).select("user_key", "label", vector_to_array("pc").alias("pc"))
    proj = proj.select("user_key", "label", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)])
    spark = emb.sparkSession
    comps = model.pc.toArray()          # d x k matrix: small, bounded by the dimension
    ev = model.explainedVariance.toArray()
    rows = [(j, float(comps[j, 0]), float(abs(comps[j, 0])), float(ev[0]), float(ev[1]) if k > 1 else 0.0)
            for j in range(comps.shape[0])]
    loadings = spark.createDataFrame(rows, "dim int, pc1_loading double, abs_loading double, ev1 double, ev2 double")
    return proj, loadings
