"""Fitted tree ensembles as tables (M-4..M-6, M-14, M-23, L-6, L-7).

``node_table`` reads a saved pipeline's last stage as one row per node; predictions and importances come from that table by DataFrame
functions, so a stored ensemble can be audited, joined and scored without the library that fitted it.  The table holds a row per node,
at most trees x 2 ** (depth + 1), whatever the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


@dataclass
class Ensemble:
    """``nodes``: tree, weight, node, feature (null: leaf), threshold, left, right, value, gain, count.  A row goes left where its feature
    is at most the threshold; the prediction is the sum of weight x value of the leaves reached."""

    nodes: DataFrame
    features: list[str]
    depth: int
    mean_of_trees: bool


def _meta(spark: SparkSession, path: str):
    return spark.read.json(f"{path}/metadata").first()


def node_table(spark: SparkSession, path: str) -> Ensemble:
    """The ensemble of the pipeline saved at ``path`` (an assembler first, a tree ensemble last)."""
    uids = _meta(spark, path)["paramMap"]["stageUids"]
    stage = lambda i: f"{path}/stages/{i:0{len(str(len(uids)))}d}_{uids[i]}"
    names = list(_meta(spark, stage(0))["paramMap"]["inputCols"])
    last = _meta(spark, stage(len(uids) - 1))
    depth = last["paramMap"].asDict().get("maxDepth") or last["defaultParamMap"]["maxDepth"]
    mean = "RandomForest" in last["class"]
    trees = spark.read.parquet(f"{stage(len(uids) - 1)}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    if mean:
        trees = trees.withColumn("weight", F.col("weight") / trees.agg(F.sum("weight")).scalar())
    data = spark.read.parquet(f"{stage(len(uids) - 1)}/data").toDF("tree", "n").select("tree", "n.*")
    inner = F.col("leftChild") >= 0
    if data.where(inner & (F.col("split.numCategories") != -1)).limit(1).count():
        raise ValueError("categorical splits have no threshold")
    nodes = data.select(
        "tree", F.col("id").alias("node"), F.when(inner, F.element_at(F.array(*map(F.lit, names)), F.col("split.featureIndex") + 1)).alias("feature"),
        F.when(inner, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"), F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"), F.col("prediction").alias("value"), F.when(inner, F.col("gain")).alias("gain"),
        F.col("impurityStats")[0].alias("count"),
    )
    return Ensemble(nodes.join(trees, "tree"), names, int(depth), mean)


def saved(model: PipelineModel, name: str) -> Ensemble:
    """``node_table`` of ``model``, saved to the shared folder."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, name)
    model.write().save(path)
    return node_table(spark, path)


def predict(frame: DataFrame, ensemble: Ensemble, out: str = "prediction") -> DataFrame:
    """``frame`` with the prediction of the stored nodes: no join or shuffle of ``frame``, the ensemble comes as one scalar (its size is
    bounded by trees and depth).  Each tree is walked ``depth`` steps from its root; a leaf stays where it is."""
    at = F.array_position(F.array(*map(F.lit, ensemble.features)), F.col("feature"))
    each = ensemble.nodes.groupBy("tree", "weight").agg(
        F.array_sort(F.collect_list(F.struct("node", (at - 1).cast("int").alias("x"), "threshold", "left", "right", "value"))).alias("nodes"))
    trees = each.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes")))).scalar()
    x = F.array(*(F.col(c).cast("double") for c in ensemble.features))

    def leaf(nodes: Column, row: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            here = F.get(nodes, n)
            return F.when(here["left"].isNull(), n).when(F.get(row, here["x"]) <= here["threshold"], here["left"]).otherwise(here["right"])

        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(ensemble.depth)), F.lit(0), step))["value"]

    walked = frame.withColumns({"_trees": trees, "_x": x})
    total = F.aggregate("_trees", F.lit(0.0), lambda s, t: s + t["weight"] * leaf(t["nodes"], F.col("_x")))
    return walked.withColumn(out, total).drop("_trees", "_x")


def importances(ensemble: Ensemble) -> DataFrame:
    """feature, position, splits (nodes that split on it) and gain (its share of gain x rows; of a forest the mean of the trees' shares),
    a row per feature of the model."""
    spark = ensemble.nodes.sparkSession
    inner = ensemble.nodes.where("feature is not null").withColumn("g", F.col("gain") * F.col("count"))
    per_tree = inner.groupBy("tree", "feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("g").alias("g"))
    if ensemble.mean_of_trees:
        sums = per_tree.groupBy("tree").agg(F.sum("g").alias("all"))
        per_tree = per_tree.join(sums, "tree").withColumn("g", F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0))
    own = per_tree.groupBy("feature").agg(F.sum("splits").alias("splits"), F.sum("g").alias("g"))
    total = own.agg(F.sum("g")).scalar()
    names = spark.createDataFrame(list(enumerate(ensemble.features)), "position int, feature string")
    return names.join(own, "feature", "left").select(
        "feature", "position", F.coalesce("splits", F.lit(0)).cast("long").alias("splits"),
        F.when(total > 0, F.coalesce("g", F.lit(0.0)) / total).otherwise(0.0).alias("gain"))


def top_features(ensemble: Ensemble, n: int = 15) -> DataFrame:
    """M-14 / L-6: rank, feature, splits, gain of the ``n`` features with the most splits, ties in the model's order of features."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("splits").desc(), "position"))  # over the features of one model
    return importances(ensemble).withColumn("rank", rank).where(F.col("rank") <= n).select("rank", "feature", "splits", "gain")
