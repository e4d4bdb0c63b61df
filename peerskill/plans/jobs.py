"""End-to-end jobs as DataFrame compositions (E-1 .. E-8).

Each job takes DataFrames (or the TESTDATA adapters) and returns DataFrames;
the caller decides where to write.  Intermediate tables that are reused by
several downstream stages are the user-tag table and the KNN vectors; on a
cluster they are written once (``materialize``) rather than recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import benchmark as B
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import clean as C
from ..operators import knn as K
from ..operators import recommend as R
from ..operators import skill as S
from ..session import scratch_path
from ..sources import testdata as td


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: the lineage is cut, reuse costs one scan, and a lost executor
    never forces the upstream stages to rerun."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Inputs:
    """Lazily built, cached-by-name DataFrames over one TESTDATA folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, fn):
        if name not in self._cache:
            self._cache[name] = fn()
        return self._cache[name]

    # raw adapters
    def att_scale(self) -> DataFrame:
        return self._get("att_scale", lambda: td.att_scale(self.spark, self.sf_dir))

    def att_order(self) -> DataFrame:
        return self._get("att_order", lambda: td.att_order(self.spark, self.sf_dir))

    def ratings(self) -> DataFrame:
        return self._get("ratings", lambda: td.customer_profiles(self.spark, self.sf_dir))

    # E-6 / A-22 / E-1 ------------------------------------------------------
    def raw_pairs(self) -> DataFrame:
        """(user, item) table of decided attempts (P-6..P-8 then A-1..A-3):
        the only stage that reads the attempt log; written once."""
        return self._get("raw_pairs", lambda: materialize(
            self.spark, S.per_item(C.decided(self.att_scale())), "raw_pairs"))

    def items(self) -> DataFrame:
        """Item dimension of the items present (distinct over the pair table)."""
        return self._get("items", lambda: materialize(self.spark, td.items(self.raw_pairs_keys()), "items"))

    def raw_pairs_keys(self) -> DataFrame:
        return self.raw_pairs().select("item", F.regexp_extract("item", r"(\d+)$", 1).cast("int").alias("item_key"))

    def items_order(self) -> DataFrame:
        """Item dimension of the att_order feed."""
        return self._get("items_order", lambda: td.items(self.att_order()))

    def attempts(self) -> DataFrame:
        """Row-level cleaned attempts (E-6), with tags."""
        return self._get("attempts", lambda: C.clean_attempts(self.att_scale(), self.items(),
                                                                self.settings.min_accepted))

    def pairs(self) -> DataFrame:
        """Cleaned (user, item) table (P-10, P-12 at pair grain)."""
        return self._get("pairs", lambda: S.clean_pairs(self.raw_pairs(), self.items(), self.settings.min_accepted))

    def profiles(self) -> DataFrame:
        return self._get("profiles", lambda: S.derive_profiles(self.pairs(), self.items(), self.ratings()))

    def user_tag(self) -> DataFrame:
        return self._get("user_tag", lambda: S.user_tag_strengths(self.pairs(), self.items(), self.profiles()))

    # written stages reused by several consumers
    def items_table(self) -> DataFrame:
        return self.items()

    def pairs_table(self) -> DataFrame:
        return self._get("pairs_t", lambda: materialize(self.spark, self.pairs(), "pairs"))

    def profiles_table(self) -> DataFrame:
        return self._get("profiles_t", lambda: materialize(
            self.spark, S.derive_profiles(self.pairs_table(), self.items(), self.ratings()), "profiles"))

    def user_tag_table(self) -> DataFrame:
        return self._get("user_tag_t", lambda: materialize(
            self.spark, S.user_tag_strengths(self.pairs_table(), self.items(), self.profiles_table()),
            "user_tag"))

    # E-3
    def vectors(self) -> DataFrame:
        return self._get("vectors", lambda: K.knn_vectors(self.user_tag_table()))

    def peers(self) -> DataFrame:
        def build():
            v = materialize(self.spark, self.vectors(), "vectors")
            return materialize(self.spark, K.nearest_peers(v, cfg=self.settings.knn), "peers")
        return self._get("peers", build)

    # E-2
    def peer_benchmark(self) -> DataFrame:
        return self._get("bench", lambda: B.peer_benchmark(self.pairs_table(), self.items_table(), self.peers()))

    # E-4
    def context(self) -> DataFrame:
        return self._get("ctx", lambda: R.user_context(self.user_tag_table(), self.profiles_table(),
                                                        self.pairs_table()))

    def pool(self) -> DataFrame:
        return self._get("pool", lambda: R.collaborative_candidates(
            self.peers(), self.pairs_table(), self.items_table(), self.settings.recommend.limit))

    def features(self) -> DataFrame:
        return self._get("features", lambda: R.candidate_features(self.pool(), self.context()))

    def peer_strength(self) -> DataFrame:
        return self._get("peer_strength", lambda: R.weighted_peer_strength(self.peers(), self.user_tag_table()))

    def recommendations(self) -> DataFrame:
        return self._get("recs", lambda: R.prioritise(self.features(), self.peer_strength(), self.settings.recommend))

    def tag_impact(self) -> DataFrame:
        return self._get("impact", lambda: R.counterfactual_impact(self.features(), self.context(),
                                                                   self.settings.recommend))

    # M-1 / M-2 / M-20
    def success_frame(self) -> DataFrame:
        return self._get("success_frame", lambda: materialize(self.spark, FE.success_frame(
            self.pairs_table(), self.items(), self.user_tag_table(), self.profiles_table()), "success_frame"))

    def attempts_frame(self) -> DataFrame:
        return self._get("attempts_frame", lambda: FE.attempts_frame(self.success_frame()))

    def growth_frame(self) -> DataFrame:
        return self._get("growth_frame", lambda: FE.growth_frame(self.profiles_table(), self.user_tag_table()))

    def loo_user_metrics(self) -> DataFrame:
        return self._get("loo_user", lambda: EV.loo_user_metrics(self.peers(), self.user_tag_table()))


def skill_table_build(inp: Inputs) -> tuple[DataFrame, DataFrame]:
    """E-1: returns (user_tag, enriched_profiles)."""
    ut = inp.user_tag()
    return ut, S.enriched_profiles(inp.profiles(), ut)
