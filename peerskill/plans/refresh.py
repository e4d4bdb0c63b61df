"""The refresh job (E-5, E-8): chunks merged, skill tables rebuilt, models trained, evaluated and saved, as steps that survive a stop.

A step writes its output to a folder named after the fingerprint of what it depends on: its own parameters, the fingerprints of the steps
before it and, for the first one, names, sizes and times of the source files.  A finished step leaves a record in the job's ``done``
folder.  A run skips every step that has one, so a job that was stopped goes on where it was, and a job whose sources have not changed
does nothing; a changed source runs all that depends on it anew, beside the old output."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import TAGS
from ..operators import clean as C
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import models as M
from ..operators import ordered as O
from ..operators import skill as S
from ..session import path_exists
from ..sources import io as IO

FLAGS = ["is_ac", "is_wa", "is_tle", "is_mle"]
WIDE = ["handle", "problem_id", "problem_name", "problem_rating", *FLAGS, "submitted_at", *[f"tag_{t}" for t in TAGS]]


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of the files under ``path``; a folder that is not there has none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return "none"
    row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


@dataclass
class Job:
    """Steps under ``base``.  ``ran`` names the steps that this run has executed, ``notes`` what each finished step recorded."""

    spark: SparkSession
    base: str
    ran: list[str] = field(default_factory=list)
    notes: dict[str, dict] = field(default_factory=dict)

    def step(self, name: str, depends: list[str], run: Callable[[str], dict | None], **parameters) -> tuple[str, str]:
        """(folder, fingerprint) of the output of ``run(folder)``, which is called unless a finished one is there.  ``run`` overwrites what
        a stopped run of it may have left."""
        print_of = hashlib.sha256(json.dumps([name, depends, parameters], sort_keys=True).encode()).hexdigest()[:16]
        folder, record = f"{self.base}/{name}/{print_of}", f"{self.base}/done/{name}-{print_of}"
        if not path_exists(self.spark, f"{record}/_SUCCESS"):
            notes = run(folder) or {}
            rows = self.spark.createDataFrame([(json.dumps(notes, sort_keys=True),)], "notes string")
            rows.coalesce(1).write.mode("overwrite").json(record)
            self.ran.append(name)
        self.notes[name] = json.loads(self.spark.read.schema("notes string").json(record).first()["notes"])
        return folder, print_of

    def read(self, folder: str, table: str = "") -> DataFrame:
        return self.spark.read.parquet(f"{folder}/{table}" if table else folder)


def merge_chunks(spark: SparkSession, chunks: list[str], existing: str | None, observed: Observation | None = None) -> DataFrame:
    """E-5 / S-4 / P-13..P-15 / U-1 / W-5: an existing wide dataset (parquet) and the CSV chunks that can be read, as one: handles cleaned,
    the newest row kept per (handle, item, time), unrated rows dropped.  ``observed`` counts the rows and those without a handle."""
    rows = IO.read_attempts_csv(spark, chunks)
    if existing is not None and path_exists(spark, existing):
        old = spark.read.schema(IO.ATTEMPT_CSV_SCHEMA).parquet(existing)
        rows = old.select(*[F.col(c).cast(t.dataType) for c, t in zip(rows.columns, rows.schema)]).unionByName(rows)
    payload = [c for c in WIDE if c not in ("handle", "problem_id", "submitted_at")]
    order = [*FLAGS, *[c for c in payload if c not in FLAGS]]
    merged = C.clean_handles(rows, observed=observed).withColumn("attempt_id", F.lit(0))
    newest = O.dedup_newest(merged, ["handle", "problem_id", "submitted_at"], order)
    return C.drop_unrated(newest, "problem_rating").select(*WIDE)


def skill_tables(wide: DataFrame, ratings: DataFrame, put: Callable[[str, DataFrame], DataFrame]) -> None:
    """E-1 from a merged wide dataset and ratings (handle, cf_rating, cf_max_rating, ...): items, pairs, profiles, user_tag and enriched,
    each given to ``put``, which writes it and returns it as written."""
    rows = wide.select(F.col("handle").alias("user_key"), F.col("problem_id").alias("item"), F.col("problem_rating").cast("int").alias("item_rating"), *FLAGS,
                       F.timestamp_seconds("submitted_at").cast("timestamp_ntz").alias("submitted_at"), F.lit(0).cast("long").alias("attempt_id"),
                       C.tags_from_flags().alias("tags"))
    items = put("items", rows.groupBy("item").agg(F.max("item_rating").alias("item_rating"), F.max("tags").alias("tags")))
    pairs = put("pairs", S.per_item(C.decided(rows.drop("tags"))))
    profiles = put("profiles", S.derive_profiles(pairs, items, ratings.withColumnRenamed("handle", "user_key")))
    user_tag = put("user_tag", S.user_tag_strengths(pairs, items, profiles))
    put("enriched", S.enriched_profiles(profiles, user_tag))


_TARGETS = {
    "success": ("solve_score", M.fit_success, (-1.0, 1.0)), "attempts": ("attempts", M.fit_attempts, M.ATTEMPTS_CLIP_RANGE),
    "growth": ("growth", M.fit_growth, (0.0, float("inf"))),
}


def refresh(spark: SparkSession, base: str, chunks: list[str], existing: str | None, ratings: str, models: bool = True, iters: int | None = None) -> Job:
    """Merge, skill tables, three trainings with saved models, metrics.  ``ratings``: a parquet folder with a handle column.  The outputs
    are ``merged``, ``skill`` (five tables), ``frames``, ``model_<name>`` and ``metrics`` in ``job.notes['folders']``."""
    job, folders = Job(spark, base), {}

    def merge(folder: str) -> dict:
        seen = Observation()
        merge_chunks(spark, chunks, existing, seen).write.mode("overwrite").parquet(folder)
        return {k: int(v) for k, v in seen.get.items()}

    sources = [source_fingerprint(spark, p) for p in [*chunks, *([existing] if existing else [])]]
    folders["merged"], merged = job.step("merge", sources, merge, chunks=chunks, existing=existing)

    def skill(folder: str) -> None:
        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            return job.read(folder, name)

        skill_tables(job.read(folders["merged"]), spark.read.parquet(ratings), put)

    folders["skill"], skilled = job.step("skill", [merged, source_fingerprint(spark, ratings)], skill)
    job.notes["folders"] = folders
    if not models:
        return job

    def frames(folder: str) -> None:
        t = {n: job.read(folders["skill"], n) for n in ("items", "pairs", "profiles", "user_tag")}
        FE.success_frame(t["pairs"], t["items"], t["user_tag"], t["profiles"]).write.mode("overwrite").parquet(f"{folder}/success")
        FE.attempts_frame(job.read(folder, "success")).write.mode("overwrite").parquet(f"{folder}/attempts")
        FE.growth_frame(t["profiles"], t["user_tag"]).write.mode("overwrite").parquet(f"{folder}/growth")

    folders["frames"], framed = job.step("frames", [skilled], frames)
    trained = []
    for name, (_, fit, _) in _TARGETS.items():
        def train(folder: str, name=name, fit=fit) -> dict:
            model = fit(job.read(folders["frames"], name), iters)
            model.write().overwrite().save(folder)
            return {"trees": model.stages[-1].getNumTrees}

        folders[f"model_{name}"], own = job.step(f"model_{name}", [framed], train, iters=iters)
        trained.append(own)

    def metrics(folder: str) -> None:
        out = None
        for name, (label, _, (lo, hi)) in _TARGETS.items():
            scored = PipelineModel.load(folders[f"model_{name}"]).transform(job.read(folders["frames"], name).where("split = 'test'"))
            part = M.eval_table(scored, label, name, (lo, hi))
            out = part if out is None else out.unionByName(part)
        out.write.mode("overwrite").parquet(folder)

    folders["metrics"], _ = job.step("metrics", trained, metrics)
    return job
