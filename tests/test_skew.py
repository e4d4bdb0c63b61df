"""A hot user holding a third of all attempts: results equal a pandas brute force."""

import datetime as dt

import numpy as np
import pandas as pd

from peerskill.operators import ordered as O
from peerskill.operators import skill as S
from peerskill.sources import testdata as td


def test_hot_user_skill_table_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 3000
    users = np.where(rng.random(n) < 1 / 3, 7, rng.integers(100, 140, n))          # user 7 holds ~1/3
    items = rng.integers(0, 40, n)
    is_ac = (rng.random(n) < 0.5).astype(int)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 10_000, n)]
    rows = [(int(u), f"I_{k}", int(k), int(0 if k % 25 == 0 else 800 + 100 * (k % 28)), int(a), 1 - int(a), 0, 0, t, i)
            for i, (u, k, a, t) in enumerate(zip(users, items, is_ac, ts))]
    att = spark.createDataFrame(rows, "user_key long, item string, item_key int, item_rating int, is_ac tinyint, "
                                      "is_wa tinyint, is_tle tinyint, is_mle tinyint, submitted_at timestamp, "
                                      "attempt_id long").repartition(8)
    items_dim = td.items(att)
    got = S.user_tag_aggregate(S.per_item(att), items_dim).toPandas().set_index(["user_key", "tag"]).sort_index()

    pdf = pd.DataFrame(rows, columns=["user_key", "item", "item_key", "item_rating", "is_ac", "is_wa", "is_tle",
                                      "is_mle", "submitted_at", "attempt_id"])
    tags = {r.item: list(r.tags) for r in items_dim.collect()}
    pdf["tag"] = pdf["item"].map(tags)
    ex = pdf.explode("tag")
    exp = ex.groupby(["user_key", "tag"]).agg(total_attempts=("item", "size"), ac_count=("is_ac", "sum"),
                                             wa_count=("is_wa", "sum"),
                                             avg_rating_attempted=("item_rating", "mean")).sort_index()
    assert len(got) == len(exp)
    assert (got["total_attempts"].values == exp["total_attempts"].values).all()
    assert (got["ac_count"].values == exp["ac_count"].values).all()
    assert np.allclose(got["avg_rating_attempted"].values, exp["avg_rating_attempted"].values)

    # newest-first "failed before solve" flags for the hot user's items
    mk = O.solve_markers(att.withColumn("verdict", (att.is_ac == 1).cast("int"))
                         .selectExpr("*", "CASE WHEN is_ac = 1 THEN 'OK' ELSE 'WRONG_ANSWER' END AS v")
                         .drop("verdict").withColumnRenamed("v", "verdict")).toPandas()
    hot = pdf[pdf.user_key == 7].sort_values(["submitted_at", "attempt_id"], ascending=False)
    for item, g in hot.groupby("item"):
        solved_seen, failed = False, False
        for a in g["is_ac"]:                                # walk the newest-first listing
            if a == 1:
                solved_seen = True
            elif not solved_seen:
                failed = True
        row = mk[(mk.user_key == 7) & (mk.item == item)].iloc[0]
        assert bool(row["failed_before_solve"]) == failed
