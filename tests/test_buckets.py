"""Rating buckets with a hot (user, item) pair against a plain walk of the listing."""

import datetime as dt
import random
from collections import Counter

import pytest

from peerskill.operators import ordered as O


def walk(rows):
    """(user, bucket) -> [solved, failed], one pair at a time, newest row first."""
    out = Counter()
    pairs = {}
    for u, item, rating, verdict, t, i in rows:
        pairs.setdefault((u, item), []).append((t, i, verdict, rating))
    for (u, _), own in pairs.items():
        timed = [(t, i) for t, i, v, _ in own if v == "OK" and t is not None]
        newest = max(timed, default=None)
        for t, i, v, rating in own:
            if rating > 0:
                bucket = int(rating / 100 + 0.5) * 100
                out[u, bucket, "s"] += v == "OK"
                out[u, bucket, "f"] += v != "OK" and (newest is None or (t is not None and (t, i) > newest))
    return out


@pytest.mark.parametrize("hot_ok", [0.0, 0.002, 0.3])
def test_hot_pair_equals_a_plain_walk(spark, hot_ok):
    rng = random.Random(int(hot_ok * 1000))
    rows, start = [], dt.datetime(2020, 1, 1)
    for i in range(6000):
        hot = rng.random() < 0.4
        u, item = (0, "I_0") if hot else (rng.randrange(40), f"I_{rng.randrange(9)}")
        t = None if rng.random() < 0.01 else start + dt.timedelta(minutes=rng.randrange(3000))
        ok = rng.random() < (hot_ok if (u, item) == (0, "I_0") else 0.3)
        rows.append((u, item, 0 if item == "I_3" else 850 + 100 * int(item[2:]), "OK" if ok else rng.choice(["WRONG_ANSWER", None]), t, i % 500))
    df = spark.createDataFrame(rows, "user_key long, item string, item_rating int, verdict string, submitted_at timestamp_ntz, attempt_id long").repartition(4)
    hot, cuts = O._time_ranges(df)
    assert hot and len(cuts) > 4
    got = {(r.user_key, r.bucket): (r.solved, r.failed) for r in O.rating_buckets(df).collect()}
    want = walk(rows)
    assert got == {(u, b): (want[u, b, "s"], want[u, b, "f"]) for u, b, _ in want}


def test_the_log_is_shuffled_once(spark):
    df = spark.range(5000).selectExpr(
        "id as user_key", "concat('I', id % 10) as item", "cast(800 + id % 900 as int) as item_rating", "if(id % 3 = 0, 'OK', null) as verdict",
        "cast(timestamp_seconds(id) as timestamp_ntz) as submitted_at", "id as attempt_id").repartition(3)
    plan = O.rating_buckets(df)._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan  # the log, then sums per user and bucket
