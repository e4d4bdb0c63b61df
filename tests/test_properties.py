"""Property checks with hypothesis on the column formulas."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerskill.functions import formulas as fx
from peerskill.operators import scoring as SC

unit = st.floats(min_value=-5, max_value=5, allow_nan=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(unit, unit, unit, unit, unit, unit), min_size=1, max_size=20))
def test_tag_strength_in_unit_interval(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    comps = dict(zip(["acceptance_rate", "difficulty_score", "rating_boost", "specialization_score",
                      "efficiency_score", "volume_score"], [F.col(c) for c in "abcdef"]))
    vals = [r[0] for r in df.select(fx.tag_strength(comps)).collect()]
    assert all(0.0 <= v <= 1.0 for v in vals)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-3000, 3000), st.floats(0, 1)), min_size=1, max_size=20))
def test_solve_score_in_range(spark, rows):
    df = spark.createDataFrame(rows, "d long, m double")
    vals = [r[0] for r in df.select(SC.sql_solve_score(F.col("d").cast("double"), F.col("m"))).collect()]
    assert all(-1.0 <= v <= 1.0 for v in vals)
