"""Registry of checkable queries: name -> (DataFrame builder, oracle SQL).

Every builder takes ``(spark, sf_dir)`` and runs over the whole TESTDATA
tables of that folder.  Computed floating columns are rounded to 6 decimals
at this sink boundary only, on both sides (V-21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql_blocks as Q
from .jobs import Inputs

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(Inputs(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all():
    # importing the modules registers their queries
    from . import registry_core, registry_embed, registry_io, registry_eval, registry_extra, registry_models, registry_ordered, registry_peers, registry_records, registry_reports, registry_stream  # noqa: F401


def rounded_select(cols: list[str], dbl: list[str]) -> str:
    """SELECT list for the oracle side with the same 6-decimal rounding."""
    out = []
    for c in cols:
        out.append(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in dbl else c)
    return ", ".join(out)
