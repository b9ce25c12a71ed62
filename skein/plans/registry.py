"""All registered queries and their DuckDB oracle text."""

from __future__ import annotations

import importlib

_MODULES = ["table_queries", "sketch_queries", "model_queries", "io_queries"]


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"skein.plans.{m}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def shipped(fn):
    """The query, with the package made importable on the executors first."""

    def run(spark, sf_dir):
        from skein.session import ensure_checkpoint_dir, ship_package

        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    return {k: shipped(v) for k, v in _load()[0].items()}


def oracle_sql():
    return _load()[1]
