"""Collects the named queries and their checking SQL."""

from functools import wraps

from lidarlake.session import ship_package

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that must agree with it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
