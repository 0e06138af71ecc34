import pytest

from flowsieve.llm.queries import QUERIES


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    """A given table as pandas, the ground of the brute-force versions."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()


@pytest.fixture(scope="session")
def result(spark, sf_dir):
    """A query's whole result as pandas, computed once."""
    done = {}

    def get(name):
        if name not in done:
            done[name] = QUERIES[name](spark, sf_dir).toPandas()
        return done[name]

    return get
