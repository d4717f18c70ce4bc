import pytest
from pyspark.sql import functions as F

from brute import SCHEMA, corpus  # isort: skip


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def wide(docs):
    """The same with extra columns whose names the operators use themselves."""
    names = "id size h row key n own shard slot path host source_size target copies kept root component word_chars p vote_repeats __h __w".split()
    return docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["broadcast", "salted"])
def joins(request, monkeypatch):
    from recapflow.llm import common

    if request.param == "salted":
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
    return request.param
