import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts of awkward kinds: null, empty, blank, ties, repeats, odd white space, symbols.
ODD_TEXTS = [None, "", " \n\t ", "a", "a a", "a a a a", "x y z\nx y z\n\nx y z", "  not ascii spaces", "A\x0bB\x0cC\rD", "# * $ % & | < >", "word " * 60, "word " * 60, "der die das " * 3]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated rows, null ids and columns whose names clash with internal ones."""
    rows = [(i, t, f"s{i % 2}", "x", 1) for i, t in enumerate(ODD_TEXTS)] + [(3, "a", "s1", "x", 1), (None, "no id", None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, fp int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, digest string, fp int")
