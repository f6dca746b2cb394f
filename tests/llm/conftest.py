import pytest

from seamline.session import ship_package


@pytest.fixture(scope="session")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def make(shipped):
    """Documents from (doc_id, text) rows, with columns whose names the operators also use."""

    def docs(rows, extra=True):
        df = shipped.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "node", "token", "score", "ids", "n_lines", "slot", "label", "__x"):
                df = df.withColumn(name, F.lit("own"))
        return df

    return docs


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "one two three"),
    (None, None), (6, "word " * 30_000), (7, "x" * 200_000), (8, "a b c d e f g"), (9, "A B\tC d e\nf g"), (10, "naïve café 漢字 🎉 \x00 end"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
