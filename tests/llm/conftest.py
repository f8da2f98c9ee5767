import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from rows and a schema, with extra columns whose names clash with inner ones."""

    def make(rows, schema, clash="cls string, n int, keys string, h string, u string, cell string, role string, block string, token string, path2 string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        for part in clash.split(","):
            name, kind = part.split()
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        return df

    return make
