import pytest


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text, lang, source) rows, with clashing extra columns."""
    def make(rows, **extra):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1]) if r[1] is not None else None,) for r in rows]
        df = spark.createDataFrame(full, schema)
        from pyspark.sql import functions as F
        for k, v in extra.items():
            df = df.withColumn(k, F.lit(v))
        return df
    return make
