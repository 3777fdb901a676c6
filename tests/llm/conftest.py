import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A folder for checkpoints, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture
def documents(shared):
    def make(rows):
        """Rows of (doc_id, text[, lang[, source]]), with extra columns whose names clash with results."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = shared.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("clash") for c in ("key", "id", "print", "score", "kept", "size", "shard", "host", "rule", "n", "words", "label", "bucket", "digest")})

    return make
