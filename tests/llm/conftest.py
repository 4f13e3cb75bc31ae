import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    def docs(rows, extra=False):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use inside must not clash
            from pyspark.sql import functions as F

            for c in ("fp", "h", "part", "rank", "raw", "id", "size", "digest", "seg", "val", "cluster", "copies", "target", "score"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return docs


ODD = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (5, "one", "b"), (6, "word " * 30000, "b"), (7, "Ünï çödé ﬁ Σ", None), (8, "a b c d e f", "c"), (8, "a b c d e f", "c")]
