import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, lang, source) tuples, with further columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        from riskloom.llm.common import ship

        ship(spark)
        full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("shard", "slot", "score", "size", "html", "digest", "lang_pred", "key", "class"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def mixed_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), "en", f"src{i % 4}") for i in range(60)]
    rows += [(60, None, "en", "src0"), (61, "", None, "src1"), (62, "  \t\n", "de", None), (63, " ".join(words(rng, 30_000)), "en", "src2"), (None, "a null id", "en", "src3"), (64, "one", None, None)]
    rows += [rows[3], rows[3], (65, rows[3][1], "fr", "src1")]
    return rows
