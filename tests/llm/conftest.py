import pandas as pd
import pytest

#: (doc_id, text, lang, source, n_chars) and columns whose names operators use inside.
MORE = "fp long, node string, bucket int, component_id string, key string, piece string, length int, score string, position long, ids string, base_spans string, kept string, _m int, at string, name string, n string, packed string, benchmark_hits string, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {MORE}"
N_MORE = len(MORE.split(", "))

LONG = " ".join(f"word{i % 997} of{i % 13}" for i in range(60_000))
EDGE_TEXTS = ["", None, " \n\t ", "one", "one two", "a" * 50_000, LONG, "é ü ß 漢字 🎉 x", "same words in both rows here", "same words in both rows here", "....", "\x00 zero \x1f byte"]


@pytest.fixture(scope="session")
def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Null and empty values, ties, repeated rows, very long texts; columns with names that operators use."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[3], rows[1], (None, "no number", None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *[None] * N_MORE) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
