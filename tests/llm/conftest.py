import datetime as dt

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = "one two three four five six seven eight nine ten " * 3
    texts = ["", None, base, base, base + "eleven", "A b c", "a B C", "long " * 30_000, " \n\t ", "é ü ñ", base.upper()]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base, None, None, None), (None, None, None, None, None), (40, "A b c", "x", "y", 0)]
    clash = [("id", "long"), ("fp", "string"), ("digest", "string"), ("kept", "string"), ("rank", "int"), ("chunk", "date")]
    schema = T.StructType(T.StructType.fromDDL(DOCUMENTS).fields + T.StructType.fromDDL(", ".join(map(" ".join, clash))).fields)
    return spark.createDataFrame([(*r, 7, "f", "d", "k", 1, dt.date(2024, 1, 1)) for r in rows], schema)


@pytest.fixture(scope="module")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
