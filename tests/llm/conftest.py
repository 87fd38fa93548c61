import pytest


@pytest.fixture
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns named like the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it"), (2, ""), (3, None), (4, "   \n\t "), (5, "x"), (5, "x"),
        (6, "The quick brown fox jumps over the lazy dog and runs away from it"), (None, "nobody owns this text but it is here all the same"), (7, "word " * 3000), (8, "a" * 3000), (-9, "Ünï çode 漢字 🙂 don't stop\r\nnow"), (10, "one two"),
    ]
    return spark.createDataFrame([(i, t, "u", "v", 1) for i, t in rows], "doc_id long, text string, u string, component_id string, kept int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
