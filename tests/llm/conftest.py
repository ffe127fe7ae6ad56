import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred2 string, spans2 string"
EN = "the cat sat on the mat and then it went away over the hill to find some more of the food that it likes best of all things "
DE = "der hund lief durch den wald und suchte nach einem knochen den er gestern unter dem alten baum vergraben hatte bevor es regnete "


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ties."""
    rows = [(i, EN + f"number {i} is here", "en", "s", 1, "x", "y") for i in range(10)] + [(20 + i, DE + f"nummer {i} ist da", "de", "s", 1, None, None) for i in range(10)]
    rows += [(40, None, None, None, None, None, None), (None, EN, None, "s", 1, "x", "y"), (41, "", "en", "s", 0, "x", "y"), (42, " \n\t ", "en", "s", 3, "x", "y"), (43, "12345 !!!", None, "s", 1, "x", "y"), (44, "ok", "en", "s", 2, "x", "y")]
    rows += [(45, EN * 3000, "en", "s", 1, "x", "y"), (46, "x" * 300_000, None, "s", 1, "x", "y"), (47, "a " * 50_000, None, "s", 1, "x", "y")]
    rows += [(48, DE + DE.upper(), "de", "s", 1, "x", "y")] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
