import pytest
from sparloom.llm._common import release

ODD = "doc_id long, text string, lang string, n_words long, batch string, score double, _label int, _score double, _trusted int, _n int, secrets string, items string, _row string, class_id long, fp long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and wordless texts, a long one, repeated rows, and columns whose names clash with results and with inner names."""
    long = " ".join(f"word{i % 977} filler{i % 13}" for i in range(20_000))
    texts = [(1, None, None), (2, "", "en"), (3, "  \n", ""), (4, "... !!", "en"), (5, long, "en"), (5, long, "en"), (None, "no id here at all", "en"), (7, "Éa ñ ß 😀 İ\0\1 x", "de")]
    return spark.createDataFrame([(i, t, x, 5, "x", 0.1, 9, 0.9, 1, 3, "mine", "mine", "mine", 4, 6) for i, t, x in texts], ODD)


@pytest.fixture(scope="module", autouse=True)
def staged_tables(spark):
    yield
    release(spark)
