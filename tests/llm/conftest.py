import pytest

LONG = " ".join(f"word{i % 7919}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every defined odd case, and extra columns of clashing names."""
    texts = [
        (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (7, "one two three four five six seven"),
        (None, "one two three four five six seven"), (None, None), (8, "short"), (8, "short"), (9, "ünï cödé 😀 text with five words"), (10, "short"),
    ]
    rows = [(i, t, None if i == 9 else "en", "src1", None if t is None else len(t), "x", "y", "z", 1.0, 7, 8, 9) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, label string, score double, row long, epoch long, tokens long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")
