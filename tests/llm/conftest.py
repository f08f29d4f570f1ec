import pytest

#: Every awkward case in one small table, with clashing and extra columns.
LONG = "Lorem " + "xy" * 4000 + " ipsum " + "wort " * 3000


@pytest.fixture(scope="session")
def awkward():
    base = [f"w{i} x{i % 7} the end of it" for i in range(12)]
    text = " ".join(base)
    near = text.replace("w11", "q11")
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, text), (6, text), (7, near), (8, LONG), (9, "Émile ß İ ὀΣ <|endoftext|> \x1c a b"),
        (10, text), (10, text), (11, "one"), (12, text + " " + " ".join(f"z{i}" for i in range(200))),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    rows = [(i, t, None if i % 3 else "en", "s", None if t is None else len(t), "extra", 1.5) for i, t in awkward]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
