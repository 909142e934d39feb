import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int, held_out boolean, node string, key string, row string, _row int, part string, token string, n string"


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None, 1.5, 7, True, "x", "y", "z", 3, "p", "t", "n")


LONG = "the quick brown fox jumps over a lazy dog. " * 4000 + "end"
EDGES = [
    document(None, "a text without an id, of some words, and more of them here"), document(1, None), document(2, ""), document(3, " \n\t "), document(4, "one"), document(5, "one"),
    document(6, LONG), document(7, LONG), document(7, LONG), document(8, "x" * 50_000), document(9, "a b c d e f g h i j k l", None, None), document(10, "A B C D E F G H I J K L", "de", None),
    document(11, "zażółć gęślą jaźń 中文 текст 😀▁mark  nbsp  two  blanks\n\nlines\r\n\x00nul"), document(12, None, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names operators use themselves."""
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(13)] + [(None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
