import pytest

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
ROWS = [
    (0, None, "en"), (1, "", "en"), (2, " \n\t\r\n ", None), (None, "A null id has a text of some words, too.", "de"),
    (3, "the same text stands here twice, with words enough for a line", "en"),
    (3, "the same text stands here twice, with words enough for a line", "en"),
    (4, "the same text stands here twice, with words enough for a line", None), (5, LONG, "fr"),
    (6, "élan Ünïcode ß 漢字 😀 " * 5, "fr"), (7, "x", "x"), (8, "12345 67890 !!! ###", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    clashing = ["id", "v", "n", "n_lines", "n_dropped", "score", "kept", "spans", "key", "label", "component_id", "row"]
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 1), (8, None, 0), (3, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")
