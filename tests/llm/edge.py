"""Tables of odd rows that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, kept boolean, row string"
LONG = "lorem ipsum dolor " * 4000


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and extra columns named like results."""
    rows = [
        (1, None, None, None, None, "x", False, "r"),
        (2, "", "en", "a", 0, "x", False, "r"),
        (None, "the only words of a row without an id", "en", "a", 5, None, None, None),
        (3, LONG, "en", "a", len(LONG), "x", True, "r"),
        (4, "same text here and there", "en", "a", 24, "x", True, "r"),
        (4, "same text here and there", "en", "a", 24, "x", True, "r"),
        (4, "another text of the same id", "de", None, 27, "x", True, "r"),
        (5, "...  \n\t !!", "fr", "b", 10, "x", True, "r"),
        (6, "日本語 ▁ é x \U0001F600 end", None, "b", 14, "x", True, "r"),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
