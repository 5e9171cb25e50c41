import pytest

SMALL, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=True):
        """Documents with columns whose names clash with those of the operators."""
        frame = spark.createDataFrame(
            [(i, t, "en", "s", 0, "x", True) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept boolean",
        )
        return frame if extra else frame.select("doc_id", "text", "lang", "source", "n_chars")

    return make


# Nulls, empty and very long texts, ties, repeated rows, letters that only A-Z rules leave alone.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t"),
    (4, "One two three four five six."),
    (5, "one TWO three four five six."),
    (5, "one TWO three four five six."),
    (5, "another text under the same id"),
    (6, "É é É"),
    (7, "é é é"),
    (8, "word " * 30_000),
    (9, "<|endoftext|> in the middle <|endo" + "ftext|>"),
    (10, "日本語のテキスト、空白なし。" * 500),
    (None, "no id here"),
    (None, "No id here"),
]
