import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``,
    with columns whose names clash with those of results."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("size", "score", "fp", "kept", "k", "start", "n_words", "spans", "ids", "shard", "target", "h", "toxic"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


LONG = " ".join(f"word{i % 977} Éa{i % 13}" for i in range(60_000))
#: Null, empty, blank, tiny, very long, tied and repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, LONG), (7, "a b"), (7, "a b"), (None, "x y z"), (9, "!!! ??? 123"), (10, "中文 \U0001f600"), (11, "a\n\n\nb  c \n d")]


@pytest.fixture
def odd():
    return ODD
