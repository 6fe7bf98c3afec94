import pytest

#: Texts with the odd cases: null, empty, blank, very long, repeated, ties.
TEXTS = [None, "", "   \n ", "plain words here", "plain words here", "Ünïcödé 😀 text\nwith ▁ marks", "x" * 70_000, "one two three four five " * 9_000, "tail  of   spaces  "]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, repeated rows and extra columns of names that operators use."""
    rows = [(i, t, "en", None if i == 3 else f"src{i % 2}", i, "kept") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, "src0", None, None), (3, "plain words here", "en", None, 3, "kept"), (4, "plain words here", "en", "src0", 4, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, n_tokens string")
    for name in ("fp", "key", "shard", "row", "bucket", "component_id", "scores", "n_bytes", "h", "p_toxic", "kept_id", "root", "copies"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")
