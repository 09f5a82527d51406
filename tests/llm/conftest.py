import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, tokens string"

LONG = " ".join(f"word{k % 97}x{k}" for k in range(30_000))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "Hello world",
    "Hello  world\n",
    "Hello world",
    "one two three four five six seven eight nine ten eleven",
    "The cat sat on the mat. The cat sat on the mat. The cat sat on the mat again today.",
    "It's we'll don't <|endoftext|> tail <|startoftext|> Ünïcödé 日本語 ﬁ 𝒳",
    LONG,
    LONG,
]


def rows(texts=TEXTS, ids=None):
    ids = ids or range(len(texts))
    return [
        (i, t, ("en", "fr", None)[k % 3], ("s0", "s0", None, "s1")[k % 4], len(t or ""), "clash", "clash", "clash")
        for k, (i, t) in enumerate(zip(ids, texts))
    ]


@pytest.fixture(scope="session")
def stored_docs(spark, tmp_path_factory):
    """Writes documents with columns of clashing names and reads them back."""

    def make(texts=TEXTS, ids=None):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(rows(texts, ids), SCHEMA).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    found = [(k, int(k % 4 != 0), int(k % 7 == 0)) for k in range(60)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")
