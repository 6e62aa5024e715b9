import pytest

ODD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "short", "de"), (None, "no id here but words enough for all of them", "fr"), (5, "x" * 70_000, "en"),
    (6, "ordinary words that stand in an ordinary line, nothing else", "en"), (6, "ordinary words that stand in an ordinary line, nothing else", "en"),
    (7, "Çé ǅ İI ΣΑΣ 漢字 🙂 don't we'll 12² \x00\x1c\x85\u200b end", None), (8, "many words " * 4000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names an operator uses itself."""
    rows = [(i, t, lang, None, None if t is None else len(t), "extra", 1, 2.0, "uid", [1]) for i, t, lang in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, score double, uid string, tokens array<int>"
    )


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
