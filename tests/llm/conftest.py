import pytest

from gridseries.llm.batches import ship_code

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box up five dozen liquor jugs today "


@pytest.fixture(scope="module")
def hard(spark):
    """Rows that hurt: nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    ship_code(spark)
    long = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000))
    edited = long.replace("word5x", "WORD6x")
    texts = [
        (1, PROSE * 3),
        (2, PROSE * 3),
        (3, PROSE.replace(" ", "\n") * 3),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "one"),
        (8, "One"),
        (9, "one two"),
        (10, long),
        (11, edited),
        (12, long),
        (13, "x" * 700),
        (14, "ab" * 300),
        (15, "Ünïcödé ÉCOLE 中文 a b <|endoftext|> tail"),
        (16, "don't  stop\n \nnow 12 345,6 😀 x"),
        (None, PROSE * 3),
        (None, None),
        (17, "1234 5678 ...!"),
        (18, "one two three four five six seven eight nine ten"),
        (7, "one"),
        (7, "one"),
    ]
    rows = [(i, t, "en" if k % 3 else None, k, k, "k", None) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, id long, key int, _norm string, `odd.name` string"
    return spark.createDataFrame(rows, schema).withColumnsRenamed({})


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


@pytest.fixture(scope="module")
def rows(hard):
    return [(r["doc_id"], r["text"]) for r in hard.collect()]


@pytest.fixture(scope="module")
def documents(spark, sf):
    ship_code(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")
