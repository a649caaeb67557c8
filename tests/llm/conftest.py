import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Writes documents as a table, as every stage reads them. Rows: (doc_id, text) or (doc_id, text, source)."""
    made = 0

    def make(rows, extra=None):
        nonlocal made
        made += 1
        path = str(tmp_path_factory.mktemp("docs") / f"t{made}")
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "row", "_row", "norm", "digest", "n", "node", "size", "p", "chunk", "hash", "copies", "_copy", "score", "_score", "rid", "best", "toks", "component", "first", "_metadata", "taken", "whole"]
    return {n: F.lit(f"x {n}") for n in names}


@pytest.fixture(scope="session")
def odd_texts():
    """Cases that every operator must bear: null, empty, blanks, one word, very long, no letters, other scripts, copies."""
    return [None, "", " \t\n ", "word", "a b c d", "x" * 200_000, "one two three four five six " * 4000, "1234 5678 !!!", "日本語のテキスト 한국어 текст", "same text here again and again", "same text here again and again", "é" * 50 + "\x00\x7f", "<|endoftext|> and <|startoftext|>", "Ünïcödé ﬁ ǅ İ ς"]
