import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, ties, repeats, odd characters.
ODD = [
    None,
    "",
    " \t\n",
    "a",
    "A",
    "Hello hello",
    "it's they'll 'twas we're ''s x'S 12 3a4b  ...!!  \n\n  end   x",
    "Ünïcödé straße ÀÉ – “quotes” 漢字かな交じり文 🙂🙂 é \x1c\x1f",
    "line one here\nline one here\n\n \nline two here\nline one here",
    "the same eight words come here once more again " * 12,
    "<|endoftext|> and <|startoftext|> are plain ¦ text",
    "x" * 9000,
    "\n".join(f"row {i} of a longer text with number {i * 7919 % 1000}" for i in range(900)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts twice over, a repeated row, a null id, and extra columns whose names operators might use."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD + ODD)]
    rows += [rows[7], (None, "no id here", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as kept", "'x' as name", "2 as pos", "3 as sha", "4 as rank", "5 as length")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a documents table and returns its folder."""

    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
