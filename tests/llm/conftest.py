import pytest

# texts that every operator on documents must take
NASTY = [
    None,
    "",
    "   \t\n ",
    "one",
    "two words",
    "The same text, twice over, with enough words to make shingles of it all.",
    "The same text, twice over, with enough words to make shingles of it all.",
    "ÀÉÎ ünïcödé 日本語 😀   end line",
    "a" * 5000,
    ("long text word%d " * 400) % tuple(range(400)),
    "<|endoftext|> and </s>[INST] \\ <|turn|>",
    "x  y   z\n\n\n w \r\n",
]


@pytest.fixture
def nasty_texts():
    return NASTY


@pytest.fixture
def nasty(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0, "clash", 1.5, b"x") for i, t in enumerate(NASTY)]
    rows += [rows[5], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, fp binary").repartition(3)
