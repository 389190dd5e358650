import pytest

# nulls, empty and blank texts, copies up to white space, near copies, ties, a repeated row, a long text
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds watch from the old wall near our house".split()
LONG = " ".join(f"{WORDS[i % 7]}{i // 3}" for i in range(30_000))
TEXTS = [
    (1, " ".join(WORDS * 4)),
    (2, "  ".join(WORDS * 4)),
    (3, " ".join(WORDS * 4)),
    (4, " ".join([f"w{i}" for i in range(80)])),
    (5, " ".join([f"w{i}" for i in range(79)] + ["other"])),
    (6, " ".join([f"W{i}" for i in range(80)]) + " end"),
    (7, ""),
    (8, None),
    (9, " \n\t "),
    (10, "one two"),
    (11, "ONE  two"),
    (12, LONG),
    (13, LONG + " x"),
    (14, "mail a.b@c-d.org or +1 (234) 567-8901, 4111 1111 1111 1111 at 10.0.0.255; 10.0.0.256"),
    (15, "line one here\nline one here\nother line\n\nline one here"),
    (16, "*** $$$ " * 40),
    (17, "<|endoftext|> naïve — 中文\u3000x\x1c 😀  end "),
]


@pytest.fixture(scope="session")
def small(spark):
    """Rows with a null id, a repeated row, and columns that clash with names of the operators."""
    rows = [(i, t, "en", None, 5, f"r{i}") for i, t in [*TEXTS, (None, "no id here"), (4, TEXTS[3][1])]]
    schema = "doc_id long, text string, lang string, source string, n_words int, rule string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(small):
    """The same without the repeated row and the row without id."""
    return small.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
