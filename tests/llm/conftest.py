import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = "the of and river bridge water morning house letter bread stone winter garden window candle silver".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, wordless, odd and very long texts, repeats, and columns whose names clash."""
    rows = [
        (1, "plain text of a few words", "en"), (2, None, "en"), (3, "", None), (4, " \t\n\x0b\x0c\r ", "en"), (None, "a row without id", "en"), (None, None, None),
        (5, "plain text of a few words", "en"), (5, "plain text of a few words", "en"), (6, "<|endoftext|> in  a text <|endoftext|>", "fr"), (7, "\u00a0é漢😀\u0301 '’s  \n\n x", "de"),
        (8, prose(8, 30_000), "en"), (9, prose(8, 30_000) + " more", "en"), (10, "###$$$%%% &&& |||", "en"), (11, "one", "en"),
    ]
    rows = [(i, t, lang, "src", 0, "n", "k", 1, True) for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, shard string, kept int, fp boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
