import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed, n, syllables="the an er on ti re ou st".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows and ids, null, empty, spaced and very long texts, odd characters, and columns with clashing names."""
    texts = [None, "", " \n\t ", "one", "Two words", " a  b\tc\n\nd \r\n", "naïve straße 中文 \U0001f600 <|endoftext|> <s> don't  stop", "▁mark", "nul\0nul", "ﬁ é"]
    texts += [invented(i, 40) for i in range(6)] + [invented(2, 40)] * 5 + ["x" * 3000, " " * 700, "z" * 70000 + "\n" + invented(9, 20000)]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, invented(1, 40), None, None, None), (None, None, None, None, None), (3, "another text", "en", "s1", 3), (4, "Two words", "en", "s1", 3)]
    names = ["n", "form", "count", "link", "links", "row", "key", "copies", "slot", "spans", "common", "a", "b"]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df
