"""Documents with all that may go wrong, and the helpers of the tests."""

import random

ODD = [
    (1, ""),
    (2, None),
    (3, "   \t\n \x0b "),
    (4, "one"),
    (5, "one"),
    (None, "a row without an id but with some words in it"),
    (7, "naïve café ñandú Σίσυφος İstanbul ﬁ 日本語テキスト \U0001f600 x́  　"),
    (8, "<|endoftext|> a <|startoftext|>b </s> <s> <0x0A> ▁ it's we'LL 12³ --- !!!"),
    (9, "word " * 5_000),
    (10, "x" * 20_000),
    (10, "an id for two texts"),
    (11, "repeated row"),
    (11, "repeated row"),
    (12, "a\r\nb\rc\x00d\x1c e"),
]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(n))


def frame(spark, rows):
    """With columns that clash with the operators' own names."""
    schema = "doc_id long, text string, n_tokens string, score string, sheet int, value int, node int, kept int, d int, pos int, piece int"
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, 5, 6, 7) for r in rows], schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
