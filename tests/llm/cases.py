"""Documents with all that operators must stand: nulls, empty and long texts, repeated rows, columns that clash."""

import random

WORDS = [f"{a}{b}{c}" for a in ("th", "on", "er", "re", "st") for b in ("a", "o", "i", "u") for c in ("nd", "ng", "t", "s", "l")]
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, shard int, score string, n_words int, copies string, "
    "node string, items string, tokens int, label string, fingerprint int, _text string"
)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS).capitalize() if draw.random() < 0.1 else draw.choice(WORDS) for _ in range(words))


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "x", 1, "y", "z", "i", 2, "l", 3, "t")


def edited(text: str, seed: int, changes: int) -> str:
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


BASE = prose(1, 120)
ROWS = [
    row(1, BASE),
    row(2, BASE),
    row(2, BASE),
    row(3, edited(BASE, 3, 2), "fr", "src2"),
    row(4, edited(BASE, 4, 60), "fr", "src2"),
    row(5, None),
    row(6, ""),
    row(7, " \n\t "),
    row(8, "one"),
    row(9, "ONE"),
    row(10, "two words", None, None),
    row(None, prose(11, 40)),
    row(12, prose(12, 30_000), "de", "src3"),
    row(13, "é " * 50 + "日本語 ñandú"),
    row(14, "12345 67890 !!! ???", "es", "src4"),
    row(15, "x" * 50_000),
    *[row(20 + i, prose(99, 50), "en", "src5") for i in range(25)],
    *[row(60 + i, edited(prose(98, 150), i, 3), "en", "src6") for i in range(25)],
    *[row(100 + i, prose(200 + i, 20 + 5 * i), ("en", "fr", "de", "es")[i % 4], f"src{i % 7}") for i in range(40)],
]


def documents(spark, rows=None, parts=3):
    return spark.createDataFrame(ROWS if rows is None else rows, COLUMNS).repartition(parts)
