"""Rows that every operator must bear: nulls, empty and long texts, ties and repeats."""

import random


def odd_rows(seed=1):
    random.seed(seed)
    words = ["alpha", "beta", "Gamma", "delta", "é", "日本", "x", "the", "of", "and"]
    line = " ".join(random.choice(words) for _ in range(40))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, line), (7, line), (8, line.upper()),
        (9, line + " tail"), (10, "head " + line), (11, "a" * 5000), (12, "ab " * 3000), (13, " ".join(random.choice(words) for _ in range(20000))),
        (14, "\x00 ퟿ end"), (15, line), (15, line), (None, line), (None, None),
    ]
    rows += [(100 + i, " ".join(random.choice(words) for _ in range(random.randrange(60)))) for i in range(60)]
    return rows
