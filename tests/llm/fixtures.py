"""Awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _key string, n_words string, kept string, id string, taken string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        if i % 7 == 0 and texts:
            text = texts[rng.randrange(len(texts))]
        texts.append(text)
    texts += [None, "", " ", "a" * 5000, "a" * 5000, "ab " * 3000, "é" * 250, "!!! ???", "W1 w2\tW3\nw4", None]
    return [(i, t, None if i % 9 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", None, "z", "i", "t") for i, t in enumerate(texts)]


def with_repeats(rows):
    """Rows again, with their ids, and rows without an id."""
    return rows + rows[:5] + [(None, *rows[3][1:]), (None, *rows[6][1:])]
