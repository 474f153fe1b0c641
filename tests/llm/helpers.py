"""Small tables with the cases that operators must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, key string, copies int, row long, target double"


def words(rng: random.Random, n: int, pool: int = 4000) -> list[str]:
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def document_rows(seed: int = 1) -> list[tuple]:
    """Clean texts, exact and near copies, shared passages, a very long text, nulls, blanks, ties and repeated rows; extra columns with clashing names."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randrange(40, 200))) for _ in range(30)]
    base = words(rng, 300)
    for k in range(6):  # near copies
        other = list(base)
        for _ in range(k):
            other[rng.randrange(300)] = "changed"
        texts.append(" ".join(other))
    texts += [texts[0]] * 3 + ["\n".join(texts[1].split(" "))]  # exact copies, one with other white space
    passage = words(rng, 60)
    for _ in range(5):
        texts.append(" ".join(words(rng, 30) + passage[rng.randrange(10) :] + words(rng, 20)))
    texts.append(" ".join(words(rng, 9000)))  # very long
    texts.append("again and " * 60)  # repeats itself
    texts += [None, "", " \t\n", "one", "one", "two words", "Ünï çödé … 12½ don't!"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}", len(t or ""), "rid", "key", 7, 1, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "a text without an id " * 3, None, None, None, None, None, None, None, None))
    return rows
