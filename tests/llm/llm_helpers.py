"""Fixtures' texts and brute-force helpers."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


def corpus(seed: int = 3, groups: int = 4) -> list[tuple]:
    """Small documents: prose, near and exact copies, shared passages, junk, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(90)
    rows = []
    for g in range(groups):
        base = prose(rng.choice([20, 120, 400]))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    for _ in range(12):
        rows.append(" ".join(prose(rng.randint(5, 40)) + passage + prose(rng.randint(5, 40))))
    rows += [None, "", " \n\t ", "one", "ONE", "one two", "x" * 5000, "ab " * 3000, "A B\x0bC\x0cD   E", rows[0], rows[0], "# # $ %\n# # $ %\n\n# # $ %", "<|endoftext|> it's 'll   x"]
    rows.append(" ".join(prose(30_000)))
    return [(i * 7 + 1, t, "en", None if i % 9 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(rows)]
