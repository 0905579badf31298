"""Small texts with the awkward cases that every operator has to survive."""

import random

ODD = [None, "", " ", "\n\n\t", "a", "one two", "x" * 3000, "é" * 500, "日本語 テキスト　です", "\x1f\x85 odd spaces", "line\nline\nline\n" * 5]


def corpus(seed: int = 0, n: int = 60, words: int = 80) -> list[tuple[int | None, str | None]]:
    """Rows (doc_id, text) with exact and near copies, shared passages, repeats, nulls and ties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        own = [rng.choice(vocab) for _ in range(rng.randint(1, words))]
        kind = i % 6
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows:
            own = (rng.choice(rows)[1] or "").split(" ")
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind == 3:
            text = " ".join(own[:5]) + " " + passage + "\n" + " ".join(own[5:])
        elif kind == 4:
            text = " ".join(own[:4] * 12)
        else:
            text = " ".join(own)
        rows.append((i, text))
    rows += [(n + k, t) for k, t in enumerate(ODD)]
    rows += [rows[3], (5, rows[9][1]), (None, rows[3][1]), (None, None)]
    return rows
