"""A likeness of sentences in two languages that needs no model."""

from __future__ import annotations

import re

from corvelo.functions.text import unicodedata


def shared_marks(a: str, b: str) -> float:
    """Cosine over numbers, names and letter triples without accents; numbers and names weigh three times."""

    def marks(text: str) -> dict[str, float]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        found: dict[str, float] = {}
        for w in re.findall(r"\b(?:\d+|[A-Z]\w+)", plain)[0:]:
            found[f"={w}"] = 3.0
        low = re.sub(r"[^a-z0-9]+", " ", plain.lower())
        for k in range(len(low) - 2):
            found[low[k : k + 3]] = 1.0
        return found

    x, y = marks(a), marks(b)
    both = sum(v * y[k] for k, v in x.items() if k in y)
    size = sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5
    return both / size if size else 0.0
