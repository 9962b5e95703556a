"""Word shingles of a text."""

from __future__ import annotations

#: Seed of all hashes of shingles.
SEED = 42


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of words of the text in ASCII lower case, repeats included."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return [b" ".join(run) for run in zip(*(found[k:] for k in range(words)))]
