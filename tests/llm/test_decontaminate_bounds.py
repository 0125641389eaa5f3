"""What is counted at once is bounded, and what is found does not depend on the bound."""

import random

import numpy as np
import pytest

from engram.llm import decontaminate
from engram.llm.decontaminate import Items, _hits, normalised


def run(texts, items):
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    b, point, at = normalised(np.frombuffer(raw, np.uint8), off)
    return sorted(_hits(b, point, at, items))


@pytest.mark.parametrize("most", [50, 3000])
def test_pairs_at_once_are_bounded(monkeypatch, most):
    rng = random.Random(most)
    words = ["alpha", "beta", "gamma", "delta", "aaaa", "abab", "über", "日本"]
    short = [" ".join(rng.choices(words, k=8)) for _ in range(60)]
    long = "ab" * 900 + " " + " ".join(rng.choices(words, k=60))
    items = Items([*range(61)], [t.encode() for t in [*short, long]], 0.06)
    edited = [t[:5] + "x" + t[6:] for t in short[:10]]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(5)] + ["ab" * 1500, long, "q " + long[40:] + " q", " . ".join(short[10:20]), " ".join(edited), "", "aaaa " * 400]
    want = run(texts, items)
    assert {(6, 60)} <= {x[:2] for x in want} and len(want) > 15
    sizes, banded, whole = [], decontaminate._banded, decontaminate._one_item
    alone = []
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", most)
    monkeypatch.setattr(decontaminate, "STRETCH", 500)
    monkeypatch.setattr(decontaminate, "_banded", lambda *a: (sizes.append(int(a[6].sum())), banded(*a)))
    monkeypatch.setattr(decontaminate, "_one_item", lambda *a: (alone.append(a[7]), whole(*a)))
    assert run(texts, items) == want
    assert max(sizes) <= most and 60 in alone
