"""Matching blocks against difflib."""

import difflib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.functions import blocks


def plain(a, b):
    """difflib's blocks, those that touch in both taken as one, in both lists."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]


def joined(found):
    out = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_as_difflib(a, b):
    assert joined(blocks.matching_blocks(a, b)) == [tuple(x) for x in plain(a, b)]


@pytest.mark.parametrize("kinds", [2, 12, 400])
def test_longer_sequences_as_difflib(kinds, monkeypatch):
    rng = random.Random(kinds)
    for short in (48, 0):
        monkeypatch.setattr(blocks, "SHORT", short)
        for n in (60, 300, 900):
            a = [rng.randrange(kinds) for _ in range(n)]
            b = [rng.randrange(kinds) for _ in range(n)]
            edited = a[: n // 3] + b[:20] + a[n // 2 :] + [rng.randrange(kinds) for _ in range(30)]
            for x in (b, edited, a, a[::-1], []):
                assert joined(blocks.matching_blocks(a, x)) == [tuple(y) for y in plain(a, x)]


def test_long_texts_take_no_second():
    rng = random.Random(1)
    common = [f"c{i}" for i in range(40)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(n)]
    a = words(20_000)
    edited = [w if rng.random() > 0.05 else f"e{rng.randrange(900)}" for w in a]
    other = words(20_000)
    blocks.matching_blocks(a[:500], other[:500])
    for b in (edited, other, ["the"] * 20_000, a):
        took = time.process_time()
        found = blocks.matching_blocks(a if b[0] != "the" else ["the"] * 20_000, b)
        took = time.process_time() - took
        assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(found, found[1:], strict=False))
        print(len(found), took)
        assert took < 5  # a second on a quiet machine
