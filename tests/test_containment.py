"""Quotes in texts against Python's own search, both ways of sending quotes."""

import random
from collections import Counter

import numpy as np
import pytest

from glossa.operators import containment


def pairs(texts, quotes):
    return Counter((i, q) for i, t in texts for _, q in quotes if t is not None and q is not None and q in t)


def got(spark, texts, quotes, small):
    a = spark.createDataFrame(texts, "id string, text string").repartition(3)
    b = spark.createDataFrame(quotes, "n int, quote string")
    return Counter((r.id, r.quote) for r in containment.containing(a, "id", "text", b, "quote", small_bytes=small).collect())


@pytest.mark.parametrize("small", [0, None])
def test_containing_is_substring_search(spark, small):
    rng = random.Random(4)
    letters = lambda n, of="ab": "".join(rng.choice(of) for _ in range(n))
    texts = [(f"t{k}", letters(rng.randint(0, 90), rng.choice(["ab", "é中a", "abcdefgh "]))) for k in range(120)]
    texts += [("null", None), ("empty", ""), ("t1", "the same id with another text"), texts[5], ("long", letters(4000, "abcd") + "needle" + letters(3000, "xyz") * 20)]
    quotes = [letters(n, of) for n in (1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 23, 24, 25) for of in ("ab", "é中a", "abcdefgh ")]
    for _, t in texts[:100]:
        if t:
            a = rng.randrange(len(t))
            quotes.append(t[a : a + rng.randint(1, 60)])
    quotes += ["", None, "needle", texts[-1][1][100:3000], texts[-1][1], texts[-1][1] + "x", "a" * 30, "aaaa", quotes[3]]
    listed = list(enumerate(quotes))
    assert got(spark, texts, listed, small) == pairs(texts, listed)


@pytest.mark.parametrize("small", [0, None])
def test_nothing_to_find(spark, small):
    assert not got(spark, [("a", "text")], [], small)
    assert not got(spark, [], [(1, "text")], small)
    assert not got(spark, [("a", None)], [(1, None), (2, "")], small)


@pytest.mark.parametrize("gram", [1, 2, 3, 5, 7, 8, 16])
def test_hashes_tell_grams(gram):
    data = np.random.default_rng(gram).integers(0, 3, 5000).astype(np.uint8)
    keys = containment.hashes(data, gram)
    told = {}
    for k in range(len(data) - gram + 1):
        assert told.setdefault(data[k : k + gram].tobytes(), keys[k]) == keys[k]
    assert len(set(told.values())) == len(told) and len(keys) == len(data) - gram + 1


def test_what_a_quote_shows_its_texts_show():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000).astype(np.uint8)
    keys = containment.hashes(text, containment.GRAM)
    shown = set(keys[containment.shown(keys, containment.WINDOW)].tolist())
    assert len(shown) < len(set(keys.tolist())) / 3
    for _ in range(300):
        n = int(rng.integers(containment.LONG, 200))
        at = int(rng.integers(0, len(text) - n))
        own = containment.hashes(text[at : at + n], containment.GRAM)
        own = own[containment.shown(own, containment.WINDOW)]
        assert len(own) and set(own.tolist()) <= shown


def test_texts_are_not_exchanged(spark):
    """Only stretches about the size of the quotes leave the texts."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quotes = [(k, prose(12)) for k in range(40)]
    texts = [(f"t{k}", prose(800) + (" " + quotes[k % 40][1] if k % 5 == 0 else "")) for k in range(400)]
    distinct = spark.createDataFrame([(bytes([k]), q.encode()) for k, q in quotes], "digest binary, quote binary")
    found = containment.anchors(distinct)
    kinds = [r.kind for r in found.select("kind").distinct().collect()]
    held = containment.bloom(found, len(quotes))
    sent = sum(containment.shape_of(kind)[2] * 2 * len(keys) for kind, _, keys, _ in containment.looked_at([t.encode() for _, t in texts], kinds, held))
    assert sent < 0.1 * sum(len(t) for _, t in texts)
    assert got(spark, texts, quotes, 0) == pairs(texts, quotes)
