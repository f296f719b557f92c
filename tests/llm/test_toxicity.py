"""The Kneser-Ney models against counts in dictionaries."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np

from glossa.llm import toxicity

ORDER, D = 5, 0.75


def symbols(word):
    """A word as numbers, closed by 0, after four zeros."""
    out = []
    for c in word:
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        out += [ord(base) - 96] if "a" <= base <= "z" else [27 + ord(c) % 5, 27 + ord(c) // 5 % 5]
    return [0] * (ORDER - 1) + out + [0]


def grams(word):
    x = symbols(word)
    return [tuple(x[k : k + ORDER]) for k in range(len(x) - ORDER + 1)]


class Plain:
    """Interpolated Kneser-Ney: own counts on top, continuation counts of both classes below."""

    def __init__(self, toxic, ordinary):
        self.top = [Counter(g for w in words for g in grams(w)) for words in (ordinary, toxic)]
        self.kinds = {ORDER: set(self.top[0]) | set(self.top[1])}
        for n in range(ORDER - 1, 0, -1):
            self.kinds[n] = {g[1:] for g in self.kinds[n + 1]}

    def shared(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 32
        ahead = Counter(g[1:] for g in self.kinds[n + 1])
        own = {g: c for g, c in ahead.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return self.shared(gram[1:])
        return max(own.get(gram, 0) - D, 0) / total + D * len(own) / total * self.shared(gram[1:])

    def p(self, label, gram):
        own = {g: c for g, c in self.top[label].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return self.shared(gram[1:])
        return max(own.get(gram, 0) - D, 0) / total + D * len(own) / total * self.shared(gram[1:])


def code(gram):
    out = 0
    for s in gram:
        out = out << 5 | s
    return out


TOXIC = ["grok", "groks", "zlub", "дурак", "дурень", "the", "the", "笨蛋"]
ORDINARY = ["the", "then", "there", "grow", "ground", "club", "друг", "дуга", "été", "ete", "好蛋"]


def model():
    plain = Plain(TOXIC, ORDINARY)
    seen = sorted(plain.kinds[ORDER], key=code)
    counts = [np.array([plain.top[label][g] for g in seen], np.int64) for label in (1, 0)]
    return plain, seen, toxicity.ratios(np.array([code(g) for g in seen], np.int64), *counts)


def test_codes_are_symbols():
    words = ["grok", "дурак", "笨", "été", "a𝒳"]
    got, owner, count = toxicity.codes_of(words)
    assert [got[owner == k].tolist() for k in range(len(words))][:4] == [[code(g) for g in grams(w)] for w in words[:4]]
    assert count.tolist()[:4] == [len(grams(w)) for w in words[:4]]
    assert toxicity.codes_of([])[0].tolist() == []


def test_ratios_equal_plain_counts():
    plain, seen, got = model()
    assert got["codes"].tolist() == [code(g) for g in seen]
    for g, r in zip(seen, got["ratio"].tolist(), strict=True):
        assert math.isclose(r, math.log(plain.p(1, g) / plain.p(0, g)), abs_tol=1e-4)
    unseen = {c: b for c, b in zip(got["contexts"].tolist(), got["back"].tolist(), strict=True)}
    for context in {g[:-1] for g in seen}:
        free = next(s for s in range(32) if (*context, s) not in plain.kinds[ORDER])
        assert math.isclose(unseen[code(context)], math.log(plain.p(1, (*context, free)) / plain.p(0, (*context, free))), abs_tol=1e-4)


def test_distributions_sum_to_one():
    plain, seen, _ = model()
    for label in (0, 1):
        for context in sorted({g[:-1] for g in seen})[:40]:
            assert math.isclose(sum(plain.p(label, (*context, s)) for s in range(32)), 1, abs_tol=1e-9)


def test_figures_equal_plain_sums():
    plain, _, got = model()
    judge = toxicity.Judge(got)
    rng = random.Random(1)
    for text in ("grok the дурак", " ".join(rng.choice(TOXIC + ORDINARY + ["new", "новый"]) for _ in range(30)), "", None, "12 !"):
        words = toxicity.words_of(text)
        ratio = {w: sum(math.log(plain.p(1, g) / plain.p(0, g)) for g in grams(w)) for w in words}
        size = sum(len(grams(w)) for w in words)
        top = sorted((ratio[w] for w in words), reverse=True)
        want = [sum(ratio[w] for w in words) / size, top[0], sum(top[:3]) / 3] if words else [0, 0, 0]
        assert np.allclose(judge.figures([text])[0], want, atol=1e-3)


def test_one_class_gives_its_share():
    x = np.random.default_rng(0).standard_normal((20, 3))
    for y, want in ((np.ones(20, bool), 1.0), (np.zeros(20, bool), 0.0)):
        assert toxicity.fit(x, y)["flat"] == want


def test_other_scripts_are_told_apart(spark):
    words = "дом лес река поле море небо день ночь друг брат книга стол окно дверь рука нога".split()
    bad = "дурак дурень гадина сволочь".split()
    rng, rows, labels = random.Random(3), [], []
    for k in range(400):
        own = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            own[rng.randrange(30)] = rng.choice(bad)
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted = toxicity.learn(docs.filter("doc_id < 300"), labels)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs.filter("doc_id >= 300"), fitted).collect()}
    assert sum(got[k] == (k % 4 == 0) for k in got) >= 95
