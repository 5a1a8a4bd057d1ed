import math
import zlib
from collections import Counter

import numpy as np
import pytest

from nichegrid.llm import lm


def brute(pairs):
    counts = Counter()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    for d, t in pairs:
        if not held(d):
            counts.update(cut(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in pairs:
        own = cut(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((d, held(d), len(own), sum(counts[w] > 0 for w in own), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent, modelled", [(1 << 17, None), (1 << 17, 100), (30, 100)])
def test_base_equals_brute_force(documents, pairs, monkeypatch, frequent, modelled):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    if modelled:  # so that most words are rest words
        monkeypatch.setattr(lm, "CLASSES", 10)
        monkeypatch.setattr(lm, "WIDTH", 10)
        monkeypatch.setattr(lm, "RESTS", 16)
    got = lm.judge(documents).collect()
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    expected = brute(pairs)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert [f[5] for f in found] == pytest.approx([e[5] for e in expected])
    assert all(r.score < 0 for r in got)


def test_model_is_one_distribution(documents):
    counts = lm.count(documents)
    weights = lm.fit(documents, counts)
    size = lm.CLASSES * lm.WIDTH
    ends = np.array([2])
    for before in (counts.end_symbol, 5, 40):
        total = 0.0
        for symbol in range(size):
            rows = lm.features(np.array([before, symbol]), ends, counts.end_symbol)[1:]
            total += 10 ** float(lm.log10_of(weights, rows, np.array([symbol]))[0])
        assert total == pytest.approx(1, abs=1e-3)


def test_context_helps(spark):
    rng = np.random.default_rng(1)
    follow = rng.permutation(40)
    rows = []
    for i in range(400):
        at, own = int(rng.integers(40)), []
        for _ in range(60):
            own.append(f"v{at}")
            at = int(follow[at]) if rng.random() < 0.8 else int(rng.integers(40))
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.judge(df).where("held_out").groupBy().sum("base_score", "score", "n_tokens").first()
    assert got["sum(score)"] > 0.8 * got["sum(base_score)"]


def test_empty_tables(spark, nothing):
    assert lm.judge(nothing).isEmpty()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.judge(spark.createDataFrame([(held, "a b", "x")], "doc_id long, text string, word string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_equal_counts_fill_the_model(spark):
    words = [f"w{i:04d}" for i in range(1500)]  # all equally frequent, more than the model holds
    texts = [" ".join(words)] * 12
    counts = lm.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    most = lm.CLASSES * lm.WIDTH - lm.RESTS - 1
    held = [w.decode() for w, i in counts.words.items() if counts.symbol[i] >= 0]
    assert sorted(held) == words[:most]
    symbols = [*counts.symbol[counts.symbol >= 0], *counts.rest_symbol, counts.end_symbol]
    assert sorted(symbols) == list(range(lm.CLASSES * lm.WIDTH))


def test_lots_do_not_change_the_chances(monkeypatch):
    rng = np.random.default_rng(5)
    weights = lm.Weights.zero()
    weights.of_class += rng.normal(size=weights.of_class.shape)
    weights.of_symbol += rng.normal(size=weights.of_symbol.shape)
    symbols = rng.integers(0, lm.CLASSES * lm.WIDTH, 1300)
    rows = lm.features(symbols, np.array([700, 1300]), 0)
    by_class, _, by_symbol = lm.predict(weights, rows, symbols)
    at = np.arange(1300)
    chance = by_class[at, symbols // lm.WIDTH].astype(float), by_symbol[at, symbols % lm.WIDTH].astype(float)
    for near in (1, 512, 5000):
        monkeypatch.setattr(lm, "NEAR", near)
        assert np.array_equal(lm.log10_of(weights, rows, symbols), np.log10(chance[0]) + np.log10(chance[1]))


def test_sums_are_those_of_reduceat():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([np.arange(1, 40), rng.integers(1, 4, 60), [700]])
    rng.shuffle(sizes)
    order, starts = rng.permutation(sizes.sum()), sizes.cumsum() - sizes
    gradient = rng.normal(size=(sizes.sum(), 32)).astype(np.float32)
    for own in (sizes, np.ones(50, int), np.full(30, 8), np.array([4096])):
        order, starts = rng.permutation(own.sum()), own.cumsum() - own
        gradient = rng.normal(size=(own.sum(), 32)).astype(np.float32)
        assert np.array_equal(lm._sums(gradient, order, starts, own), np.add.reduceat(gradient[order], starts, axis=0))


def test_words_are_found_by_lots(monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "éa", "Z", "y"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 400))) for _ in range(60)]
    texts = [None, b"", b" \t\n", *(t.encode() for t in texts), b"\x0bW1\x0c w2\r\n", None]
    known = [w.lower().encode() for w in vocabulary[:200]]
    symbol = rng.permutation(lm.CLASSES * lm.WIDTH)
    own = [int(symbol[i]) if i < 100 else -1 - lm.rest_of(w) for i, w in enumerate(known)]
    counts = lm.Counts(
        1, 1, 1, {w: i for i, w in enumerate(known)}, np.ones(200, int), np.array(own), symbol[100 : 100 + lm.RESTS],
        np.ones(lm.RESTS), int(symbol[-1]), None,
    )
    for cut, lot in ((1 << 18, 1 << 16), (100, 500), (3000, 1)):
        monkeypatch.setattr(lm, "CUT", cut)
        lots = list(lm.encoded(lm.Lookup(counts), texts, lot, words=True))
        at = 0
        for ends, place, symbols, rare in lots:
            last, want = at, []
            while last < len(texts) and len(want) < lot:
                want += [counts.words.get(w, -1) for w in lm.tokens(texts[last])] + [-2]
                assert rare[last - at] == [w for w in lm.tokens(texts[last]) if w not in counts.words]
                assert ends[last - at] == len(want)
                last += 1
            assert place.tolist() == want and len(ends) == len(rare) == last - at
            words = [w for t in texts[at:last] for w in (*lm.tokens(t), None)]
            rest = lambda w: int(counts.rest_symbol[lm.rest_of(w)])
            expected = [counts.end_symbol if w is None else own[i] if i >= 0 and own[i] >= 0 else rest(w) for w, i in zip(words, want, strict=True)]
            assert symbols.tolist() == expected
            at = last
        assert at == len(texts)


def test_chances_are_made_once_per_context(monkeypatch):
    rng = np.random.default_rng(6)
    weights = lm.Weights.zero()
    weights.of_class += rng.normal(size=weights.of_class.shape)
    weights.of_symbol += rng.normal(size=weights.of_symbol.shape)
    symbols = rng.integers(0, 6, 9000) * 170
    rows = lm.features(symbols, np.array([1000, 9000]), 5)
    by_class, _, by_symbol = lm.predict(weights, rows, symbols)
    at = np.arange(9000)
    chance = by_class[at, symbols // lm.WIDTH].astype(float), by_symbol[at, symbols % lm.WIDTH].astype(float)
    made, inner = [], lm._powers
    monkeypatch.setattr(lm, "_powers", lambda t, r, *more: (made.append(len(r)), inner(t, r, *more))[1])
    assert np.array_equal(lm.log10_of(weights, rows, symbols), np.log10(chance[0]) + np.log10(chance[1]))
    assert sum(made) <= 7 * 7 + 7 * 7 * 6
