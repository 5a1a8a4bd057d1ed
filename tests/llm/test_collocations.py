import random
import re
from collections import Counter

import numpy as np
import pytest

from nichegrid.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, most):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang if lang is not None else "und"] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, own in f.items():
        phrases = {p: c for p, c in own.items() if len(p) > 1 and c >= support}
        gone = set()
        for p, c in phrases.items():
            if len(p) == 3:
                gone |= {q for q in (p[:2], p[1:]) if 100 * c >= 50 * phrases[q]}
        scored = []
        for p, a in phrases.items():
            if p not in gone:
                score, _, left, right = min(
                    (10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))
                )
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def sample():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(30)] + ["The", "the", "Été", "été", "x" * 300, "\U0001f600"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(("new york city", "New York", "red  \thot chili", "aa aa aa", *words, *words))
            text += rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "?! ", " "))
        rows.append((text, rng.choice(("en", "en", "fr", None))))
    rows += [(None, "en"), ("", None), (" .,", "fr"), ("one", "tiny")]
    rows.append((" ".join(rng.choice(words) for _ in range(30_000)), "en"))
    return rows + rows[:20]


@pytest.mark.parametrize("support, most", [(10, 2000), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, support, most):
    rows = sample()
    schema = "doc_id long, text string, lang string, phrase string, c int, size int"
    df = spark.createDataFrame([(i if i % 50 else None, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], schema)
    got = collocations.ranked(df.repartition(4), most, support).collect()
    assert sorted(map(tuple, got)) == brute(rows, support, most)
    assert len(got) > 20


def test_small_lots_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    for name, value in (("LOT", 500), ("BYTES", 1000), ("HELD", 50), ("FILTER_BITS", 1 << 10)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.ranked(df).collect())) == brute(rows, 10, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    counts = [("en", 2, "a b", big - 1), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 0, "", 2 * big)]
    table = spark.createDataFrame(counts, "lang string, size int, phrase string, c long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: table)
    (row,) = collocations.collocations(table).collect()
    assert row.score == 10**6 * (big - 1) ** 2 // big**2


def test_a_phrase_misses_every_shard_only_if_it_misses_the_support():
    words = collocations.Words([b"A b, c d e", None, b"  F\tg"], np.zeros(3, np.uint64))
    at, keys = words.phrases(2)
    assert words.spelt(at, 2) == [b"a b", b"c d", b"d e", b"f g"] and len(set(keys)) == 4
    assert words.text.tolist() == [0, 0, 0, 0, 0, 2, 2]


def test_empty_table(spark):
    assert collocations.ranked(spark.createDataFrame([], "doc_id long, text string, lang string")).isEmpty()
