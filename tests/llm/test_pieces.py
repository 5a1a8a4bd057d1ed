import os

import numpy as np
import pytest

from nichegrid.llm import pieces as p

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def toy():
    names = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "abc", "bc", "ca", "cab", "▁▁", "é"]
    scored = {n: (i, -float(7 * i % 11) - 0.5) for i, n in enumerate(names)}
    byte_ids = tuple(range(100, 356))
    table = [b""] * 356
    for n, (i, _) in scored.items():
        table[i] = n.replace("▁", " ").encode()
    for b in range(256):
        table[100 + b] = bytes([b])
    return p.Pieces(scored, byte_ids, tuple(table))


def brute(pieces, chars):
    n = len(chars)
    best = [(0.0, [])] + [None] * n
    for end in range(1, n + 1):
        for start in range(end):
            found = pieces.scored.get(chars[start:end])
            if found is None and end - start > 1:
                continue
            own = [found[0]] if found else [pieces.byte_ids[b] for b in chars[start:end].encode()]
            total = best[start][0] + (found[1] if found else pieces.unknown)
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + own)
    return best[n][1]


def ids(pieces, text):
    return np.frombuffer(next(p.encoder(pieces)([text.encode()])), "<i4").tolist()


@pytest.fixture(scope="module")
def vocabularies():
    return [toy(), *([p.load(MODEL)] if os.path.exists(MODEL) else [])]


def test_equals_brute_force_and_decodes(vocabularies):
    rng = np.random.default_rng(3)
    texts = ["a", " ", "  ab", "abcab cab", "x é日\n\t", "a" * 300, " " * 90, "abc" * 40 + " " + "cab" * 50]
    texts += ["".join(rng.choice(list("abc é\n"), rng.integers(1, 200))) for _ in range(60)]
    for vocabulary in vocabularies:
        for text in texts:
            got = ids(vocabulary, text)
            assert got == brute(vocabulary, "▁" + text.replace(" ", "▁"))
            assert p.decoder(vocabulary)(got) == text.encode()
        assert p.decoder(vocabulary)(ids(vocabulary, "a▁b ▁")) == "a▁b ▁".encode()  # a mark in the text itself


def test_window_is_bounded_and_lots_are_final():
    vocabulary = toy()
    chars = "▁" + "abcab" * 4000
    lots = list(p.stream(vocabulary, chars))
    assert len(lots) > 100 and max(map(len, lots)) < 100 * vocabulary.longest
    whole = np.frombuffer(b"".join(lots), "<i4").tolist()
    assert p.decoder(vocabulary)(whole) == chars.replace("▁", " ").encode()[1:]
    assert whole[:50] == brute(vocabulary, chars[:400])[:50]


def test_columns(spark, documents, nothing, pairs, vocabularies):
    for vocabulary in vocabularies:
        got = {(r.doc_id, r.n_ids): r for r in p.round_trip(documents, vocabulary).collect()}
        assert all(r.same for r in got.values() if r.ids is not None) and got[900, None].ids is None
        assert got[901, 0].ids == [] and len(got) >= len(set(pairs))
        out = p.verified(documents.withColumn("decoded", p.F.lit(1)), vocabulary)
        assert out.columns == [*documents.columns, "decoded", "ids"] and out.count() == len(pairs)
        assert p.round_trip(nothing, vocabulary).isEmpty()


def test_encoding_and_its_check_take_one_worker(spark):
    df = spark.createDataFrame([(1, "abc cab"), (2, ""), (3, None)], "doc_id long, text string")
    for out in (p.verified(df, toy()), p.round_trip(df, toy())):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert {r.doc_id: r.ids is None for r in out.collect()} == {1: False, 2: False, 3: True}


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).selectExpr("id as doc_id", "cast(unhex('61ff20e962') as string) as text")
    assert p.round_trip(df, toy()).first().same
