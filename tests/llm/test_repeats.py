import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegrid.llm import repeats
from nichegrid.llm.tables import document_key


def brute(rows):
    """``rows``: (key, text) in the order of documents."""
    seen, out = set(), {}
    for key, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            if body[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(body[s : s + 100])
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(body)))
        left = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[key] = (len(body), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def passages():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, line = text(260), "a line of some eighty bytes that stands in most of the documents, word by word."
    rows = [(i, text(rng.randint(0, 400))) for i in range(20)]
    rows += [(30 + i, text(60) + shared + text(90) + line + text(40)) for i in range(12)]
    rows += [(50 + i, shared[30:180] + line + shared[:150]) for i in range(3)]
    rows += [(60, "ab" * 300), (61, "x" * 99), (62, "x" * 100), (63, "x" * 101), (64, "abc" * 43), (65, shared[:100])]
    return rows


@pytest.mark.parametrize("hot, shard, keys", [(20_000, 1 << 16, 500_000), (3, 1 << 16, 0), (20_000, 500, 0)])
def test_equals_brute_force(spark, pairs, monkeypatch, hot, shard, keys):
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", shard)
    rows = [r for r in pairs if r[1] is None or len(r[1]) < 5000] + [(1000 + d, t) for d, t in passages()]
    # ids that no float holds, beside a missing one in the same bucket
    shared = passages()[-1][1] + "z" * 210
    rows += [((1 << 60) + 1, shared), ((1 << 60) + 3, shared), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = df.select(document_key().alias("k"), "text").distinct().collect()
    order = sorted(((r.k.doc_id is not None, r.k.doc_id or 0, r.k.text), r.text) for r in keyed if r.text is not None)
    order += [((True, r.k.doc_id, r.k.text), None) for r in keyed if r.text is None]
    expected = brute(order)
    got = repeats.dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (r.doc.doc_id is not None, r.doc.doc_id or 0, r.doc.text)
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == expected[key]
    assert sum(r.n_removed for r in got) > 3000


def test_merging_equals_sorting_everything():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 400))).encode() for _ in range(30)]
    texts += [texts[0][:250] + b"z", b"q" + texts[0][20:300]]
    for letters in (repeats.alphabet(texts), np.arange(1, 257, dtype=np.uint16)):
        shards = [repeats.transform(t, letters)[2] for t in (texts[:10], texts[10:25], texts[25:])]
        _, block = repeats.merged(shards, repeats._step(letters))
        size = Counter(block.tolist())
        rotations = [(t + b"\0")[i:] + (t + b"\0")[:i] for t in texts for i in range(len(t) + 1)]
        first = Counter((r * (100 // len(r) + 1))[:100] for r in rotations)
        assert sorted(size.values()) == sorted(first.values())


def test_awkward_tables(spark, documents, nothing, pairs):
    assert repeats.judge(nothing).isEmpty()
    got = repeats.judge(documents)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and got.count() == len(pairs)


def test_no_task_holds_all_contexts_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 50)
    shared = "a passage that every document holds, word by word, and that is well over a hundred bytes long, so that it has windows of its own."
    rows = [(i, f"{i:05d} {shared}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    held = repeats._shared(df).where("hot").groupBy("anchor", F.spark_partition_id().alias("task")).count()
    most = held.groupBy("anchor").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()
    assert most and all(r.n >= 400 and 2 * r.most < r.n for r in most)


def test_merge_follows_only_windows_that_stay_shared(monkeypatch):
    rng = random.Random(8)
    text = lambda n, letters="abcd": "".join(rng.choice(letters) for _ in range(n)).encode()
    shared = text(130)
    texts = [text(50) + shared + text(20), shared[10:] + text(90), text(180), text(184), b"ab" * 80, b"ba" * 70, text(99)]
    texts += [text(80) + shared[:100], text(150, "a"), text(120, "a")]
    windows = [(t[p : p + 100], i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]
    held = Counter(w for w, _, _ in windows)
    expected = Counter((w, i, p) for w, i, p in windows if held[w] > 1)
    sizes = []
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, **k: (sizes.append(len(x)), cumsum(x, **k))[1])
    for shard in (1 << 16, 300):
        monkeypatch.setattr(repeats, "SHARD", shard)
        sizes.clear()
        number, place, block = (x.tolist() for x in repeats.intervals(texts))
        found = [texts[i][p : p + 100] for i, p in zip(number, place, strict=True)]
        assert Counter(zip(found, number, place, strict=True)) == expected
        assert len(set(zip(block, found, strict=True))) == len(set(block)) == len(set(found))
        rounds = sizes[-(100 // repeats._step(repeats.alphabet(texts))) :]
        assert max(rounds) <= len(windows) and rounds[-1] == len(found)


def test_texts_without_a_common_window_are_left_out():
    rng = random.Random(9)
    text = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    gram = text(16)
    anchor = repeats._grams(np.frombuffer(gram, np.uint8)).view(np.int64)[0]
    for before in (0, 1, 16, 17, 40, 67, 68, 84):  # where the anchor stands in the one common window
        window = text(before) + gram + text(84 - before)
        texts = [text(84 - before) + window + text(before), text(10) + window, text(84) + gram + text(84)]
        assert repeats._may_share(texts, np.full(3, anchor)).tolist() == [True, True, False]
        assert not repeats._may_share(texts[:2], np.array([anchor, anchor + 1]))[0]
    twice = [gram + text(60) + gram + text(60), text(84) + gram + text(84)]
    assert repeats._may_share(twice, np.full(2, anchor)).all()


def test_equal_texts_have_contexts_once(spark, monkeypatch):
    rng = random.Random(10)
    body = "".join(rng.choice("abcdef ") for _ in range(500))
    rows = [(i, body) for i in (7, 3, 5, 3)] + [(None, body), (9, body + "z"), (1, None), (2, "short")]
    seen = []
    inner = repeats._windows_of_different
    monkeypatch.setattr(repeats, "_windows_of_different", lambda d: (seen.extend(d.collect()), inner(d))[1])
    for keys in (500_000, 0):
        monkeypatch.setattr(repeats, "BROADCAST_KEYS", keys)
        seen.clear()
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {None: (0, 0), 3: (500, 1), 5: (500, 1), 7: (500, 1), 9: (500, 1), 1: (0, 0), 2: (0, 0)}
        assert [r.doc_id for r in seen if r.text == body] == [None]


def test_hot_contexts_are_cut_only_where_others_hold_most_of_them(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 40)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = "a line of under a hundred bytes in most documents, word by word.", text(260)
    # runs of one period; a line that makes no common window; a passage with its ends in different texts
    rows = [(i, text(rng.randint(90, 120)) + " Is onhe." * rng.randint(12, 40)) for i in range(60)]
    rows += [(100 + i, text(90) + line + text(90)) for i in range(200)]
    rows += [(400 + i, text(90) + passage[rng.randint(0, 30) :] + text(90)) for i in range(60)]
    rows += [(500 + i, passage[:150] + line + passage[i % 7 * 9 :] + line + line) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made, inner = [], repeats.stored

    def counted(part, name):
        part = inner(part, name)
        if name.startswith("hot-"):
            made.append(part.count())
        return part

    monkeypatch.setattr(repeats, "stored", counted)
    hot = repeats._shared(df).where("hot").count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.judge(df).collect()}
    assert got == brute(rows)
    assert hot > 400 and made and max(made) <= 8 * hot


def test_pieces_of_a_context_hold_no_window_twice():
    rng = random.Random(13)
    for body in (b"ab" * 120, b" Is onhe." * 30, b"x" * 200, bytes(rng.choice(b"ab") for _ in range(600))):
        for anchor, start, n in zip(*(x.tolist() for x in repeats.anchors(np.frombuffer(body, np.uint8))), strict=True):
            own = np.array(anchor, np.uint64).view(np.int64).item()
            context = body[start : start + n % repeats.TWICE + 99]
            found = repeats._pieces(context, own)
            places = [(p["skip"] + i, p["ahead"] - i) for p in found for i in range(p["windows"])]
            assert [w for w, _ in places] == list(range(len(context) - 99))
            for w, ahead in places:
                gram = context[w + ahead : w + ahead + 16]
                assert 0 <= ahead <= 84 and context[w : w + 100].find(gram) == ahead
            for p in found:
                windows = [context[p["skip"] + i :][:100] for i in range(p["windows"])]
                assert len(set(windows)) == len(windows)
    assert repeats._pieces(b"y" * 120, 1) == []


@pytest.mark.parametrize("width", repeats.LOTS)
def test_lots_are_the_windows_by_the_place_of_the_anchor(spark, width):
    rng = random.Random(14)
    pieces = []
    for i in range(40):
        ahead = rng.randint(0, 84)
        windows = rng.randint(1, ahead + 1)
        pieces.append((ahead, rng.randbytes(windows + 99), (i, 0, 1000 * i)))
    schema = "ahead int, context binary, place struct<doc_id: long, text: long, start: long>"
    got = repeats._in_lots(spark.createDataFrame(pieces, schema), width).collect()
    lots = Counter((r.place.doc_id, r.ahead // width) for r in got)
    assert set(lots.values()) == {1}
    held = [(r.place.doc_id, r.place.start + i, r.ahead - i, bytes(r.context[i : i + 100])) for r in got for i in range(len(r.context) - 99)]
    assert all((r.ahead - len(r.context) + 100) // width == r.ahead // width for r in got)
    expected = [(p[0], p[2] + i, a - i, c[i : i + 100]) for a, c, p in pieces for i in range(len(c) - 99)]
    assert sorted(held) == sorted(expected)
