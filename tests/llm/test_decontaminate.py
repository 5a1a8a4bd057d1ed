import hashlib
import re

from nichegrid.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lower)


def brute(pairs, items, window=10):
    wins = set()
    for item, text in items:
        w = cut(text)
        if w:
            wins |= {(item, tuple(w[i : i + window])) for i in range(max(len(w) - window + 1, 1))}
    out = []
    for doc, text in pairs:
        w, hit, found = cut(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc string, win string")


def test_equals_brute_force(spark, documents, pairs):
    long = pairs[30][1].split()
    rows = [
        (1, " ".join(long[5:30]), "x", "y"),
        (2, " ".join(long[100:112]).upper(), "x", "y"),
        (3, "short", "x", "y"),
        (12, "two, words!", "x", "y"),
        (4, "ab " * 15, "x", "y"),
        (5, None, None, None),
        (6, " .. ", "x", "y"),
        (7, "nowhere to be found in any of these texts at all ever", "x", "y"),
        (3, "short", "x", "y"),
        (8, "é ü", "x", "y"),
    ]
    expected = brute(pairs, [r[:2] for r in rows])
    items = items_of(spark, rows)
    got = sorted((tuple(r) for r in decontaminate.judge(documents, items).collect()), key=str)
    assert got == expected
    assert sum(r[5] for r in expected) > 5
    kept = decontaminate.clean(documents, items)
    assert kept.columns == documents.columns
    assert kept.count() == sum(not r[5] for r in expected)


def test_without_broadcast(spark, documents, pairs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    rows = [(1, " ".join(pairs[30][1].split()[5:30]), "x", "y")]
    got = sorted((tuple(r) for r in decontaminate.judge(documents, items_of(spark, rows)).collect()), key=str)
    assert got == brute(pairs, [r[:2] for r in rows])


def test_words_of_the_text_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    text = " ".join(f"w{i % 700}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, _key string")
    items = items_of(spark, [(7, " ".join(f"w{i}" for i in range(40, 60)), "", ""), (8, "w1 w2", "", "")])
    parts = decontaminate._shingles(decontaminate.windows_of(items).withColumnRenamed("item_id", "win_id"))
    plan = decontaminate.shingle_places(docs, parts)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Join Inner") :].split("Generate")[0]
    assert "ahead" in moved and "slice(w" in moved
    assert sorted(map(tuple, decontaminate.judge(docs, items).collect())) == brute([(1, text), (2, None)], [
        (7, " ".join(f"w{i}" for i in range(40, 60))), (8, "w1 w2")])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == ["doc_id", "text", "_key"] and [tuple(r) for r in kept.collect()] == [(2, None, "y")]


def test_plan_is_native(spark, documents):
    items = items_of(spark, [(1, "some words that are there", "x", "y")])
    plan = decontaminate.judge(documents, items)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_empty_tables(spark, documents, nothing, pairs):
    assert decontaminate.judge(nothing, items_of(spark, [(1, "a b", "", "")])).isEmpty()
    got = decontaminate.judge(documents, items_of(spark, [])).collect()
    assert len(got) == len(pairs) and not any(r.contaminated for r in got)
