import random
import re

from nichegrid.llm import line_dedup


def alike(a, b, near):
    if a == b:
        return True
    if min(len(a), len(b)) < near or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def brute(pairs, near):
    seen, out = [], {}
    for doc, text in sorted(set(pairs), key=lambda r: (r[0] is not None, r[0] or 0)):
        left, n = [], 0
        for line in text.split("\n") if text is not None else []:
            own = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
            if own:
                n += 1
                known = any(alike(own, other, near) for other in seen)
                seen.append(own)
                if known:
                    continue
            left.append(line)
        kept = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in left)
        out[doc, text] = (None if text is None else "\n".join(left), n, n - kept)
    return sorted(((d, *out[d, t]) for d, t in pairs), key=str)


def edited():
    rng, base, out = random.Random(1), [*"abcdefghij"], []
    for k in range(40):
        lines = []
        for _ in range(3):
            own = base[: rng.randint(7, 10)]
            for _ in range(rng.randint(0, 2)):
                i, kind = rng.randrange(len(own)), rng.random()
                if kind < 0.3:
                    del own[i]
                else:
                    own[i : i + (kind > 0.6)] = rng.choice("abxy")
            lines.append(" " * rng.randint(0, 1) + (" " * rng.randint(1, 2)).join(own))
        out.append((10_000 + k, "\n".join([*lines, "", "one two"])))
    return out


def test_equals_brute_force(spark, pairs):
    rows = [r for r in pairs if r[1] is None or len(r[1]) < 5000] + edited()
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, doc string, n_lines int")
    got = line_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "doc", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert got == brute(rows, line_dedup.NEAR_WORDS)
    assert sum(r[3] for r in got) > 50


def test_rewrite_keeps_columns_and_drops_what_has_nothing_left(spark):
    rows = [(1, "a b\nc d", 7), (2, "a b", 3), (3, "a b\ne f", 7), (4, "", 0), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = line_dedup.rewrite(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a b\nc d", 7), (3, "e f", 3), (4, "", 0), (5, None, None)]


def test_long_and_empty(documents, nothing, pairs):
    assert line_dedup.dedup(nothing).isEmpty() and line_dedup.rewrite(nothing).columns == nothing.columns
    got = line_dedup.dedup(documents)
    assert got.count() == len(pairs) and set(documents.columns) < set(got.columns)


def test_plan_is_native(documents):
    plan = line_dedup.dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rewrite_carries_each_text_once(spark, monkeypatch):
    seen, inner = [], line_dedup.dedup
    monkeypatch.setattr(line_dedup, "dedup", lambda d, *more: (seen.append(d), inner(d, *more))[1])
    df = spark.createDataFrame([(1, "a b\nc", "en", 5), (2, "c\nd", "de", 3), (None, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    got = sorted(map(tuple, line_dedup.rewrite(df).collect()), key=str)
    assert got == sorted([(1, "a b\nc", "en", 5), (2, "d", "de", 1), (None, None, None, None)], key=str)
    assert seen[0].columns == ["row", "doc_id", "text"] and "text" not in seen[0].schema["row"].dataType.names
