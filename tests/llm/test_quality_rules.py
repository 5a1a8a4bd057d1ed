import math

import pytest

from nichegrid.llm import quality_rules as q


def test_counts_of_a_text():
    text = "A b c\n\n a#b  c\nA b c\n \nA b c d".encode()
    n, chars, symbols, dup, repeat, lines, upper = q.text_features(text)
    assert (n, lines, dup, symbols, upper) == (12, 4, 1, 1, 3)
    assert chars == len("Abca#bcAbcAbcd")
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert repeat == len(hit)
    assert q.text_features(None) == (0,) * 7 and q.text_features(b"") == (0,) * 7
    assert q.text_features("é ü x".encode())[:2] == (2, 4)  # other spaces are no gaps


def test_certified_cuts_keep_the_risk():
    assert q.certified([0, 0, 0], 1000, 0.01, 0.01) == 3  # 0.99 ** 1000 is far below
    assert q.certified([0, 3, 0], 1000, 0.01, 0.003) == 1  # stops at the first that is not
    assert q.certified([0], 100, 0.01, 0.01) == 0 and q.certified([], 0, 0.01, 0.01) == 0
    assert q._tail(2, 10, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))


def corpus(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"wo#d{i}" for i in range(60))
    rows = [(i, good, "en") for i in range(3000)] + [(5000 + i, bad, "en") for i in range(200)]
    rows += [(9000 + i, bad, "xx") for i in range(20)] + [(9500, None, None), (9501, "few words", "en"), (None, good, "en")]
    labels = [(i, 1, 0) for i in range(3000)] + [(5000 + i, 0, 0) for i in range(100)] + [(9000, 0, 0), (77_777, 1, 1)]
    labels += [(None, 1, 1), (5150, 1, 0), (5150, 0, 0), (5151, None, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_rejects_what_the_labels_certify(spark):
    documents, labels = corpus(spark)
    got = {r.doc_id: r for r in q.judge(documents, labels).collect()}
    assert len(got) == documents.count()
    assert got[1].kept and got[None].kept
    assert not got[5199].kept and not got[5199].base_failed and got[5199].cut_symbols == 150
    assert got[9000].kept  # a stratum without enough labels rejects nothing
    assert got[9500].base_failed and got[9501].base_failed and not got[9501].kept
    kept = q.keep(documents, labels)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_without_labels_and_empty(spark, documents, nothing, pairs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.judge(documents, labels).collect()
    assert len(got) == len(pairs) and all(r.kept != r.base_failed for r in got)
    assert q.judge(nothing, labels).isEmpty() and q.keep(nothing, labels).columns == nothing.columns
