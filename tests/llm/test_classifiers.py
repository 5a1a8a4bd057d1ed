import random
import zlib

import numpy as np
import pytest

from nichegrid.llm import labelled, quality_model, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    docs, labels = [], []
    for i in range(1200):
        toxic, bad = i % 6 == 0, i % 7 == 0
        own = [word() for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["Vile!", "vilest", "scum", "scummy."]))
        if bad:
            own = [w + "***" for w in own]
        docs.append((i, " ".join(own), "en", "s"))
        if i % 3 != 1:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(5000, None, None, None), (5001, "", "en", "s"), (None, "some text", "en", "s"), docs[0], docs[0]]
    docs.append((5002, " ".join(word() for _ in range(50_000)), "en", "s"))
    labels += [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0), (99_999, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
    )


@pytest.mark.parametrize(
    "operator, truth, cutoff",
    [(toxicity, lambda i: int(i % 6 == 0), 0.5), (quality_model, lambda i: int(i % 7 != 0), 0.3)],
)
def test_held_out_accuracy(tables, operator, truth, cutoff):
    documents, labels, docs = tables
    got = operator.judge(documents, labels).collect()
    assert len(got) == len(docs) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == truth(r.doc_id) for r in unseen]) > 0.97
    again = {r.doc_id: r.score for r in operator.judge(documents.repartition(5), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)


@pytest.mark.parametrize("operator", [toxicity, quality_model])
def test_empty_tables(spark, tables, operator):
    documents, labels, _ = tables
    assert operator.judge(documents.limit(0), labels).isEmpty()
    scores = {r.score for r in operator.judge(documents, labels.limit(0)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_labels_of_the_held_out_fold_are_not_used(tables):
    documents, labels, _ = tables
    taken = labelled.sample(documents, labels, "toxic", 100).collect()
    assert 50 < len(taken) <= 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in taken)
    assert not {r.doc_id for r in taken} & {3, 4, None}


@pytest.mark.parametrize("frequent", [0, 5, 1024])
def test_neighbours_equal_brute_force(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(2)
    names = [f"t{i}".encode() for i in range(12)]
    rows = [(int(i), [names[j] for j in rng.integers(0, 12, rng.integers(0, 6))], int(rng.random() < 0.4)) for i in range(200)]
    index = toxicity.build(names, rng.uniform(1, 3, 12).tolist(), rows)

    vector_of = lambda own: index.vectors([b" ".join(own)])[0]

    def dense(vector):
        out = np.zeros(12)
        at, weight = index.unit(vector)
        out[at] = weight
        return out

    known = [(doc, dense(vector_of(own))) for doc, own, _ in rows if own]
    for _ in range(100):
        vector = vector_of([names[j] for j in rng.integers(0, 12, rng.integers(1, 7))])
        sims = sorted(((-round(float(dense(vector) @ v), 12), doc) for doc, v in known))
        expected = [(doc, -s) for s, doc in sims if s < 0][: toxicity.NEIGHBOURS]
        at, sim = index.nearest(vector)
        assert [int(index.ids[i]) for i in at] == [d for d, _ in expected]
        assert sim == pytest.approx([s for _, s in expected])


def test_toxicity_equals_brute_force(tables, monkeypatch):
    """Scores of the whole query: all terms and all examples, every cosine computed."""
    monkeypatch.setattr(toxicity, "FREQUENT", 40)
    documents, labels, docs = tables
    texts = [(d[1] or "") for d in docs]
    cut = [toxicity.terms(t.encode()) for t in texts]
    known = {}
    for r in labels.collect():
        known.setdefault(r.doc_id, set()).add(r.toxic)
    by_text = {}
    for (doc, *_), text in zip(docs, texts, strict=True):
        own = known.get(doc, set()) - {None}
        if doc is not None and len(own) == 1 and zlib.crc32(str(doc).encode()) % 5:
            by_text[text] = min(by_text.get(text, (doc, 2)), (doc, own.pop()))
    examples = sorted((doc, label, toxicity.terms(text.encode())) for text, (doc, label) in by_text.items())
    names = sorted({t for *_, own in examples for t in own})
    at = {t: i for i, t in enumerate(names)}
    often = np.zeros(len(names))
    for own in cut:
        for t in set(own) & at.keys():
            often[at[t]] += 1
    idf = np.log((1 + len(cut)) / (1 + often)) + 1
    label = np.array([x[1] for x in examples])
    holds = np.zeros((len(examples), len(names)), bool)
    for i, (*_, own) in enumerate(examples):
        holds[i, [at[t] for t in own]] = True
    a, b = holds[label == 1].sum(0), holds[label == 0].sum(0)
    toxic, other = label.sum(), (1 - label).sum()
    expected = (a + b) / len(label) * np.array([[toxic], [other]])
    chi = (((np.array([a, b]) - expected) ** 2 / expected).sum(0) * len(label) / (len(label) - a - b).clip(1e-9)).clip(0)
    scale = idf * (toxicity.FLOOR + (1 - toxicity.FLOOR) * chi**2 / (chi**2 + toxicity.SIGNIFICANT**2))

    def unit(own):
        out = np.zeros(len(names))
        for t in own:
            if t in at:
                out[at[t]] += scale[at[t]]
        return out / (np.linalg.norm(out) or 1)

    matrix = np.array([unit(own) for *_, own in examples])
    prior = (toxic + 0.5) / (len(label) + 1)

    def odds(vector, without=None):
        sim = np.round(matrix @ vector, 12)
        best = [i for i in np.lexsort((np.arange(len(sim)), -sim)) if sim[i] > 0 and i != without][: toxicity.NEIGHBOURS]
        share = (sim[best] @ label[best] + toxicity.PRIOR_WEIGHT * prior) / (sim[best].sum() + toxicity.PRIOR_WEIGHT)
        share = min(max(share, 1e-4), 1 - 1e-4)
        return np.log(share / (1 - share))

    slope, shift = labelled.curve(np.array([odds(v, i) for i, v in enumerate(matrix)]), label)
    got = sorted((str(r.doc_id), r.score) for r in toxicity.judge(documents, labels).collect())
    want = sorted((str(d[0]), 1 / (1 + np.exp(-slope * odds(unit(own)) - shift))) for d, own in zip(docs, cut, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-7)


def test_descent_reaches_the_hinge_optimum():
    """The dual solution's margins meet the optimality conditions of the hinge loss."""
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 6), [40 + (i % 2)]])) for i in range(60)]
    labels = np.array([i % 2 if rng.random() < 0.9 else 1 - i % 2 for i in range(60)])
    scale = np.ones(quality_model.SIZE)
    weights, bias = quality_model.descend(rows, labels, scale, cost=1.0, epochs=400)
    sign = np.where(labels == 1, 1, -1)
    upper = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    margin = sign * np.array([weights[r].sum() / np.sqrt(len(r)) + bias for r in rows])
    primal = 0.5 * (weights @ weights + bias**2) + (upper * np.maximum(0, 1 - margin)).sum()
    step = 1e-3 * rng.standard_normal((200, quality_model.SIZE))
    for s in step:  # no nearby weights are better
        w = weights + s
        m = sign * np.array([w[r].sum() / np.sqrt(len(r)) + bias for r in rows])
        assert 0.5 * (w @ w + bias**2) + (upper * np.maximum(0, 1 - m)).sum() >= primal - 1e-6


def test_evidence(tables):
    documents, labels, _ = tables
    index = toxicity.fit(documents, labels)
    got = {r.doc_id: r.neighbours for r in toxicity.evidence(documents, index).collect()}
    assert got[5001] == [] and got[6] and all(n.label == 1 for n in got[6])
