"""Toxicity by the nearest labelled examples.

A text is a vector over all terms of the sampled examples: term counts times inverse document frequency
over all documents, brought to length one. Terms are words and, for inflected forms, the first four
bytes of longer words. So that cosines compare what bears on the label rather than the prose around
it, a term's weight is scaled by its evidence, from FLOOR for a term that says nothing to 1, which
rises with the chi-squared of the term against the label; no term and no example is left out.

The examples stand in blocks of alike ones. Postings give the cosines' part from rare terms for all
examples at once; for the frequent ones each block has the greatest weight of each term. Texts go
through the index in lots: all look at the block with the best bound first, then at every block whose
bound reaches the ``neighbours``-th best cosine found there. The neighbours are therefore exact, of equal
cosines the smaller doc_id. Their votes weigh by cosine against the prior, the examples' share of toxic
ones, and a logistic curve fitted to the examples' votes without themselves turns the vote into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm import labelled

CUTOFF = 0.5
NEIGHBOURS = 15
BLOCK = 128
#: texts that are searched together
LOT = 64
#: terms whose weights are held for every example; all others are in postings
FREQUENT = 1024
#: chi-squared of one degree of freedom at which a term has half of the full evidence
SIGNIFICANT = 50.0
#: evidence of a term that is as frequent among toxic examples as among others
FLOOR = 0.1
PRIOR_WEIGHT = 0.5
#: bytes of a longer word that stand for its forms
STEM = 4
_WORD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_WORD).split()


def stem(word: bytes) -> bytes:
    """The first bytes of a longer word and an asterisk, which no word holds; short words have none."""
    return word[:STEM] + b"*" if len(word) > STEM else b""


def terms(text: bytes | None) -> list[bytes]:
    """Words and their stems."""
    own = words(text)
    return own + [s for s in map(stem, own) if s]


@dataclass(frozen=True)
class Index:
    """Labelled examples as blocks of weights and as postings."""

    vocabulary: dict[bytes, int]
    stem_of: np.ndarray  # the stem's number for each word, -1 for none
    weight: np.ndarray  # of each term: inverse document frequency times evidence
    ids: np.ndarray  # doc_id of each example
    labels: np.ndarray
    column: np.ndarray  # of each term in ``blocks``, -1 for a rare one
    blocks: np.ndarray  # examples x frequent terms
    maxima: np.ndarray  # frequent terms x blocks of examples
    starts: np.ndarray  # where each term's postings begin; frequent terms have none
    holder: np.ndarray  # postings: the example
    held: np.ndarray  # postings: its weight
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def vectors(self, texts: Sequence[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the vocabulary's terms in each text, and their counts."""
        get, size = self.vocabulary.get, len(self.vocabulary)
        split = [words(t) for t in texts]
        flat = [w for own in split for w in own]
        number = np.array([get(w, -1) for w in flat], np.int64)
        stems = self.stem_of[number]  # the last one is for unknown words, which may have a known stem
        for i in np.flatnonzero(number < 0):
            stems[i] = get(stem(flat[i]), -1)
        row = np.repeat(np.arange(len(split)) * size, [len(own) for own in split])
        held, count = np.unique(
            np.concatenate([(row + number)[number >= 0], (row + stems)[stems >= 0]]), return_counts=True
        )
        ends = np.searchsorted(held, np.arange(len(split) + 1) * size)
        return [
            (held[a:b] - i * size, count[a:b].astype(float)) for i, (a, b) in enumerate(zip(ends, ends[1:]))
        ]

    def unit(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, count = vector
        weight = count * self.weight[at]
        length = math.sqrt(float(weight @ weight))
        return at, weight / length if length else weight

    def search(self, units: Sequence[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        """For each text the ``k`` examples (numbers) with the greatest positive cosines, and the cosines."""
        size, n = len(units), len(self.ids)
        if not size or not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * size
        at, weight = (np.concatenate([u[i] for u in units]) for i in (0, 1))
        row = np.repeat(np.arange(size), [len(u[0]) for u in units])
        column = self.column[at]
        frequent = column >= 0
        asked = np.zeros((size, self.blocks.shape[1]))
        asked[row[frequent], column[frequent]] = weight[frequent]

        # rare terms: all their postings
        at, weight, row = at[~frequent], weight[~frequent], row[~frequent]
        times = self.starts[at + 1] - self.starts[at]
        posting = np.repeat(self.starts[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        sim = np.bincount(
            np.repeat(row * n, times) + self.holder[posting],
            self.held[posting] * np.repeat(weight, times),
            minlength=size * n,
        ).astype(float).reshape(size, n)  # without any posting they are whole numbers

        # frequent terms: blocks whose bound reaches what the best block holds
        firsts = np.arange(0, n, BLOCK)
        bound = np.maximum.reduceat(sim, firsts, axis=1) + asked @ self.maxima
        visited = np.zeros(bound.shape, bool)

        def visit(block: int, rows: np.ndarray) -> None:
            if len(rows):
                part = slice(firsts[block], min(firsts[block] + BLOCK, n))
                sim[rows, part] += asked[rows] @ self.blocks[part].T
                visited[rows, block] = True

        best = bound.argmax(1)
        reached = np.zeros(size)
        for block in np.unique(best):
            rows = np.flatnonzero(best == block)
            visit(block, rows)
            part = sim[rows, firsts[block] : firsts[block] + BLOCK]
            if part.shape[1] >= k:
                reached[rows] = np.partition(part, part.shape[1] - k, axis=1)[:, -k]
        # rounding of the bound must not hide a tie
        wanted = (bound > 0) & (bound >= reached[:, None] - 1e-9)
        for block in range(len(firsts)):
            visit(block, np.flatnonzero(wanted[:, block] & ~visited[:, block]))
        sim = np.where(np.repeat(visited, BLOCK, axis=1)[:, :n], np.round(sim, 12), 0)

        least = np.partition(sim, n - k, axis=1)[:, n - k] if n > k else np.zeros(size)
        out = []
        for own, low in zip(sim, least, strict=True):
            found = np.flatnonzero((own >= low) & (own > 0))
            found = found[np.lexsort((self.ids[found], -own[found]))[:k]]
            out.append((found, own[found]))
        return out

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS):
        return self.search([self.unit(vector)], k)[0]

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        """Share of toxic neighbours, kept a little inside 0 and 1."""
        share = (sim @ self.labels[at] + PRIOR_WEIGHT * self.prior) / (sim.sum() + PRIOR_WEIGHT)
        return min(max(float(share), 1e-4), 1 - 1e-4)

    def lots(self, texts: Sequence[bytes]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """Neighbours of the texts, lot by lot."""
        for a in range(0, len(texts), LOT):
            yield self.search([self.unit(v) for v in self.vectors(texts[a : a + LOT])])

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        distinct = list(dict.fromkeys(texts))
        votes = np.array([self.vote(at, sim) for lot in self.lots(distinct) for at, sim in lot])
        score = labelled.logistic(self.slope * np.log(votes / (1 - votes)) + self.shift)
        known = dict(zip(distinct, score, strict=True))
        return np.array([known[t] for t in texts], np.float64)


def evidence_of(toxic: np.ndarray, other: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """FLOOR to 1 for terms that are in so many of the toxic and of the other examples."""
    if not all(sizes):
        return np.ones(len(toxic))
    a, b = toxic.astype(float), other.astype(float)
    c, d, n = sizes[0] - a, sizes[1] - b, sum(sizes)
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * sizes[0] * sizes[1], 1e-9)
    return FLOOR + (1 - FLOOR) * chi**2 / (chi**2 + SIGNIFICANT**2)


def build(vocabulary: Sequence[bytes], idf: Sequence[float], rows: Iterable[tuple[int, list[bytes], int]]) -> Index:
    """The index of sampled (doc_id, terms, label) rows, which are turned into numbers one by one."""
    names = {t: i for i, t in enumerate(vocabulary)}
    size, none = len(names), np.zeros(0)
    doc_ids, marks, held = [], [], []
    for doc, own, label in rows:
        count = Counter(names[t] for t in own if t in names)
        held.append((np.array(list(count), np.int64), np.array(list(count.values()), float)))
        doc_ids.append(doc)
        marks.append(label)
    ids, labels = np.array(doc_ids, np.int64), np.array(marks, float)
    holds = np.zeros((2, size), np.int64)
    for (at, _), label in zip(held, marks, strict=True):
        holds[label, at] += 1
    weight = np.asarray(idf, float) * evidence_of(holds[1], holds[0], (int(labels.sum()), int((1 - labels).sum())))

    often = np.argsort(-holds.sum(0), kind="stable")[:FREQUENT]
    column = np.full(size, -1)
    column[often] = np.arange(len(often))
    stem_of = np.array([names.get(stem(t), -1) if t[-1:] != b"*" else -1 for t in vocabulary] + [-1])
    bare = Index(names, stem_of, weight, none, none, column, none, none, none, none, none, 0.5)
    units = [bare.unit(vector) for vector in held]

    # alike examples share blocks, which keeps the maxima close to the weights
    def strongest(i: int) -> tuple:
        at, own = units[i]
        own = np.where(column[at] >= 0, own, 0)
        return (*column[at[np.argsort(-own, kind="stable")[:3]]].tolist(), math.inf, doc_ids[i])

    order = sorted(range(len(units)), key=strongest)
    units, ids, labels = [units[i] for i in order], ids[order], labels[order]
    blocks = np.zeros((len(units), len(often)))
    for i, (at, own) in enumerate(units):
        blocks[i, column[at[column[at] >= 0]]] = own[column[at] >= 0]
    maxima = np.maximum.reduceat(blocks, np.arange(0, len(units), BLOCK)).T if units else np.zeros((len(often), 0))

    at = np.concatenate([x for x, _ in units] or [none]).astype(np.int64)
    own = np.concatenate([x for _, x in units] or [none])
    holder = np.repeat(np.arange(len(units)), [len(x) for x, _ in units]).astype(np.int32)
    rare = column[at] < 0
    at, own, holder = at[rare], own[rare], holder[rare]
    by_term = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=size))])
    prior = float((labels.sum() + 0.5) / (len(labels) + 1))
    index = Index(
        names, stem_of, weight, ids, labels, column, blocks, np.ascontiguousarray(maxima),
        starts, holder[by_term], own[by_term], prior,
    )
    if not units:
        return index
    votes = np.zeros(len(units))
    for a in range(0, len(units), LOT):
        for i, (found, sim) in enumerate(index.search(units[a : a + LOT], NEIGHBOURS + 1), a):
            others = found != i
            votes[i] = index.vote(found[others][:NEIGHBOURS], sim[others][:NEIGHBOURS])
    slope, shift = labelled.curve(np.log(votes / (1 - votes)), labels)
    return replace(index, slope=slope, shift=shift)


def fit(documents: DataFrame, labels: DataFrame, rows: int = labelled.FITTED_ROWS) -> Index:
    """The index of the bounded sample; document frequencies are counted over all documents."""
    taken = labelled.sample(documents, labels, "toxic", rows)

    held = sorted((r["doc_id"], bytes(r["text"]), r["label"]) for r in taken.select("doc_id", "text", "label").collect())
    vocabulary = set()
    for _, text, _ in held:
        vocabulary.update(terms(text))
    chosen = frozenset(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                own = set(words(text))
                found.update(chosen & (own | set(map(stem, own))))
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array([None, *found], pa.binary()), "n": pa.array([total, *found.values()], pa.int64())}
        )

    often = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(frequencies, "term binary, n long")
    often = often.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = dict(zip(often["term"].to_pylist(), often["n"].to_pylist(), strict=True))
    vocabulary = sorted(vocabulary)
    idf = [math.log((1 + (seen.get(None) or 0)) / (1 + seen.get(t, 0))) + 1 for t in vocabulary]
    return build(vocabulary, idf, ((doc, terms(text), label) for doc, text, label in held))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least CUTOFF) for every row.

    A text without a term of the vocabulary, empty and null ones too, has no neighbours and gets the
    score of the prior; without labels every text does. Ids of labelled rows are whole numbers.
    """
    index = fit(documents, labels)
    return labelled.scored(documents, index.scores, CUTOFF)


def evidence(documents: DataFrame, index: Index) -> DataFrame:
    """doc_id and its nearest examples: an array of (doc_id, cosine, label), nearest first."""

    @F.arrow_udf("array<struct<doc_id: bigint, cosine: double, label: int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            out = [
                [
                    {"doc_id": int(index.ids[i]), "cosine": float(s), "label": int(index.labels[i])}
                    for i, s in zip(at, sim, strict=True)
                ]
                for lot in index.lots(batch.to_pylist())
                for at, sim in lot
            ]
            yield pa.array(out, kind)

    return documents.select("doc_id", run(F.col("text").cast("binary")).alias("neighbours"))
