"""Scoring texts with a hashed maximum-entropy language model beside a smoothed unigram base.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end. The base is
``(c + 1) / (N + V + 1)`` from the counts of the training documents.

The model predicts one of CLASSES * WIDTH symbols: the end, the most frequent words, and rest symbols
that hold all other words, dealt by their last two bytes. Symbols are ordered by frequency and cut into
classes; a softmax over classes and one over the symbols of a class give P(class) * P(symbol | class).
Logits are sums of weight rows for the previous symbol, the one before it (a skip feature) and the
pair, whose rows are hashed. A rest word has its share ``(c + 1) / (T + V + 1)`` of its rest symbol, from
the counts of all rest words of that symbol, so that the model is one distribution over all words.

Weights are fitted by distributed gradient updates. A round takes a part of the training documents;
every task runs minibatch descent from the weights of the round and reports, per row of weights, the
change and how many tokens caused it; changes are averaged with these numbers. Every training document is
in one round. Counts come from all training documents. The words that are broadcast are a bounded
number of the most frequent; counts of the others are joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm import wordhash
from nichegrid.llm.tables import fold, stored

FOLDS, HELD = 7, 2
CLASSES = WIDTH = 32
RESTS = 64
#: rows of weights: features of classes, hashed pairs among them, and hashed (feature, class) rows
PAIRS, ROWS = 1 << 12, 1 << 15
FEATURES = 2 * CLASSES * WIDTH + PAIRS
#: words whose counts are broadcast, some 100 bytes each; the rest is joined
FREQUENT = 1 << 17
ROUNDS = 3
BATCH, RATE = 4096, 0.3
#: tokens whose logits are made together, so that they stay in a core's cache
NEAR = 512
#: tokens that one update is given at most but for one long text, and those that are scored together
LOT, SCORED = 1 << 16, 1 << 18
#: sums of so many gradients at most are made for all rows at once
FEW = 8
#: bytes of texts that are cut into words together
CUT = 1 << 18
#: training tokens that one task takes at least where there are so many
TASK_TOKENS = 2_000_000
BLOCK = 1024
_BINS = 32  # of counts, for each doubling


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def rest_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RESTS


@dataclass(frozen=True)
class Counts:
    """What the training documents hold. ``words`` beyond the bound are in the table ``rare``."""

    n: int
    distinct: int
    documents: int
    words: dict[bytes, int]  # frequent word -> its place in the arrays
    count: np.ndarray
    symbol: np.ndarray  # of each frequent word
    rest_symbol: np.ndarray  # of each rest
    rest_size: np.ndarray  # T + V + 1 of each rest
    end_symbol: int
    rare: DataFrame


@dataclass
class Weights:
    of_class: np.ndarray  # FEATURES + 1 rows (the last is the bias) x CLASSES
    of_symbol: np.ndarray  # ROWS + CLASSES rows (the last ones are the biases) x WIDTH

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((FEATURES + 1, CLASSES), np.float32), np.zeros((ROWS + CLASSES, WIDTH), np.float32))


def count(documents: DataFrame) -> Counts:
    """Counts of the documents outside the held-out fold."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([None, *found], pa.binary()),  # null: the ends
                    "n": pa.array([batch.num_rows, *found.values()], pa.int64()),
                }
            )

    training = documents.where(fold("doc_id", FOLDS) != HELD)
    counted = (
        training.select(F.col("text").cast("binary").alias("text"))
        .mapInArrow(words, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("c"))
        .withColumn("bin", F.floor(F.log2("c") * _BINS).cast("int"))
    )
    counted = stored(counted, "word-counts")
    bins = counted.groupBy("bin").agg(
        F.count("word").alias("words"), F.count("*").alias("entries"), F.sum("c").alias("n")
    )
    bins = sorted(bins.collect(), key=lambda r: -r["bin"])
    n, distinct = sum(r["n"] for r in bins), sum(r["entries"] for r in bins)

    def lowest(most: int) -> int:
        """The lowest bin with at most ``most`` words from there up."""
        held, low = 0, bins[0]["bin"] + 1 if bins else 0
        for r in bins:
            held += r["words"]
            if held > most:
                break
            low = r["bin"]
        return low

    def filled(most: int) -> Column:
        """Whether a word is among the ``most`` most frequent; equal counts in the order of the words.

        Only the bin that crosses the bound is put in order.
        """
        low = lowest(most)
        left = most - sum(r["words"] for r in bins if r["bin"] >= low)
        crossing = max((r["bin"] for r in bins if r["bin"] < low and r["words"]), default=None)
        whole = F.col("bin") >= low
        if crossing is None or left <= 0:
            return whole
        taken = counted.where((F.col("bin") == crossing) & F.col("word").isNotNull())
        last = taken.orderBy(F.desc("c"), "word").limit(left).orderBy("c", F.desc("word")).first()
        c, word = F.lit(last["c"]), F.lit(bytes(last["word"]))
        in_part = (F.col("c") > c) | ((F.col("c") == c) & (F.col("word") <= word))
        return whole | ((F.col("bin") == crossing) & in_part)

    model = F.col("word").isNotNull() & filled(CLASSES * WIDTH - RESTS - 1)
    broadcast = F.col("word").isNotNull() & ((F.col("bin") >= lowest(FREQUENT)) | model)
    rest = F.crc32(F.expr("substring(word, -2, 2)")) % RESTS
    rests = (
        counted.where(~model & F.col("word").isNotNull())
        .groupBy(rest.alias("rest"))
        .agg(F.sum("c").alias("t"), F.count("*").alias("v"))
        .collect()
    )
    total, size = np.zeros(RESTS), np.ones(RESTS)
    for r in rests:
        total[r["rest"]], size[r["rest"]] = r["t"], r["t"] + r["v"] + 1
    known = counted.where(broadcast).withColumn("model", model).orderBy(F.desc("c"), "word")
    known = [(bytes(r["word"]), r["c"], r["model"]) for r in known.collect()]
    ends = counted.where("word is null").agg(F.sum("c")).first()[0] or 0

    # symbols by falling frequency: the end, the rests, and the words of the model
    modelled = [i for i, (_, _, own) in enumerate(known) if own]
    frequency = [(ends, -1, 0), *((t, -2, i) for i, t in enumerate(total)), *((known[i][1], 0, i) for i in modelled)]
    symbol, rest_symbol, end_symbol = np.full(len(known), -1), np.zeros(RESTS, np.int64), 0
    for place, (_, kind, i) in enumerate(sorted(frequency, key=lambda x: (-x[0], x[1], x[2]))):
        if kind == -1:
            end_symbol = place
        elif kind == -2:
            rest_symbol[i] = place
        else:
            symbol[i] = place
    for i, (word, _, _) in enumerate(known):
        if symbol[i] < 0:
            symbol[i] = -1 - rest_of(word)  # a word of a rest
    return Counts(
        n, distinct, ends, {w: i for i, (w, _, _) in enumerate(known)}, np.array([c for _, c, _ in known], np.int64),
        symbol, rest_symbol, size, end_symbol, counted.where(~broadcast & F.col("word").isNotNull()),
    )


def _plain(counts: Counts) -> Counts:
    """Without the table, for use in tasks."""
    return Counts(**{**counts.__dict__, "rare": None})


class Lookup:
    """The places of words among the frequent ones, for many words at a time, by their 64-bit hashes."""

    BITS = 20

    def __init__(self, counts: Counts):
        self.counts = counts
        hashes = wordhash.words(b" ".join(counts.words))
        self.place = np.argsort(hashes)
        self.hashes = hashes[self.place]
        slots = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.first = np.append(np.searchsorted(self.hashes, slots), len(hashes))
        # the rest that a word belongs to, by its last byte and by its last two
        rests, size = range(256), len(counts.rest_symbol)
        lower = [bytes([b]).lower() for b in rests]
        self.of_one = np.array([zlib.crc32(b) % size for b in lower])
        self.of_two = np.array([zlib.crc32(a + b) % size for a in lower for b in lower])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, past = self.first[slot], self.first[slot + 1]
        place = np.full(len(hashes), -1)
        left = np.flatnonzero(at < past)
        while len(left):
            own = at[left]
            hit = self.hashes[own] == hashes[left]
            place[left[hit]] = self.place[own[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < past[left]]
        return place

    def cut(self, texts: Sequence[bytes | None], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Number of tokens of each text, place of each token, symbols, and with ``words`` each text's rare words."""
        joined = b"\n".join(t or b"" for t in texts)
        raw = np.frombuffer(joined, np.uint8)
        begins, ends = wordhash.spans(raw)
        edges = np.array([len(t or b"") + 1 for t in texts]).cumsum()
        known = self.find(wordhash.words(joined))
        upto = np.searchsorted(begins, edges)  # words of the texts so far
        last = upto + np.arange(len(texts))  # where the ends are among the tokens
        is_word = np.ones(len(known) + len(texts), bool)
        is_word[last] = False
        place = np.full(len(is_word), -2)
        place[is_word] = known
        symbols = self.counts.symbol[place] if len(self.counts.symbol) else np.full(len(place), -1)
        late = np.flatnonzero(known < 0)
        final = raw[ends[late] - 1].astype(np.int64)
        two = ends[late] - begins[late] > 1
        rests = np.where(two, self.of_two[raw[ends[late] - 1 - two].astype(np.int64) << 8 | final], self.of_one[final])
        symbols[place == -1] = -1 - rests
        in_rest = symbols < 0
        symbols[in_rest] = self.counts.rest_symbol[-1 - symbols[in_rest]]
        symbols[last] = self.counts.end_symbol
        rare: list[list[bytes]] = [[] for _ in texts] if words else []
        if words:
            owner = np.searchsorted(upto, late, side="right")
            for i, a, b in zip(owner.tolist(), begins[late].tolist(), ends[late].tolist(), strict=True):
                rare[i].append(joined[a:b].lower())
        return np.diff(last, prepend=-1), place, symbols, rare


def encoded(
    lookup: Lookup, texts: Sequence[bytes | None], lot: int = LOT, words: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Lots of texts in order: ends of each text, place of each token, symbols, and with ``words`` the rare words.

    The place is that among the frequent words, -1 for a rare one and -2 for an end. A lot ends with the
    text that makes it ``lot`` tokens or more.
    """
    sizes, place, symbols, rare = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last] or b"") <= CUT):
            held += len(texts[last] or b"")
            last += 1
        more = lookup.cut(texts[first:last], words)
        sizes, place, symbols = (np.concatenate(x) for x in zip((sizes, place, symbols), more[:3], strict=True))
        rare += more[3]
        first = last
        while len(place) >= lot or (first == len(texts) and len(sizes)):
            ends = sizes.cumsum()
            n = min(int(np.searchsorted(ends, lot)) + 1, len(sizes))
            yield ends[:n], place[: ends[n - 1]], symbols[: ends[n - 1]], rare[:n]
            place, symbols = place[ends[n - 1] :], symbols[ends[n - 1] :]
            sizes, rare = sizes[n:], rare[n:]


def features(symbols: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """Rows of class weights for every token: previous symbol, the one before, the hashed pair."""
    before = np.concatenate([[start], symbols[:-1]])
    begins = np.concatenate([[0], ends[:-1]])
    before[begins] = start
    skip = np.concatenate([[start], before[:-1]])
    skip[begins] = start
    pair = ((before * 1_000_003 + skip * 7919) * 2654435761 & (1 << 31) - 1) >> 7
    size = CLASSES * WIDTH
    return np.stack([before, size + skip, 2 * size + (pair & PAIRS - 1)], 1)


def _symbol_rows(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return ((rows * CLASSES + owner[:, None]) * 2654435761 >> 11) & (ROWS - 1)


def _powers(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What a softmax divides, in ``out``, and the sums that it divides by."""
    np.take(table, rows[:, 0], axis=0, out=out, mode="clip")
    out += table.take(rows[:, 1], 0)
    out += table.take(rows[:, 2], 0)
    out += bias
    out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    return out.sum(1, keepdims=True)


def predict(weights: Weights, rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Softmax over classes, rows of symbol weights, softmax over the symbols of the true class."""
    owner = symbols // WIDTH
    inner = _symbol_rows(rows, owner)
    by_class = np.empty((len(rows), CLASSES), np.float32)
    by_symbol = np.empty((len(rows), WIDTH), np.float32)
    for a in range(0, len(rows), NEAR):
        lot = slice(a, a + NEAR)
        by_class[lot] /= _powers(weights.of_class, rows[lot], weights.of_class[-1], by_class[lot])
        bias = weights.of_symbol.take(ROWS + owner[lot], 0)
        by_symbol[lot] /= _powers(weights.of_symbol, inner[lot], bias, by_symbol[lot])
    return by_class, inner, by_symbol


def _distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different key, and which of these places stands for each key; keys are below ``bound``."""
    slot, every = np.empty(bound, np.int32), np.arange(len(keys), dtype=np.int32)
    slot[keys] = every
    places = np.flatnonzero(slot[keys] == every)
    slot[keys[places]] = np.arange(len(places))
    return places, slot[keys]


def log10_of(weights: Weights, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The logarithms of what :func:`predict` gives the symbols; only that is divided.

    Each softmax is made once, however often the same two symbols (and class) come before it.
    """
    owner, inside = symbols // WIDTH, symbols % WIDTH
    size = CLASSES * WIDTH
    own, pair = _distinct(rows[:, 0] * size + rows[:, 1] - size, size * size)
    inner, context = _distinct(pair * CLASSES + owner, len(own) * CLASSES)
    of_class = np.empty((len(own), CLASSES), np.float32)
    of_symbol = np.empty((len(inner), WIDTH), np.float32)
    sums = np.empty((len(own), 1), np.float32), np.empty((len(inner), 1), np.float32)
    for a in range(0, len(own), NEAR):
        lot = slice(a, a + NEAR)
        sums[0][lot] = _powers(weights.of_class, rows[own[lot]], weights.of_class[-1], of_class[lot])
    for a in range(0, len(inner), NEAR):
        lot = slice(a, a + NEAR)
        at = inner[lot]
        bias = weights.of_symbol.take(ROWS + owner[at], 0)
        sums[1][lot] = _powers(weights.of_symbol, _symbol_rows(rows[at], owner[at]), bias, of_symbol[lot])
    chances = of_class[pair, owner] / sums[0][pair, 0], of_symbol[context, inside] / sums[1][context, 0]
    return np.log10(np.stack(chances).astype(float)).sum(0)


def _sums(gradient: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``np.add.reduceat(gradient[order], starts)`` gives, to the last bit.

    That takes long for each group, and most are small: these are summed side by side, the first gradient
    and the sum of the others in order.
    """
    total = gradient.take(order[starts], 0)
    small = np.flatnonzero((sizes > 1) & (sizes <= FEW))
    if len(small):
        small = small[np.argsort(-sizes[small], kind="stable")]  # those with an n-th gradient come first
        begin, size = starts[small], sizes[small]
        others = gradient.take(order[begin + 1], 0)
        for n in range(2, int(size[0])):
            more = int(np.count_nonzero(size > n))
            others[:more] += gradient.take(order[begin[:more] + n], 0)
        total[small] += others
    large = sizes > FEW
    if large.any():
        members = order[np.repeat(large, sizes)]
        begin = sizes[large].cumsum() - sizes[large]
        total[large] = np.add.reduceat(gradient.take(members, 0), begin, axis=0)
    return total


def _descend(table: np.ndarray, seen: np.ndarray, square: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One step for the rows of one feature: gradients of equal rows are added first."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # numbers of two bytes are put in order by counting
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    own = ordered[starts]
    sizes = np.diff(np.append(starts, len(rows)))
    total = _sums(gradient, order, starts, sizes)
    square[own] += (total * total).mean(1)
    table[own] -= RATE * total / np.sqrt(square[own] + 1e-8)[:, None]
    seen[own] += sizes


class Descent:
    """Minibatch descent of one task, with a step size per row of weights."""

    def __init__(self, weights: Weights):
        self.start = weights
        self.now = Weights(weights.of_class.copy(), weights.of_symbol.copy())
        self.seen = [np.zeros(len(t), np.float32) for t in (weights.of_class, weights.of_symbol)]
        self.square = [np.ones(len(t), np.float32) for t in (weights.of_class, weights.of_symbol)]

    def take(self, rows: np.ndarray, symbols: np.ndarray) -> None:
        for a in range(0, len(symbols), BATCH):
            part, own = rows[a : a + BATCH], symbols[a : a + BATCH]
            by_class, inner, by_symbol = predict(self.now, part, own)
            at = np.arange(len(own))
            by_class[at, own // WIDTH] -= 1
            by_symbol[at, own % WIDTH] -= 1
            bias = np.full(len(own), len(self.now.of_class) - 1)
            for column in (*part.T, bias):
                _descend(self.now.of_class, self.seen[0], self.square[0], column, by_class)
            for column in (*inner.T, ROWS + own // WIDTH):
                _descend(self.now.of_symbol, self.seen[1], self.square[1], column, by_symbol)

    def changes(self) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """(table, block, row numbers, tokens, changes) of the rows that moved."""
        for table, (now, start) in enumerate(
            ((self.now.of_class, self.start.of_class), (self.now.of_symbol, self.start.of_symbol))
        ):
            moved = np.flatnonzero(self.seen[table])
            for block in np.unique(moved // BLOCK):
                own = moved[moved // BLOCK == block]
                change = (now[own] - start[own]).astype(np.float16)
                yield table, int(block), own.astype(np.int32).tobytes(), self.seen[table][own].tobytes(), change.tobytes()


_CHANGE = "tbl int, block int, salt int, own binary, seen binary, change binary"


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """The changes of one block of rows from many tasks, averaged by tokens."""
    first = int(frame["block"].iloc[0]) * BLOCK
    width = CLASSES if frame["tbl"].iloc[0] == 0 else WIDTH
    seen, total = np.zeros(BLOCK), np.zeros((BLOCK, width))
    for own, n, change in zip(frame["own"], frame["seen"], frame["change"], strict=True):
        at, n = np.frombuffer(own, np.int32) - first, np.frombuffer(n, np.float32)
        seen[at] += n
        total[at] += n[:, None] * np.frombuffer(change, np.float16).reshape(-1, width)
    own = np.flatnonzero(seen)
    mean = (total[own] / seen[own][:, None]).astype(np.float16)
    out = {k: [frame[k].iloc[0]] for k in ("tbl", "block")} | {"salt": [0]}
    out |= {"own": [(own + first).astype(np.int32).tobytes()], "seen": [seen[own].astype(np.float32).tobytes()]}
    return pd.DataFrame(out | {"change": [mean.tobytes()]})


def fit(documents: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over the documents outside the held-out fold, in ``rounds`` parts."""
    weights, plain = Weights.zero(), _plain(counts)
    if not counts.n:
        return weights
    spark = documents.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, counts.n // (rounds * TASK_TOKENS))
    turn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    for k in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], now: Weights = weights) -> Iterator[pa.RecordBatch]:
            descent, lookup = Descent(now), Lookup(plain)
            salt = 0
            for batch in batches:
                salt = zlib.crc32(str(batch.num_rows).encode(), salt)
                for ends, _, symbols, _ in encoded(lookup, batch.column(0).to_pylist()):
                    descent.take(features(symbols, ends, plain.end_symbol), symbols)
            rows = [(t, b, salt % 64, *rest) for t, b, *rest in descent.changes()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in rows], kind)
                    for i, kind in enumerate((pa.int32(),) * 3 + (pa.binary(),) * 3)
                ],
                names=["tbl", "block", "salt", "own", "seen", "change"],
            )

        part = documents.where((fold("doc_id", FOLDS) != HELD) & (F.floor(turn / FOLDS) % rounds == k))
        part = part.select(F.col("text").cast("binary").alias("text")).coalesce(int(tasks))
        # first within 64 groups of tasks, then over these, so that no task adds up all the others
        found = part.mapInArrow(learn, _CHANGE)
        found = found.groupBy("tbl", "block", "salt").applyInPandas(_averaged, _CHANGE)
        found = found.groupBy("tbl", "block").applyInPandas(_averaged, _CHANGE)
        weights = Weights(weights.of_class.copy(), weights.of_symbol.copy())
        for row in found.collect():
            own = np.frombuffer(row["own"], np.int32)
            table = weights.of_class if row["tbl"] == 0 else weights.of_symbol
            table[own] += np.frombuffer(row["change"], np.float16).reshape(len(own), -1)
    return weights


def score(documents: DataFrame, counts: Counts, weights: Weights) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Null and empty texts are one end. Without training documents nothing is known, the base gives
    every token probability one, and the model is uniform over its symbols.
    """
    plain = _plain(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.log10(np.append(plain.count, [0]).astype(float) + 1)  # the last is for rare words: added later
        size = np.log10(plain.rest_size)
        modelled = np.append(plain.symbol >= 0, [False])
        end = math.log10(plain.documents + 1)
        lookup = Lookup(plain)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for ends, place, symbols, rare in encoded(lookup, batch.column(1).to_pylist(), SCORED, words=True):
                base = known[np.maximum(place, -1)]
                base[place == -2] = end
                model = log10_of(weights, features(symbols, ends, plain.end_symbol), symbols)
                in_rest = (place >= -1) & ~modelled[np.maximum(place, -1)]
                rest_at = np.full(CLASSES * WIDTH, 0)
                rest_at[plain.rest_symbol] = np.arange(RESTS)
                model[in_rest] += base[in_rest] - size[rest_at[symbols[in_rest]]]
                begins = np.concatenate([[0], ends[:-1]])
                out[0] += (ends - begins).tolist()
                seen = place >= 0 if plain.documents == 0 else place != -1
                out[1] += np.add.reduceat(seen.astype(np.int64) * (plain.n > 0), begins).tolist()
                out[2] += np.add.reduceat(base, begins).tolist()
                out[3] += np.add.reduceat(model, begins).tolist()
                out[4] += [list(Counter(w).items()) for w in rare]
            pairs = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
            rare_words = pa.array([[{"word": w, "times": n} for w, n in r] for r in out[4]], pairs)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(x, kind) for x, kind in zip(out[:4], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, rare_words], names=["doc_id", "n", "known", "base", "model", "rare"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    done = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, n long, known long, base double, model double, rare array<struct<word: binary, times: bigint>>",
    )
    done = stored(done.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # rare words that the training documents hold; the others have a count of zero and add nothing
    late = (
        done.select("row", F.inline("rare"))
        .join(counts.rare.select("word", "c"), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("late"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return done.join(late, "row", "left").select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("late", F.lit(0))).alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * math.log10(counts.n + counts.distinct + 1)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def judge(documents: DataFrame) -> DataFrame:
    counts = count(documents)
    return score(documents, counts, fit(documents, counts))
