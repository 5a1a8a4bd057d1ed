"""Phrases whose words stand together more often than their parts would, mined by partitions.

A text with A-Z in lower case is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. Everything is counted for each language (null: ``und``). A phrase is two to
``LONGEST`` words of one piece; it is a candidate when it occurs ``support`` times or more.

The candidates are found by partitions. Documents are dealt to SHARDS shards; a shard with the share p
of the texts' bytes is mined completely with the support ``p * support``. Shares add up to one, so
a phrase that misses its local support in every shard misses the support as a whole, and the union
of what is frequent in some shard holds every candidate. Shards are mined level by level: words and
pairs first, then phrases of n words whose two parts of n - 1 words are in the union so far. Mining
counts 64-bit hashes, partly in the tasks and then by an ordinary aggregate, so a shard is any number of tasks.
A last pass counts the phrases of the union as texts in all documents; what a hash or the filter let
in by mistake falls below the support there. Only inside one lot of a task are phrases told apart by their hashes.

The union reaches the tasks as a bit filter of at most FILTER_BITS bits whatever the corpus: a fuller
filter lets more phrases through to the count, and loses none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm import wordhash
from nichegrid.llm.tables import fold, stored

SUPPORT = 10
LONGEST = 3
#: with fewer shards than the support, a phrase has to repeat inside one to be frequent there
SHARDS = 4
#: the filter's size at most (16 MB), and its bits for each phrase of the union below that
FILTER_BITS, BITS_EACH = 1 << 27, 32
#: occurrences that a task counts at a time, and bytes of text that it hashes at a time
LOT, BYTES = 1 << 21, 1 << 21
#: spelt phrases that a task holds
HELD = 1 << 19
_MISSING = "und"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z), which bytes end a word, which end a piece."""
    values = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    piece = np.zeros(256, bool)
    piece[list(b".,;:!?\n\x0b\x0c\r")] = True
    gap = piece.copy()
    gap[list(b" \t")] = True
    values[gap] = 0
    return values, gap, piece


_VALUES, _GAP, _PIECE = _tables()


class Words:
    """The words of a lot of texts: ``raw`` bytes, ``start`` and ``end``, ``text`` number, ``piece``, ``hash``."""

    def __init__(self, texts: Sequence[bytes | None], langs: np.ndarray) -> None:
        """``langs`` holds a number for each text's language, which the hashes depend on."""
        self.raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        gap = _GAP[self.raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        begins = ~gap[edge]
        self.start = edge[begins] if gap[0] else np.concatenate([[0], edge[begins]])
        self.end = edge[~begins]
        ends = np.array([len(t or b"") + 1 for t in texts]).cumsum()
        self.text = np.searchsorted(ends, self.start, side="right")
        self.piece = _PIECE[self.raw].cumsum(dtype=np.int32)[self.start]
        self.hash = np.zeros(0, np.uint64)
        if len(self.start):
            first = int(self.start[0])
            sizes = np.diff(np.append(self.start, len(self.raw)))
            inside = np.arange(len(self.raw) - first, dtype=np.int32) - np.repeat(self.start - first, sizes)
            power = np.full(int(inside.max()) + 1, _SEED, np.uint64)
            power[0] = 1
            parts = _VALUES[self.raw[first:]] * power.cumprod(dtype=np.uint64)[inside]
            self.hash = wordhash.mixed(np.add.reduceat(parts, self.start - first) ^ langs[self.text])

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of every run of ``size`` words in one piece."""
        n = max(len(self.start) - size + 1, 0)
        at = np.arange(n)
        if size > 1:
            at = at[self.piece[size - 1 :] == self.piece[:n]]
        key = self.hash[at]
        for i in range(1, size):
            key = key * _SEED + self.hash[at + i]
        return at, wordhash.mixed(key + np.uint64(size))

    def spelt(self, at: np.ndarray, size: int) -> list[bytes]:
        """The phrases of ``size`` words from the words ``at``, joined by single spaces; empty for none."""
        if not size:
            return [b""] * len(at)
        raw = self.raw.tobytes().lower()  # bytes: A-Z only
        columns = [[raw[s:e] for s, e in zip(self.start[at + i], self.end[at + i], strict=True)] for i in range(size)]
        return columns[0] if size == 1 else [b" ".join(words) for words in zip(*columns, strict=True)]


def _lots(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes | None]]]:
    """Texts of the batch's first column, some BYTES at a time or one longer text."""
    column, first = batch.column(0), 0
    total = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
    while first < len(total):
        base = total[first - 1] if first else 0
        last = max(int(np.searchsorted(total, base + BYTES, side="right")), first + 1)
        yield slice(first, last), column.slice(first, last - first).to_pylist()
        first = last


def _numbers(langs: Sequence[str]) -> np.ndarray:
    known = {lang: zlib.crc32(lang.encode()) for lang in set(langs)}
    return wordhash.mixed(np.array([known[lang] for lang in langs], np.uint64))


def _passes(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    if bits is None or not len(bits):
        return np.zeros(len(keys), bool)
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Tally:
    """Counts of (shard, key), handed out whenever LOT occurrences have come together."""

    def __init__(self) -> None:
        self.shards: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, shards: np.ndarray, keys: np.ndarray) -> None:
        self.shards.append(shards)
        self.keys.append(keys)
        self.held += len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        shards, keys = np.concatenate(self.shards), np.concatenate(self.keys)
        self.shards, self.keys, self.held = [], [], 0
        for shard in range(SHARDS):
            own, counts = np.unique(keys[shards == shard], return_counts=True)
            for i in range(0, len(own), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[part].view(np.int64)),
                        pa.array(np.full(len(own[part]), shard, np.int8)),
                        pa.array(counts[part].astype(np.int32)),
                    ],
                    names=["key", "shard", "c"],
                )


def _mined(texts: DataFrame, sizes: Sequence[int], least: Sequence[int], union: np.ndarray | None) -> DataFrame:
    """key: the phrases of these sizes that reach the local support of some shard.

    With ``union``, a filter of the phrases one word shorter, only phrases are counted of which both the
    part without the last and the part without the first word pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            langs, shards = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(np.int8)
            for lot, own in _lots(batch):
                words = Words(own, _numbers(langs[lot]))
                for size in sizes:
                    at, key = words.phrases(size)
                    if union is not None:
                        short, part = words.phrases(size - 1)
                        fine = np.zeros(len(words.start) + 1, bool)
                        fine[short] = _passes(union, part)
                        both = fine[at] & fine[at + 1]
                        at, key = at[both], key[both]
                    tally.add(shards[lot][words.text[at]], key)
                if tally.held >= LOT:
                    yield from tally.batches()
        yield from tally.batches()

    # a task hands out a key once a lot, so no key is hot, and the few repeats need no partial aggregate
    counts = texts.mapInArrow(count, "key long, shard byte, c int").repartition("key")
    enough = F.lit(False)
    for shard, bound in enumerate(least):
        enough = enough | ((F.col("shard") == shard) & (F.col("c") >= bound))
    return counts.groupBy("key", "shard").agg(F.sum("c").alias("c")).where(enough).select("key").distinct()


def _filter(keys: DataFrame) -> np.ndarray:
    """The bit filter of stored keys; its size is bounded, whatever their number."""
    n, size = keys.count(), 1 << 10
    while size < min(n * BITS_EACH, FILTER_BITS):
        size *= 2
    place = F.col("key").bitwiseAND(F.lit(size - 1))
    words = (
        keys.groupBy(F.shiftright(place, 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 64, np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


class _Spellings:
    """Counts of phrases by their hashes; a phrase is spelt when a task meets it first."""

    def __init__(self) -> None:
        self.keys, self.counts, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.langs: list[str] = []
        self.sizes: list[int] = []
        self.phrases: list[bytes] = []

    def add(self, words: Words, langs: np.ndarray, size: int, at: np.ndarray, keys: np.ndarray) -> None:
        own, first, counts = np.unique(keys, return_index=True, return_counts=True)
        if not len(own):
            return
        place = np.searchsorted(self.keys, own)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == own[known]
        self.counts[place[known]] += counts[known]
        at = at[first[~known]]
        slots = np.arange(len(at)) + len(self.phrases)
        self.langs += langs[words.text[at]].tolist()
        self.sizes += [size] * len(at)
        self.phrases += words.spelt(at, size)
        keys = np.concatenate([self.keys, own[~known]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.concatenate([self.counts, counts[~known]])[order]
        self.at = np.concatenate([self.at, slots])[order]

    def batch(self) -> pa.RecordBatch:
        counts = np.empty(len(self.phrases), np.int64)
        counts[self.at] = self.counts
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(self.langs, pa.string()), pa.array(self.sizes, pa.int32()),
                pa.array(self.phrases, pa.binary()).cast(pa.string()), pa.array(counts),
            ],
            names=["lang", "size", "phrase", "c"],
        )
        self.__init__()
        return out


def _counted(texts: DataFrame, longest: int, filters: Sequence[np.ndarray]) -> DataFrame:
    """lang, size, phrase, c: how often the phrases that pass the filters occur; size 0 counts all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Spellings()
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lot, own in _lots(batch):
                names = langs[lot]
                words = Words(own, _numbers(names))
                found.add(words, names, 0, np.arange(len(words.start)), _numbers(names)[words.text])
                for size in range(1, longest + 1):
                    at, key = words.phrases(size)
                    some = _passes(filters[max(size - 2, 0)], key)
                    found.add(words, names, size, at[some], key[some])
                if len(found.phrases) >= HELD:
                    yield found.batch()
        yield found.batch()

    return (
        texts.mapInArrow(count, "lang string, size int, phrase string, c long")
        .groupBy("lang", "size", "phrase")
        .agg(F.sum("c").alias("c"))
    )


def phrase_counts(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, c of every phrase of 1 to ``longest`` words that occurs ``support`` times or more
    in its language, exactly counted; the row of size 0 and an empty phrase counts all words.

    Null texts have no words, a missing language is ``und``; rows that repeat a document count again.
    """
    texts = documents.select(
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_MISSING)).alias("lang"),
        fold("doc_id", SHARDS).cast("byte").alias("shard"),
    )
    shares = {r["shard"]: r["n"] for r in texts.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect()}
    whole = max(sum(shares.values()), 1)
    least = [max(-(-support * shares.get(i, 0) // whole), 1) for i in range(SHARDS)]
    filters: list[np.ndarray] = []  # the first is of words and pairs
    for sizes in [[1, 2], *([n] for n in range(3, longest + 1))]:
        filters.append(_filter(stored(_mined(texts, sizes, least, filters[-1] if filters else None), "frequent")))
    return _counted(texts, longest, filters).where((F.col("c") >= support) | (F.col("size") == 0))


def collocations(
    documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST, percent: int = 50
) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of every candidate that no longer candidate stands for.

    The score is ``floor(1000000 * a * a / (l * r))`` of the cut into a first part found l times and a rest
    found r times that scores least; equal scores: the cut after fewer words. A candidate goes if a longer
    one that contains it occurs in ``percent`` of its places or more. Products are decimals of 38 digits.
    """
    counts = stored(phrase_counts(documents, support, longest), "phrase-counts")
    candidates = counts.where("size > 1")
    words = F.split("phrase", " ")

    def part(from_: Column | int, n: Column | int) -> Column:
        return F.array_join(F.slice(words, from_, n), " ")

    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "size", F.col("c").alias("a"), k)
    cuts = cuts.select("*", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.where("size > 0").select("lang", "phrase", "c")
    for side, of in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("c").alias(of)), ["lang", side])
    exact = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    million = F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("above", million * (exact["a"] * exact["a"]).cast("decimal(31,0)")).withColumn(
        "below", exact["l"] * exact["r"]
    )
    score = F.expr("above div below")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    starts = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("from")
    longer = candidates.where("size > 2").select(
        "lang", "phrase", "size", "c", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n")
    )
    longer = longer.select("*", starts).select("lang", part(F.col("from"), F.col("n")).alias("phrase"), "c")
    longer = longer.groupBy("lang", "phrase").agg(F.max("c").alias("within"))
    rows = best.join(longer, ["lang", "phrase"], "left")
    rows = rows.where(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * percent))
    # one row for each language; the join is of candidates, not of occurrences
    totals = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return rows.join(totals, "lang").select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(documents: DataFrame, most: int = 2000, support: int = SUPPORT) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n (all words), score.

    Order: score, then a, both falling, then the phrase by its bytes. An empty table has no rows.
    """
    found = stored(collocations(documents, support), "collocations")
    place = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    first = found.withColumn("rank", place).where(F.col("rank") <= most)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
