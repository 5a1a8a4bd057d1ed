"""Removing every byte of a passage of LENGTH bytes that also starts earlier, over all documents.

A window is LENGTH consecutive bytes of one document. The least hash among the runs of GRAM bytes in
a window is its anchor, so equal windows have equal anchors. Consecutive windows with one anchor form a
context (up to SPAN windows and the bytes they cover); anchors found once in all documents are dropped,
which only drops windows that occur once. Of documents with one and the same text only the first has
contexts, since all windows of the others start earlier there. The contexts of an anchor then meet in one
bucket, and buckets are sorted on their own:

* Equal contexts are one text with its earliest place; all windows of the others start earlier elsewhere.
* Texts that have no window in common with another are left out. A window holds its anchor in one of SPAN
  places; for each fifth of them the bytes that all its windows hold have to occur in another text too.
* The different texts are dealt to shards, every shard is sorted and has its Burrows-Wheeler
  transform. The transforms are merged by refining an interleave: the order of suffixes by their
  first h bytes gives the order by h + 2 bytes through one stable count of the transforms' pairs of
  bytes, without sorting suffixes again. Only suffixes that can still become a window take part: those at
  the end of a window at first, and never one that is alone in its block. The places that share a block
  after LENGTH steps are a repeated interval: windows with a common prefix of LENGTH bytes.
* In each interval all windows but the earliest are repeats.

Contexts are counted by anchor in an ordinary aggregate before any of them are brought together. An
anchor with very many contexts (a short line that most documents hold) would make a bucket of its
own size. Above HOT contexts its equal contexts are found by an ordinary aggregate, one row each, and
only the earliest of them are cut on: at the anchor's place in the window, into lots of 16, 4 and 1
windows. Each lot is judged by its bytes in the same way, and is cut on only if the bytes that all its windows
would hold occur in another lot too. Keys that are hot are marked by a broadcast.

Documents are ordered by doc_id (missing first), then by the hash of their text; rows that share both
are one document and come out alike. Null counts as empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm import wordhash
from nichegrid.llm.tables import document_key, stored

LENGTH = 100
GRAM = 16
#: windows of one context, and contexts that one bucket takes on average
SPAN, BUCKET = LENGTH - GRAM + 1, 20_000
TWICE = 128
#: contexts of one anchor that go to one bucket at most
HOT = 20_000
#: windows of a hot context that are judged together, in turn; each number divides the one before
LOTS = (16, 4, 1)
#: keys of changed documents and of copies, and hot contexts, that are broadcast, some 20 bytes each; beyond,
#: all texts are dealt by their key
BROADCAST_KEYS = 500_000
#: bytes of one shard of a bucket
SHARD = 1 << 16
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _grams(text: np.ndarray) -> np.ndarray:
    """The hashes of all runs of GRAM bytes."""
    grams, factor, have = _BYTES[text], 0x9E3779B97F4A7C15, 1
    while have < GRAM:  # doubles the run each time
        grams = grams[:-have] * np.uint64(factor) + grams[have:]
        factor = factor * factor % (1 << 64)
        have *= 2
    return wordhash.mixed(grams)


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of the contexts of a text of at least LENGTH bytes.

    A context that may hold a window twice, since its anchor stands in it twice, has TWICE added to the
    number of its windows.
    """
    grams = _grams(text)
    least = _sliding_least(grams, SPAN)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.append(starts, len(least)))
    pieces = -(-counts // SPAN)  # a periodic text keeps one anchor for long
    if pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
        left = np.repeat(counts, pieces) - nth * SPAN
        starts, counts = np.repeat(starts, pieces) + nth * SPAN, np.minimum(left, SPAN)
    # the places that are least in some window, and where two neighbours of them are alike
    around = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    at = np.flatnonzero(grams == ~_sliding_least(~around, SPAN))
    alike = np.concatenate([[0], np.cumsum(grams[at[1:]] == grams[at[:-1]])])
    low = np.searchsorted(at, starts)
    high = np.maximum(np.searchsorted(at, starts + counts + SPAN - 1) - 1, low)
    twice = alike[high] > alike[np.minimum(low, len(alike) - 1)]
    return least[starts], starts, counts + TWICE * twice


def _packed(**columns: tuple[Sequence, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _met(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``counted``: key, n (how many rows have it, or more) and further columns.

    Keys of more than HOT rows are at most one in HOT rows and are broadcast, so their rows stay where
    they are; the others are dealt by key, at most HOT rows each. No task holds all rows of a hot key.
    """
    many = F.broadcast(counted.where(F.col("n") > HOT))
    few = rows.join(many.select(key), key, "left_anti").join(counted.where(F.col("n") <= HOT), key)
    return rows.join(many, key).unionByName(few)


def _occurrences(documents: DataFrame) -> DataFrame:
    """row, anchor, start, windows of every context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts, found = batch.column(1).to_pylist(), []
            for i, text in enumerate(texts):
                if text is not None and len(text) >= LENGTH:
                    a, s, c = anchors(np.frombuffer(text, np.uint8))
                    found.append((a, np.full(len(a), rows[i]), s, c))
            if not found:
                continue
            a, r, s, c = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _packed(
                row=(r, pa.int64()), anchor=(a.view(np.int64), pa.int64()),
                start=(s.astype(np.int64), pa.int64()), windows=(c.astype(np.int32), pa.int32()),
            )

    blobs = documents.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    return blobs.mapInArrow(find, "row long, anchor long, start long, windows int")


def _shared(documents: DataFrame) -> DataFrame:
    """row, anchor, start, windows, hot of the contexts whose anchor occurs twice or more."""
    every = stored(_occurrences(documents), "contexts")
    times = F.when(F.col("windows") >= TWICE, 2).otherwise(1)
    totals = stored(every.groupBy("anchor").agg(F.sum(times).alias("n")).where("n > 1"), "anchor-counts")
    return _met(every, totals, "anchor").select("row", "anchor", "start", "windows", (F.col("n") > HOT).alias("hot"))


def alphabet(texts: Sequence[bytes]) -> np.ndarray:
    """The symbol of each byte: 1, 2, ... for those that occur; 0 is the end of a text."""
    held = np.unique(np.frombuffer(b"".join(texts), np.uint8))
    symbols = np.zeros(256, np.uint16)
    symbols[held] = np.arange(1, len(held) + 1)
    return symbols


def transform(texts: Sequence[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's rotations in order: text number and place of each, and the symbols before it.

    That is one symbol, or two as one number where the alphabet leaves room for that. Rotations are
    sorted by prefixes that double up to more than LENGTH symbols, which is all that intervals need.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    offset = np.concatenate([[0], sizes.cumsum()])
    symbols = letters[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    symbols[offset[1:] - 1] = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(offset[-1]) - offset[owner]

    def ahead(h: int) -> np.ndarray:
        return offset[owner] + (place + h) % sizes[owner]

    # the first ranks are of as many symbols as fit into a number
    rank, have, width = symbols.astype(np.int64), 1, int(letters.max()) + 1
    while (have + 1) * math.log2(width) < 62:
        rank = rank * width + symbols[ahead(have)]
        have += 1
    rank = np.unique(rank, return_inverse=True)[1]
    while have < LENGTH + 2:
        key = rank * offset[-1] + rank[ahead(have)]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        have *= 2
    order = np.argsort(rank, kind="stable")
    owner, place = owner[order], place[order]
    before = symbols[offset[owner] + (place - 1) % sizes[owner]]
    if _step(letters) == 2:
        before = symbols[offset[owner] + (place - 2) % sizes[owner]] * np.uint16(width) + before
    return owner, place, before


def _step(letters: np.ndarray) -> int:
    """How many symbols a refinement adds: two if all pairs fit into 16 bits."""
    return 2 if (int(letters.max()) + 1) ** 2 <= 1 << 16 else 1


def merged(
    shards: Sequence[np.ndarray], step: int, at: np.ndarray | None = None, links: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' transforms and the block of each place, LENGTH symbols deep.

    The interleave says which place of the joined shards each place of the merged order is; places in one
    block have rotations that agree in their first LENGTH symbols. ``at`` are the places to begin with, all
    by default, and ``links`` the place whose rotation begins ``step`` symbols before. With ``at``, places
    that are alone in their block go: what stands before them is alone too.
    """
    joined = np.concatenate(shards)
    every = at is None
    if every:
        at = np.arange(len(joined))
    if links is None:  # the n-th place with a symbol leads to the n-th rotation that begins with it
        links, first = np.empty(len(joined), np.int64), 0
        for shard in shards:
            links[first + np.argsort(shard, kind="stable")] = np.arange(first, first + len(shard))
            first += len(shard)
    block = np.zeros(len(at), np.int32)
    for _ in range(LENGTH // step):
        symbol = joined[at]
        order = np.argsort(symbol, kind="stable")  # a radix sort of 16 bits
        at, block, symbol = links[at[order]], block[order], symbol[order]
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        if every:
            edge = edge[:-1]
        else:
            stay = np.flatnonzero(~(edge[:-1] & edge[1:]))
            at, edge = at[stay], edge[stay]
        block = np.cumsum(edge, dtype=np.int32)
    return at, block


def intervals(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and interval of the windows that stand in several places of different texts."""
    shards, places, links, own, size, done, letters = [], [], [], [], 0, 0, alphabet(texts)
    step = _step(letters)
    for i, text in enumerate(texts):
        own.append(i)
        size += len(text) + 1
        if size >= SHARD or i == len(texts) - 1:
            owner, place, before = transform([texts[j] for j in own], letters)
            shards.append(before)
            numbers = np.array(own)
            places.append((numbers[owner], place))
            # where the rotation of the same text that begins a step before has come to stand
            sizes = np.array([len(texts[j]) + 1 for j in own])
            offset = sizes.cumsum() - sizes
            stands = np.empty(size, np.int64)
            stands[offset[owner] + place] = np.arange(done, done + size)
            links.append(stands[offset[owner] + (place - step) % sizes[owner]])
            own, size, done = [], 0, done + size
    if not shards:
        return (np.zeros(0, np.int64),) * 3
    number, place = (np.concatenate(x) for x in zip(*places, strict=True))
    # LENGTH symbols on from the beginning of a window, to which the steps lead back
    at, block = merged(shards, step, np.flatnonzero(place >= LENGTH), np.concatenate(links))
    return number[at], place[at], block


def _may_share(texts: Sequence[bytes], anchor: np.ndarray) -> np.ndarray:
    """Which texts may have a window in common with another text of their anchor, or hold one twice.

    In a window the anchor stands behind 0 to SPAN - 1 bytes. Windows where that is ``least`` to ``least +
    width - 1`` have LENGTH - width + 1 bytes in common that begin ``least`` before the anchor, so only
    texts that agree in these can share one of them. Anchors that stand several times in a text keep all texts.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = sizes.cumsum() - sizes
    grams = _grams(joined)
    found = np.flatnonzero(grams == np.repeat(anchor.view(np.uint64), sizes)[: len(grams)])
    of = np.searchsorted(begin, found, side="right") - 1
    inside = found + GRAM <= begin[of] + sizes[of]
    found, of = found[inside], of[inside]
    once = np.bincount(of, minlength=len(texts)) == 1
    found, of = found[once[of]], of[once[of]]
    keep = np.isin(anchor, anchor[~once])
    width = SPAN // 5
    common = LENGTH - width + 1
    for least in range(0, SPAN, width):
        first = found - least
        whole = np.flatnonzero((first >= begin[of]) & (first + common <= begin[of] + sizes[of]))
        key = anchor[of[whole]].view(np.uint64)
        for ahead in (*range(0, common - GRAM, GRAM), common - GRAM):
            key = wordhash.mixed(key) + grams[first[whole] + ahead]
        _, same, times = np.unique(key, return_inverse=True, return_counts=True)
        keep[of[whole][times[same] > 1]] = True
    return keep


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """doc, first, last: ranges of windows of a bucket's contexts that start earlier elsewhere."""
    frame = frame.sort_values(["anchor", "context", *_DOC, "start"], kind="stable")
    same = (frame["anchor"] == frame["anchor"].shift()) & (frame["context"] == frame["context"].shift())
    group = (~same).cumsum()
    lead = frame[~same]
    at_lead = lead.iloc[group.to_numpy() - 1]
    later = (frame[[*_DOC, "start"]].to_numpy() != at_lead[[*_DOC, "start"]].to_numpy()).any(axis=1)
    out = frame.loc[later, [*_DOC, "start", "windows"]].copy()
    out["last"] = out["start"] + out["windows"] % TWICE
    out = out.rename(columns={"start": "first"})[[*_DOC, "first", "last"]]
    # a context that is alone with its anchor has no window in common with another
    several = lead["anchor"].duplicated(keep=False) | (lead["windows"] >= TWICE)
    lead = lead[several]
    if len(lead):
        lead = lead[_may_share(lead["context"].tolist(), lead["anchor"].to_numpy(np.int64))].reset_index(drop=True)
    if len(lead):
        # places in order: the first documents come first
        rank = lead.groupby(_DOC, sort=True).ngroup().to_numpy()
        start = lead["start"].to_numpy()
        # equal windows share their anchor, so intervals do not mix buckets' anchors
        number, place, block = intervals(lead["context"].tolist())
        at = np.lexsort((start[number] + place, rank[number], block))
        number, place, block = number[at], place[at], block[at]
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        earliest = np.repeat(begin, np.diff(np.append(begin, len(block))))
        where = start[number] + place
        repeat = (rank[number] != rank[number[earliest]]) | (where != where[earliest])
        number, place = number[repeat], place[repeat]
        if len(number):
            at = np.lexsort((place, number))
            number, place = number[at], place[at]
            begin = np.concatenate([[True], (number[1:] != number[:-1]) | (place[1:] > place[:-1] + 1)])
            a = np.flatnonzero(begin)
            b = np.append(a[1:], len(number)) - 1
            got = lead.loc[number[a], _DOC].reset_index(drop=True)
            got["first"], got["last"] = start[number[a]] + place[a], start[number[a]] + place[b] + 1
            out = pd.concat([out, got])
    return out.astype({"first": "int64", "last": "int64"})


#: a document inside a bucket. A missing id is its own column: pandas makes numbers beside a null inexact
_DOC = ["has_id", "doc_id", "text"]
_RANGES = "text long, first long, last long"


def _copies(documents: DataFrame) -> DataFrame:
    """doc, n_bytes of the documents of LENGTH bytes or more whose whole text an earlier document has."""
    body = F.col("text").cast("binary")
    keyed = documents.where(F.length(body) >= LENGTH).select(
        document_key().alias("doc"), F.unhex(F.md5(body)).alias("digest"), F.length(body).cast("long").alias("n_bytes")
    )
    several = keyed.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("last"))
    several = stored(several.where("least <> last"), "equal-texts").select("digest", "least")
    return keyed.join(several, "digest").where("doc <> least").select("doc", "n_bytes").distinct()


def repeated_windows(documents: DataFrame) -> DataFrame:
    """doc_id, text (hash), first, last: ranges of window starts whose bytes are removed."""
    copies = stored(_copies(documents), "copies")
    keys = copies.select("doc")
    if copies.count() <= BROADCAST_KEYS:  # so no text has to move
        keys = F.broadcast(keys)
    firsts = documents.select(document_key().alias("doc"), "doc_id", "text").join(keys, "doc", "left_anti")
    whole = copies.select(
        "doc.doc_id", "doc.text", F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - LENGTH + 1).alias("last")
    )
    return _windows_of_different(firsts.select("doc_id", "text")).unionByName(whole)


def _pieces(context: bytes, anchor: int) -> list[dict[str, int]]:
    """A context's windows by the next anchor in them: skip (windows before), windows, ahead.

    ``ahead`` is how far the anchor is from the first of the windows, one less with each. It only depends on a
    window's bytes, so equal windows agree in it and no piece holds a window twice.
    """
    at = np.flatnonzero(_grams(np.frombuffer(context, np.uint8)).view(np.int64) == anchor)
    first = np.maximum(np.append(0, at[:-1] + 1), at - SPAN + 1) if len(at) else at
    last = np.minimum(at + 1, len(context) - LENGTH + 1)
    rows = zip(first.tolist(), last.tolist(), at.tolist(), strict=True)
    return [{"skip": a, "windows": b - a, "ahead": place - a} for a, b, place in rows if a < b]


def _part(skip: Column, windows: Column) -> list[Column]:
    """context and place of ``windows`` windows that begin ``skip`` windows on."""
    return [
        F.substring("context", (skip + 1).cast("int"), (windows + LENGTH - 1).cast("int")).alias("context"),
        F.struct("place.doc_id", "place.text", (F.col("place.start") + skip).alias("start")).alias("place"),
    ]


def _in_pieces(contexts: DataFrame) -> DataFrame:
    """ahead, context, place of the pieces of ``contexts``: anchor, context, place."""

    @F.arrow_udf("array<struct<skip: int, windows: int, ahead: int>>")
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("skip", pa.int32()), ("windows", pa.int32()), ("ahead", pa.int32())]))
        for bodies, own in batches:
            yield pa.array(map(_pieces, bodies.to_pylist(), own.to_pylist()), kind)

    cut = contexts.select("context", "place", F.explode(pieces("context", "anchor")).alias("piece"))
    return cut.select("piece.ahead", *_part(F.col("piece.skip"), F.col("piece.windows")))


def _in_lots(pieces: DataFrame, width: int) -> DataFrame:
    """The same for their lots: windows with the anchor ``width`` * lot to ``width`` * (lot + 1) - 1 bytes ahead."""
    ahead, lot = F.col("ahead"), F.col("lot")
    least = ahead - (F.length("context") - LENGTH)
    lots = F.sequence(F.floor(least / width), F.floor(ahead / width))
    most = F.least(ahead, lot * width + (width - 1))
    windows = most - F.greatest(least, lot * width) + 1
    cut = pieces.select("ahead", "context", "place", F.explode(lots).alias("lot"))
    return cut.select(most.cast("int").alias("ahead"), *_part(ahead - most, windows))


def _by_bytes(contexts: DataFrame, kept: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Ranges of the contexts whose bytes an earlier one has, and the others: ``kept``, context, place.

    ``kept`` is a column that equal contexts agree in.
    """
    contexts = stored(contexts, name)
    least = F.min("place").alias("least")
    firsts = stored(contexts.groupBy("context", kept).agg(least, F.count("*").alias("n")), f"{name}-first")
    met = _met(contexts.select("context", "place"), firsts.where("n > 1").drop(kept), "context")
    start = F.col("place.start")
    late = met.where("place <> least").select(
        "place.doc_id", "place.text", start.alias("first"), (start + F.length("context") - (LENGTH - 1)).alias("last")
    )
    return late, firsts.select(kept, "context", F.col("least").alias("place"))


def _late(contexts: DataFrame) -> DataFrame:
    """doc_id, text, first, last: the repeats among the windows of hot ``contexts``: anchor, context, place.

    No task holds all contexts of an anchor, and a context becomes many rows only where others have most of it.
    """
    late, firsts = _by_bytes(contexts, "anchor", "hot-contexts")
    pieces = _in_pieces(firsts)
    for width in LOTS:
        more, firsts = _by_bytes(_in_lots(pieces, width), "ahead", f"hot-lots-{width}")
        late = late.unionByName(more)
        if width > 1:
            # what all windows of a whole lot hold; without it in another lot they stand in this one alone
            core = F.substring("context", F.col("ahead") % width + 1, F.lit(LENGTH - width + 1))
            firsts = firsts.withColumn("core", core)
            several = firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
            pieces = _met(firsts, stored(several, "hot-cores"), "core").select("ahead", "context", "place")
    return late


def _windows_of_different(documents: DataFrame) -> DataFrame:
    """The same for documents of which no two have one text, but for rows that repeat a document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = stored(_shared(documents), "shared-anchors")
    total = shared.count()
    buckets = max(1, math.ceil(total / BUCKET))
    hot_ones = shared.where("hot").count()
    texts = documents.select(
        F.xxhash64("doc_id", "text").alias("row"),
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
        F.col("text").cast("binary").alias("body"),
    )
    id_ = F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id")

    def held(part: DataFrame, few: bool) -> DataFrame:
        at = part.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("at"))
        return texts.join(F.broadcast(at) if few else at, "row").select(
            id_, F.col("hash").alias("text"), "body", "at", F.col("doc_id").isNotNull().alias("has_id")
        )

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, bodies, has_id = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            at = batch.column(3)
            edges = at.offsets.to_numpy()
            anchor, start, windows = (at.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows: list[list] = [[] for _ in range(8)]

            def put(bucket, own, doc, first, n, context, rows=rows):
                for column, value in zip(rows, (bucket, own, *doc, first, n, context), strict=True):
                    column.append(value)

            for i, body in enumerate(bodies):
                doc = (has_id[i], ids[i], hashes[i])
                for j in range(edges[i], edges[i + 1]):
                    s, n = int(start[j]), int(windows[j]) % TWICE
                    context = body[s : s + n + LENGTH - 1]
                    if len(context) != n + LENGTH - 1:
                        continue  # of another document whose row hash is the same
                    put(int(anchor[j]) % buckets, int(anchor[j]), doc, s, int(windows[j]), context)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_()),
                    pa.array(rows[3], batch.column(0).type), pa.array(rows[4], pa.int64()),
                    pa.array(rows[5], pa.int64()), pa.array(rows[6], pa.int32()), pa.array(rows[7], pa.binary()),
                ],
                names=["bucket", "anchor", "has_id", "doc_id", "text", "start", "windows", "context"],
            )

    own = F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id")
    schema = f"bucket long, anchor long, has_id boolean, doc_id {kind}, text long, start long, windows int, context binary"
    found = held(shared.where("not hot"), False).mapInArrow(contexts, schema)
    plain = found.groupBy("bucket").applyInPandas(_repeated, f"has_id boolean, doc_id {kind}, {_RANGES}")
    plain = plain.select(own, "text", "first", "last")
    if not hot_ones:
        return plain
    # the texts do not move a second time for hot contexts, unless there are very many
    few = held(shared.where("hot"), hot_ones <= BROADCAST_KEYS)
    found = few.mapInArrow(contexts, schema)
    late = _late(found.select("anchor", "context", F.struct(own, "text", "start").alias("place")))
    return plain.unionByName(late)


def dedup(documents: DataFrame) -> DataFrame:
    """doc (key), n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of ``documents``."""
    ranges = (
        repeated_windows(documents)
        .groupBy(F.struct("doc_id", "text").alias("doc"))
        .agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )
    ranges = stored(ranges, "ranges")
    rows = documents.select(
        document_key().alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")
    )
    whole = rows.limit(0)
    if ranges.count() <= BROADCAST_KEYS:  # only the texts that lose something have to move
        keys = F.broadcast(ranges.select("doc"))
        whole, rows = rows.join(keys, "doc", "left_anti"), rows.join(keys, "doc", "left_semi")
    rows = rows.join(ranges, "doc", "left")

    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, kept: binary>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, lists in batches:
            edges, none = lists.offsets.to_numpy(), lists.is_null().to_pylist()
            firsts, lasts = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = []
            for i, body in enumerate(bodies.to_pylist()):
                own = slice(edges[i], edges[i + 1])
                if none[i] or edges[i] == edges[i + 1]:
                    out.append({"n_removed": 0, "n_spans": 0, "kept": body})
                    continue
                change = np.zeros(len(body) + 1, np.int64)
                np.add.at(change, firsts[own], 1)
                np.add.at(change, lasts[own] + LENGTH - 1, -1)
                gone = change.cumsum()[:-1] > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                left = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append({"n_removed": len(body) - len(left), "n_spans": spans, "kept": left})
            kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
            yield pa.array(out, kind)

    size, none = F.length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    changed = rows.select("doc", size, cut("body", "ranges").alias("_c")).select("doc", "n_bytes", "_c.*")
    return changed.unionByName(
        whole.select("doc", size, none.alias("n_removed"), none.alias("n_spans"), F.col("body").alias("kept"))
    )


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents``.

    Null text has no bytes and the digest of nothing; an empty table has no rows; see ``dedup``.
    """
    return dedup(documents).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
