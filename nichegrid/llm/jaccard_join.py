"""Joining documents by the Jaccard similarity of their word n-grams, with prefixes of token combinations.

A document's set holds a 64-bit hash (a token) for each distinct run of ``size`` words. Two sets of n and m
tokens link when ``100 * common >= percent * union``, that is when they have at least
``o = ceil(percent * (n + m) / (100 + percent))`` tokens in common; of n tokens, n - o at most are missing.
Equal sets are one node.

First, nodes without any partner go. In an order that all sets share, the first k common tokens of a
linked pair stand among the first (missing + k) tokens of both. A node whose first tokens, by hash, are not
often enough held by another node as well links with nothing.

The tokens of the others are counted and ordered, rare ones first, and dealt to classes: tokens of at most RARE
nodes, of at most OFTEN nodes, and the rest. A rare token of the prefix is a key by itself. Where a prefix
reaches into the frequent tokens, pairs of them are keys in the second class and triples in the third,
among the tokens of one group; there is a group for about GROUP tokens of a set, by hash. The prefix is
extended until it must hold a whole combination: of its tokens so many are common that one group has
two (three) common ones or more, wherever the missing ones are. If x ends its prefix first, all of that
combination lies in the prefix of y as well. Long prefixes are needed only against smaller partners: keys
carry a band of sizes, a set gives the short prefix of the smaller partner for its own band and the
longer one of the larger partner for each band of smaller sets. A key's level, how many missing tokens it is
in the prefix for, then holds two sets to the prefixes of just their sizes.

Sets that share a key are not paired with each other at once: in turns, all meet one drawn from the key,
and the links are verified on the full sets. Where all sets of a key are one component, the key is done.
What turns leave open is paired across components, unless parity sketches show that two sets differ in
too many tokens, and verified, so no link is lost.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichegrid.llm import wordhash
from nichegrid.llm.components import components
from nichegrid.llm.tables import document_key, stored

#: nodes that hold a token of the first and of the second class at most, tokens of a set for one group
RARE, OFTEN, GROUP = 16, 512, 16
#: turns of stars at most, and the share of rows that a turn may leave open to be followed by another
TURNS, WORTH = 8, 0.9
#: how the keys that turns leave open are shared out to the joins that follow each other
PARTS = (1, 3, 12)
#: numbers of 64 bits in a sketch
SKETCH = 16
#: edges of one node that meet a copy of its set
COPIES_FOR = 500
#: bits of the filter that picks texts to be read again, at most (8 MB) and for each of them
FILTER_BITS, BITS_EACH = 1 << 26, 32
LEAST_PERCENT = 80


def missing(n: int, m: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a set of ``m`` it links with can lack."""
    return n + (-percent * (n + m)) // (100 + percent)


def smallest(n: int, percent: int) -> int:
    """The least size that a set of ``n`` tokens can link with."""
    return -(-percent * n // 100)


def looked_at(n: int, percent: int) -> tuple[int, int]:
    """How many first tokens tell whether a set may have a partner, and how many of them it must share."""

    def extension(size: int) -> int:
        return max(size // 10, 1)

    return missing(n, smallest(n, percent), percent) + extension(n), extension(smallest(n, percent))


def _bounds() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 11 // 10))
    return out


#: the least size of each band; a band's sizes differ by a tenth
BOUNDS = _bounds()


def band(n: int) -> int:
    return bisect.bisect_right(BOUNDS, n) - 1


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    for first, last, hashes, bounds in wordhash.words_of_all(texts):
        owner, runs = wordhash.shingles(hashes, bounds, size)
        order = np.lexsort((runs, owner))
        owner, runs = owner[order], runs[order]
        new = np.ones(len(runs), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])
        owner, runs = owner[new], runs[new]
        cuts = np.searchsorted(owner, np.arange(last - first + 1))
        for i in range(last - first):
            yield runs[cuts[i] : cuts[i + 1]]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.uint64).view(np.int64)))


def _firsts(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc, n, digest (null for an empty set), tokens (the first ones that no other set of the batch has),
    met (tokens that several sets of the batch have, each once), shared (how many of those this set has)."""

    @F.arrow_udf("struct<n: bigint, digest: binary, tokens: array<bigint>, met: array<bigint>, shared: int>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            counts, digests, firsts, place = [], [], [], {}
            for i, own in enumerate(_sets(batch.to_pylist(), size)):
                counts.append(len(own))
                digests.append(_digest(own) if len(own) else None)
                new = bool(len(own)) and place.setdefault(digests[-1], i) == i
                firsts.append(own[: looked_at(len(own), percent)[0]].copy() if new else none)
            owner = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            flat = np.concatenate([none, *firsts])
            _, first, back, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            several = (times > 1)[back]
            lead = np.zeros(len(flat), bool)
            lead[first[times > 1]] = True
            shared = np.bincount(owner[several], minlength=len(firsts))
            for i, digest in enumerate(digests):  # copies in the batch share what the first has
                if digest is not None:
                    shared[i] = shared[place[digest]]
            cuts = np.searchsorted(owner, np.arange(len(firsts) + 1))
            spans = [slice(a, b) for a, b in itertools.pairwise(cuts)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists([flat[s][~several[s]] for s in spans]),
                    _lists([flat[s][lead[s]] for s in spans]),
                    pa.array(shared.astype(np.int32)),
                ],
                ["n", "digest", "tokens", "met", "shared"],
            )

    return documents.select(document_key().alias("doc"), look(F.col("text").cast("binary")).alias("_s")).select(
        "doc", "_s.*"
    )


def _possible(firsts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``nodes`` that share enough of their first tokens with others.

    A token that several sets of a batch hold comes once from that batch, so that no token is
    hot; copies of a node in several batches are counted together, which keeps more nodes, never less.
    """
    own = F.xxhash64("digest")
    held = firsts.where("digest is not null")
    rows = held.select(F.explode("tokens").alias("token"), own.alias("node")).unionByName(
        held.select(F.explode("met").alias("token"), F.lit(None).cast("long").alias("node"))
    )
    same = Window.partitionBy("token")
    several = (F.min("node").over(same) != F.max("node").over(same)) | (
        F.count("*").over(same) > F.count("node").over(same)
    )
    hits = (
        rows.withColumn("several", several).where("several and node is not null").groupBy("node").agg(F.count("*").alias("hits"))
    )

    @F.arrow_udf("bigint")
    def needed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([looked_at(n, percent)[1] for n in batch.to_pylist()], pa.int64())

    counted = nodes.withColumn("node", own).join(hits, "node", "left")
    return counted.where(F.coalesce("hits", F.lit(0)) + F.col("shared") >= needed("n")).drop("hits", "node", "shared")


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit filter of the column ``key``; its size is bounded, whatever the number of keys."""
    n, size = keys.count(), 1 << 10
    while size < min(n * BITS_EACH, FILTER_BITS):
        size *= 2
    words = (
        keys.groupBy(F.shiftright(F.col("key").bitwiseAND(F.lit(size - 1)), 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 64, np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH numbers whose bits say for an odd or even number of tokens; each token that only one of two sets holds
    turns one bit, so two sets differ in as many tokens as their sketches differ in bits, or more."""
    bits = np.bincount((wordhash.mixed(own) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.uint64)


def _reread(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """id, n, own, sketch: the sets of ``nodes`` (id, doc, digest, n), from the text of their first document.

    A bit filter of the documents spares the others the shuffle; the join is exact.
    """
    bits = _bits(nodes.select(F.xxhash64("doc").alias("key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(len(bits) * 8 - 1)
            wanted = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            rows = np.flatnonzero(wanted)
            for part in np.array_split(rows, len(rows) // 256 + 1):
                own = [s for s in _sets(batch.column(1).take(pa.array(part)).to_pylist(), size)] if len(part) else []
                own = [s for s in own if len(s)]
                if own:
                    digests = pa.array([_digest(s) for s in own], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [digests, _lists(own), _lists([sketch(s) for s in own])], names=["digest", "own", "sketch"]
                    )

    blobs = documents.select(F.xxhash64(document_key()).alias("key"), F.col("text").cast("binary").alias("text"))
    found = blobs.mapInArrow(read, "digest binary, own array<bigint>, sketch array<bigint>").dropDuplicates(["digest"])
    return found.join(nodes.select("digest", "id", "n"), "digest").select("id", "n", "own", "sketch")


def _frequent_keys(
    tokens: np.ndarray, often: np.ndarray, need: int, groups: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, levels) of combinations of frequent tokens, the prefix being extended until one must be common.

    The level is how many missing tokens the combination's last one is needed for.
    """
    held: dict[tuple[int, int], list[int]] = {}
    of = (wordhash.mixed(tokens) % np.uint64(groups)).tolist()
    spare, level, levels = 0, 0, []
    for i, (group, many) in enumerate(zip(of, often.tolist(), strict=True)):
        level = max(level, i - spare)
        if level > need:
            break
        levels.append(level)
        k = 3 if many else 2
        own = held.setdefault((k, group), [])
        if not own:
            spare += k - 1
        own.append(i)
    out = []
    for k in (2, 3):
        combos = [c for (size, _), own in held.items() if size == k for c in itertools.combinations(own, k)]
        if combos:
            places = np.array(combos)
            picked = tokens[places]
            key = picked[:, 0]
            for i in range(1, k):
                key = wordhash.mixed(key) + picked[:, i]
            out.append((key, np.array(levels)[places[:, -1]]))
    return out


def keys_of(
    n: int, tokens: np.ndarray, nodes: np.ndarray, percent: int
) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether they look for smaller partners, keys, levels) of a set of ``n`` tokens.

    ``tokens`` are those that several nodes hold, in order; ``nodes`` says how many. The other tokens come
    first and give no keys. A key of level l is in the prefix when l tokens or more may be missing.
    """
    alone, rare = n - len(tokens), int(np.searchsorted(nodes, RARE, side="right"))
    if len(tokens) < smallest(n, percent):
        return []
    out = []
    low = smallest(n, percent)
    roles = [(False, band(n), n)]
    roles += [(True, b, max(BOUNDS[b], low)) for b in range(band(low), band(n) + 1)]
    for probe, b, partner in roles:
        lost = missing(n, partner, percent)
        single = tokens[: max(min(rare, lost + 1 - alone), 0)]
        keys = [(single, alone + np.arange(len(single)))]
        if alone + rare <= lost:
            more = _frequent_keys(tokens[rare:], nodes[rare:] > OFTEN, lost - alone - rare, 1 + BOUNDS[b] // GROUP)
            keys += [(key, alone + rare + level) for key, level in more]
        salt = wordhash.mixed(np.array([b + 1], np.uint64))
        key, level = (np.concatenate(x) for x in zip(*keys, strict=True))
        key = wordhash.mixed(key ^ salt)
        order = np.lexsort((level, key))
        key, level = key[order], level[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        out.append((probe, key[first], level[first]))
    return out


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """key, probe, level, n, shared (tokens that others hold too), id: the prefixes' keys of every set."""
    tokens = sets.select("id", F.explode("own").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1")
    counts = stored(counts, "token-counts")
    ordered = (
        tokens.join(counts, "token")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("nodes", "token"))).alias("tokens"))
    )
    wide = sets.select("id", "n").join(ordered, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = (batch.column(i).to_pylist() for i in (0, 1))
            lists = batch.column(2)
            edges = lists.offsets.to_numpy()
            nodes, tokens = (lists.values.field(i).to_numpy() for i in (0, 1))
            tokens = tokens.view(np.uint64)
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, (own, n) in enumerate(zip(ids, ns, strict=True)):
                span = slice(edges[i], edges[i + 1])
                for probe, keys, levels in keys_of(n, tokens[span], nodes[span], percent):
                    values = (keys.view(np.int64), probe, levels, n, edges[i + 1] - edges[i], own)
                    for column, value in zip(columns, values, strict=True):
                        column.append(np.broadcast_to(value, len(keys)))
            if columns[0]:
                flat = [np.concatenate(c) for c in columns]
                flat = [flat[0], flat[1].astype(bool), *(c.astype(np.int64) for c in flat[2:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in flat], names=["key", "probe", "level", "n", "shared", "id"]
                )

    schema = "key long, probe boolean, level long, n long, shared long, id long"
    return wide.select("id", "n", "tokens").mapInArrow(cut, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links a, b among stored ``pairs`` of ids, on the full sets; a set with many pairs is copied."""

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            ends = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (left, right)]
            out = []
            for i in range(len(left)):
                one, two = (values[edges[i] : edges[i + 1]] for edges, values in ends)
                both = len(np.intersect1d(one, two, assume_unique=True))
                out.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.array(out, pa.bool_())

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / COPIES_FOR).cast("int").alias("copies")).where("copies > 1")
    many = stored(many, "crowded-sets")  # a table of its own, so that a crowded key of the join is split
    dealt = pairs.join(many, "a", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    here = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a")).join(many, "a", "left")
    copies = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    here = here.select("a", "own_a", F.explode(copies).alias("copy"))
    there = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    return dealt.join(there, "b").join(here, ["a", "copy"]).where(alike("own_a", "own_b")).select("a", "b")


def _least(percent: int) -> Column:
    """The tokens that sets x and y have in common at least if they link."""
    return F.expr(f"((x.n + y.n) * {percent} + {99 + percent}) div {100 + percent}")


def _differ_little(percent: int) -> Column:
    """Whether the sketches of x and y leave room for a link."""
    bits = [F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i)))) for i in range(SKETCH)]
    return reduce(lambda a, b: a + b, bits) <= F.col("x.n") + F.col("y.n") - 2 * _least(percent)


def _fits(percent: int) -> Column:
    """Whether index entry x and probe entry y can link: the smaller looks up the larger, the key is in both prefixes
    for just these sizes, and what others hold of both is enough."""
    least = _least(percent)
    larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") != F.col("y.id")))
    in_prefix = (F.col("x.level") + least <= F.col("x.n")) & (F.col("y.level") + least <= F.col("y.n"))
    return larger & in_prefix & (F.least("x.shared", "y.shared") >= least)


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """a, b (ids) of the members x and y of ``found`` that can link."""
    return found.where(_fits(percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _stars(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of one set of each key, drawn by a hash of its id and the turn, with the key's other components.

    A set that is drawn to be looked up meets larger ones, one that looks up meets smaller ones.
    """
    drawn = F.struct(F.xxhash64("member.id", F.lit(turn)).alias("draw"), "member", "component")
    hubs = placed.groupBy("key").agg(
        F.min(F.when(~F.col("probe"), drawn)).alias("low"), F.min(F.when(F.col("probe"), drawn)).alias("high")
    )
    met = placed.join(hubs, "key")
    above = met.where("probe and component <> low.component").select(F.col("low.member").alias("x"), F.col("member").alias("y"))
    below = met.where("not probe and component <> high.component").select(F.col("member").alias("x"), F.col("high.member").alias("y"))
    return _pairs(above.unionByName(below), percent)


def _open(placed: DataFrame) -> DataFrame:
    """The rows of keys that a set of another component can still be found by."""
    ends = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("greatest"))
    return placed.join(ends.where("least <> greatest").select("key"), "key")


def _all_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that share a key and can link."""
    members = placed.join(sets.select("id", "sketch"), F.col("member.id") == F.col("id")).drop("id")
    members = stored(members, "open-members")
    x, y = (
        members.where(F.col("probe") == probes).select(
            "key", F.col("member").alias(side), F.col("component").alias(f"of_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        for side, probes in (("x", False), ("y", True))
    )
    found = x.join(y, "key").where((F.col("of_x") != F.col("of_y")) & _differ_little(percent))
    return _pairs(found, percent).distinct()


def _linked(sets: DataFrame, percent: int) -> DataFrame | None:
    """node, component of the ids that link with another; None where none can.

    In turns, the sets of a key meet one of them, and keys that are one component then are done. When turns no
    longer settle much, what is left is joined key by key.
    """
    entries = stored(_entries(sets, percent), "prefix-keys")
    useful = entries.groupBy("key").agg(
        F.min("probe").alias("looked_up"), F.max("probe").alias("asks"), F.min("id").alias("least"), F.max("id").alias("greatest")
    )
    useful = useful.where("not looked_up and asks and least <> greatest").select("key")
    member = F.struct("n", "id", "shared", "level").alias("member")
    placed = entries.join(useful, "key").select("key", "probe", member, F.col("id").alias("component"))
    placed = stored(placed, "placed-keys")
    known, rows = None, placed.count()

    def settle(pairs: DataFrame) -> None:
        """Adds the links among ``pairs`` to what is known, and leaves the keys of several components."""
        nonlocal known, placed, rows
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            found = _verified(pairs, sets, percent)
            if known is not None:
                found = found.unionByName(known.select(F.col("component").alias("a"), F.col("node").alias("b")))
            known = stored(components(found), "components")
            named = known.withColumnsRenamed({"node": "of", "component": "now"})
            placed = placed.join(named, F.col("member.id") == F.col("of"), "left")
            placed = placed.select("key", "probe", "member", F.coalesce("now", "component").alias("component"))
        placed = stored(_open(placed), "open-keys")
        rows = placed.count()

    for turn in range(TURNS):
        if not rows:
            return known
        before = rows
        settle(_stars(placed, turn, percent).distinct())
        if rows > before * WORTH:
            break
    # some keys first: what they link need not be found again by the others
    for share in range(len(PARTS)):
        if not rows:
            return known
        done = F.pmod(F.xxhash64("key"), F.lit(sum(PARTS)))
        now = placed.where(done < sum(PARTS[: share + 1]))
        placed = placed.where(done >= sum(PARTS[: share + 1]))
        settle(_all_pairs(now, sets, percent))
    return known


def joined(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents``: doc (its key), n_shingles, first (the key of its component's first).

    The first has the smallest doc_id that links lead to; a missing id is smaller than any. A text without
    words, or null, links with nothing; one of fewer than ``size`` words is one run. Repeated rows are one document.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100")
    firsts = stored(_firsts(documents, size, percent), "first-tokens")
    nodes = firsts.where("digest is not null").groupBy("digest").agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.max("shared").alias("shared")
    )
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    possible = stored(_possible(firsts, nodes, percent), "possible-nodes")
    linked = None
    if not possible.isEmpty():
        linked = _linked(stored(_reread(documents, possible, size), "sets"), percent)
    placed = nodes.select("digest", "doc", F.col("id").alias("component"))
    if linked is not None:
        placed = nodes.select("digest", "doc", "id").join(linked, F.col("id") == F.col("node"), "left")
        placed = placed.select("digest", "doc", F.coalesce("component", "id").alias("component"))
    first = placed.groupBy("component").agg(F.min("doc").alias("first"))
    named = placed.join(first, "component").select("digest", "first")
    rows = firsts.select("doc", "n", "digest").join(named, "digest", "left")
    return rows.select(
        "doc", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("first")).alias("first")
    )


def judge(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for every row; see ``joined``."""
    return joined(documents, size, percent).select(
        F.col("doc.doc_id").alias("doc_id"), "n_shingles", F.col("first.doc_id").alias("component_id")
    )
