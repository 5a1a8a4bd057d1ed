"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates.

A document's set has a 64-bit hash for each distinct run of ``size`` words. One hash function deals the
set into bins; a bin's value is its least hash. An empty bin copies the value of a bin that a hash
of (bin, attempt) picks, trying again until that one is not empty: the optimal densification, which
keeps the chance that two sets agree in a bin at their similarity. Bins are joined to bands; documents
that agree in a whole band share a bucket. The number of bands follows from the similarity: a pair at
the threshold shares no bucket with probability ``MISS`` at most.

Documents with equal sets are one node. In a bucket the nodes are not paired with each other: all
point at one hub, the node that shares most buckets overall, and the edges are confirmed on the full
sets. A bucket whose nodes are then in one component is settled. What a star cannot see, a link between
two nodes of an open bucket that the hub is not linked with, is found by an exact prefix filter over
the nodes of the open buckets, so no link between different texts is lost to the star.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichegrid.llm import wordhash
from nichegrid.llm.components import components
from nichegrid.llm.tables import document_key, stored

ROWS = 5
MISS = 1e-6
#: edges of one hub that meet a copy of its set
HUB_EDGES = 500


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands of ``rows`` bins, so that a pair at the threshold misses all with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))


def donors(empty: np.ndarray) -> np.ndarray:
    """For every bin the bin whose value it takes: itself, or the first non-empty one it tries."""
    n = len(empty)
    at = np.arange(n)
    open_, attempt = np.flatnonzero(empty), 1
    if len(open_) == n:
        return at
    while len(open_):
        tried = wordhash.mixed(open_.astype(np.uint64) * np.uint64(0x1000193) + np.uint64(attempt << 32))
        pick = (tried % np.uint64(n)).astype(np.int64)
        at[open_] = pick
        open_, attempt = open_[empty[pick]], attempt + 1
    return at


def signature(distinct: np.ndarray, bins: int) -> np.ndarray:
    """The densified one-permutation signature of a sorted set of hashes."""
    scrambled = wordhash.mixed(distinct ^ np.uint64(0x5851F42D4C957F2D))
    where = ((scrambled >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, where, scrambled)
    filled = np.zeros(bins, bool)
    filled[where] = True
    return least[donors(~filled)]


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
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


def _binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _signed(documents: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc, n_shingles, node (a digest of the set, null if empty), keys (a bucket for each band)."""

    @F.arrow_udf("struct<n_shingles: bigint, node: binary, keys: array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            counts, nodes, keys = [], [], []
            for own in _sets(batch.to_pylist(), size):
                counts.append(len(own))
                if not len(own):
                    nodes.append(None)
                    continue
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                bins = signature(own, bands * rows).reshape(bands, rows)
                key = number
                for i in range(rows):
                    key = wordhash.mixed(key * np.uint64(0x9E3779B97F4A7C15) + bins[:, i])
                keys.append(key.view(np.int64))
            missing = np.array([n is None for n in nodes], bool)
            sizes = np.concatenate([[0], np.where(missing, 0, bands).cumsum()]).astype("int32")
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), _binary(nodes), lists], ["n_shingles", "node", "keys"]
            )

    return documents.select(document_key().alias("doc"), sign(F.col("text").cast("binary")).alias("_s")).select(
        "doc", "_s.*"
    )


def _set_of(documents: DataFrame, size: int) -> DataFrame:
    @F.arrow_udf("binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _binary([own.tobytes() for own in _sets(batch.to_pylist(), size)])

    return documents.select("node", sets(F.col("text").cast("binary")).alias("own"))


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``a`` (hub), ``b`` with ``100 * |A and B| >= percent * |A or B|``, on the full sets."""

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                out.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.array(out, pa.bool_())

    # a hub with many edges is copied once for every HUB_EDGES of them
    copies = edges.groupBy("a").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("copies"))
    dealt = edges.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    hubs = copies.join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", F.col("own").alias("hub_set"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    return (
        dealt.select("a", "b", "copy")
        .join(sets.withColumnRenamed("node", "b"), "b")
        .join(hubs, ["a", "copy"])
        .where(alike("hub_set", "own"))
        .select("a", "b")
    )


def groups(documents: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row per row of ``documents``: doc (its key), n_shingles, first (the key of its group's first).

    The first has the smallest doc_id that links lead to; a missing id is smaller than any. A text
    without words, or null, is linked with nothing. Repeated rows are one document.
    """
    bands = bands_for(percent, rows)
    signed = stored(_signed(documents, size, bands, rows), "signatures")
    nodes = stored(
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc").alias("doc"),
            F.first("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
        ),
        "nodes",
    )
    found = _links(documents, nodes, size, percent)
    member = nodes.select("node", "doc", F.col("node").alias("component"))
    if found is not None:
        member = nodes.select("node", "doc").join(found, "node", "left")
        member = member.withColumn("component", F.coalesce("component", "node"))
    first = member.groupBy("component").agg(F.min("doc").alias("first"))
    named = member.join(first, "component").select("node", "first")
    return signed.join(named, "node", "left").select(
        "doc", "n_shingles", F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("first")).alias("first")
    )


def _links(documents: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """node, component of the nodes that are linked with another; None without candidates."""
    buckets = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = stored(buckets.join(shared, "bucket"), "buckets")
    if members.isEmpty():
        return None
    degree = members.groupBy("node").agg(F.sum("held").alias("degree"))
    members = stored(
        members.join(degree, "node").select("bucket", F.struct("degree", "node", "n").alias("member")), "members"
    )
    wanted = members.select("member.node").distinct().join(nodes, "node").select("node", "doc")
    texts = documents.select(document_key().alias("doc"), "text").join(wanted, "doc")
    sets = stored(_set_of(texts, size).dropDuplicates(["node"]), "sets")

    hubs = members.groupBy("bucket").agg(F.max("member").alias("hub"))
    pairs = members.join(hubs, "bucket").where("member <> hub").select(F.col("hub").alias("x"), F.col("member").alias("y"))
    linked = _more(pairs, sets, percent, None)
    placed = members.withColumn("node", F.col("member.node"))
    if linked is None:
        placed = placed.withColumn("component", F.col("node"))
    else:
        placed = placed.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("greatest"))
    mixed = mixed.where("least <> greatest").select("bucket")
    open_ = placed.join(mixed, "bucket").select("member", "node", "component").distinct()
    return _more(_prefix_pairs(stored(open_, "open-nodes"), sets, percent), sets, percent, linked)


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs x, y of different components that can still be linked, by the prefix filter.

    Two sets of n and m hashes at the threshold share at least ``o = percent * (n + m) / (100 + percent)``,
    so the n - o + 1 rarest of the one and the m - o + 1 rarest of the other have one in common. A copy
    with many changes of its own has nothing but those there, and meets nobody.
    """

    @F.arrow_udf("array<bigint>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1]
            flat = np.frombuffer(batch.buffers()[2], np.int64)[offsets[0] // 8 : offsets[-1] // 8]
            yield pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 8), pa.array(flat))

    hashes = nodes.join(sets, "node").select("member", "node", "component", F.explode(numbers("own")).alias("hash"))
    hashes = stored(hashes, "open-hashes")
    often = hashes.groupBy("hash").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("node").orderBy("often", "hash")
    n = F.col("member.n")
    prefix = (
        hashes.join(often.where("often > 1"), "hash", "left")
        .withColumn("often", F.coalesce("often", F.lit(1)))
        .withColumn("place", F.row_number().over(rarest))
        .where((F.col("place") <= n - F.ceil(n * percent / 100) + 1) & (F.col("often") > 1))
        .select("hash", "place", "member", "component")
    )
    prefix = stored(prefix, "prefixes")
    mixed = prefix.groupBy("hash").agg(F.min("component").alias("least"), F.max("component").alias("greatest"))
    left = prefix.join(mixed.where("least <> greatest").select("hash"), "hash")
    right = left.select("hash", F.col("place").alias("at"), F.col("member").alias("x"), F.col("component").alias("of"))
    least = F.ceil((F.col("x.n") + F.col("member.n")) * percent / (100 + percent))
    near = (F.col("at") <= F.col("x.n") - least + 1) & (F.col("place") <= F.col("member.n") - least + 1)
    other = (F.col("member") < F.col("x")) & (F.col("component") != F.col("of"))
    return left.join(right, "hash").where(other & near).select("x", F.col("member").alias("y"))


def _more(pairs: DataFrame, sets: DataFrame, percent: int, linked: DataFrame | None) -> DataFrame | None:
    """The components once the links among ``pairs`` of members are added to those known."""
    fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    edges = stored(
        pairs.where(fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "edges"
    )
    if edges.isEmpty():
        return linked
    links = confirmed(edges, sets, percent)
    if linked is not None:  # what is known so far, as links from each node to its component's smallest
        links = links.unionByName(linked.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return stored(components(links), "components")


def judge(documents: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the row has its group's smallest id) per row."""
    return groups(documents, size, percent).select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_shingles",
        F.col("first.doc_id").alias("component_id"),
        F.col("doc.doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"),
    )


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one document of each group, its first; columns stay as they are."""
    gone = groups(documents, size, percent).where("doc <> first").select("doc").distinct()
    rows = documents.select(F.struct(*documents.columns).alias("row"), document_key().alias("doc"))
    return rows.join(gone, "doc", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))
