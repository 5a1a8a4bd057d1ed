"""Sharding by a lookup table that the shards fill in turns.

Every shard prefers the slots of a prime-sized table in an order of its own (a start and a step from
its name's hash). The shards take turns; each claims its next preferred slot that is free, until the
table is full. So every shard owns its fair share of slots to within one, and when a shard comes or
goes few keys move between the others. Placing a row is one hash and one lookup in the table, which
has a fixed number of rows whatever the data, and is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: prime, and over a hundred slots for each of the default shards
SIZE = 4099
SHARDS = tuple(f"shard-{i}" for i in range(40))
LARGEST = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names, each once")
    if not len(shards) < size <= LARGEST or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table needs a prime size above the number of shards and up to {LARGEST}")
    order = [(_number(f"{s}/start") % size, _number(f"{s}/step") % (size - 1) + 1) for s in shards]
    owner, turn = [-1] * size, [0] * len(shards)
    for claim in range(size):
        shard = claim % len(shards)
        start, step = order[shard]
        slot = (start + turn[shard] * step) % size
        while owner[slot] >= 0:
            turn[shard] += 1
            slot = (start + turn[shard] * step) % size
        owner[slot] = shard
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = SIZE) -> DataFrame:
    """slot, shard: one row per slot, unfolded from a literal."""
    owners = F.split(F.lit(",".join(shards[i] for i in fill(shards, size))), ",")
    if any("," in name for name in shards):
        raise ValueError("a shard's name holds no comma")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """60 bits of the key's md5, modulo the table's size."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(
    documents: DataFrame, shards: Sequence[str] = SHARDS, size: int = SIZE, key: str = "doc_id"
) -> DataFrame:
    """``documents`` with ``slot`` and ``shard`` (columns of these names are replaced); no shuffle.

    Equal keys share a shard. A row without a key is placed by its text, so that such rows do not
    pile up in one shard; without text too, it counts as the empty text.
    """
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    rows = documents.drop("slot", "shard").withColumn("slot", slot_of(own, size))
    return rows.join(F.broadcast(lookup_table(documents.sparkSession, shards, size)), "slot").select(
        *(c for c in rows.columns if c != "slot"), "slot", "shard"
    )
