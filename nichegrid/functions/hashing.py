"""Key-hash uniforms.

``rand(seed)`` depends on how rows are partitioned. A uniform taken from a key hash does
not: it is the same after a repartition, a retry or a rerun on another cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def key_digest(ids: Sequence[str], seed: int | str = "") -> Column:
    """md5 hex digest of the key columns, with the seed appended when given."""
    parts = [F.col(c).cast("string") for c in ids]
    if seed != "":
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("|", *parts) if len(parts) > 1 else parts[0])


def uniform(ids: Sequence[str], seed: int | str = "") -> Column:
    """Uniform double in [0, 1) from the first 32 bits of :func:`key_digest`."""
    head = F.substring(key_digest(ids, seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(_TWO_POW_32)
