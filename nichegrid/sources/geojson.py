"""GeoJSON documents of any size, read by ranges.

Spark cuts a document at closing braces, so every range of a file gives whole fragments to one task. What
a range means depends on how it begins: inside a string or not, and how deep. Two light passes settle that.
The first gives, for each range, how the depth changes and whether it ends inside a string, for both ways to
begin; added up in order, a few numbers per range, that says how every range begins. The second names the
member of the document that a range begins in. A third pass then writes out features, which are the
objects in the array ``features``, and the object ``crs``; those that a border cuts are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.session import scratch_path

FEATURE_SCHEMA = (
    "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
)
#: bytes looked at in one go
_LOT = 1 << 22
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
_OPEN, _CLOSE, _QUOTE, _BACKSLASH = (0x7B, 0x5B), (0x7D, 0x5D), 0x22, 0x5C
_FEATURES, _CRS = "features", "crs"


@dataclass(frozen=True)
class Start:
    """How a range begins: inside a string, at a depth, and in which member of the document."""

    inside: bool
    depth: int
    member: str | None = None


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bool]]:
    """(file, range, bytes, whether the last fragment is blank) in order; fragments get their brace back."""
    key, held, size = None, [], 0
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != key or size >= _LOT:
                if held:
                    yield *key, b"".join(held), held[-1][:-1].isspace()
                key, held, size = (file, block), [], 0
            held.append(value.encode() + b"}")
            size += len(value) + 1
    if held:
        yield *key, b"".join(held), held[-1][:-1].isspace()


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Brackets of a lot that does not end in a backslash: their places, +1 or -1, whether they stand inside a
    string if the lot begins outside of one, and how many quotes there are."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    slashes = raw == _BACKSLASH
    if len(quotes) and slashes.any():
        plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(raw))))
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    places = np.flatnonzero(np.isin(raw, [*_OPEN, *_CLOSE]))
    signs = np.where(np.isin(raw[places], _OPEN), 1, -1)
    return places, signs, np.searchsorted(quotes, places) % 2 == 1, len(quotes)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, nth, outside, inside, quotes, blank`` of every lot: the change of depth for both beginnings."""
    nth: dict = {}
    for file, block, data, blank in _lots(batches):
        _, signs, within, quotes = structure(data)
        nth[file, block] = nth.get((file, block), -1) + 1
        row = {
            "file": file, "block": block, "nth": nth[file, block], "outside": int(signs[~within].sum()),
            "inside": int(signs[within].sum()), "quotes": quotes, "blank": blank,
        }
        yield pa.RecordBatch.from_pylist([row])


_CHANGES = "file string, block long, nth long, outside long, inside long, quotes long, blank boolean"


def _beginnings(fragments: DataFrame) -> dict[tuple[str, int], Start]:
    """How every range begins; a document that does not end as it began is an error."""
    rows = fragments.mapInArrow(_changes, _CHANGES).collect()  # a row for some megabytes of text
    starts, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["nth"])):
        inside, depth, _ = ends.get(r["file"], (False, 0, False))
        if r["nth"] == 0:
            starts[r["file"], r["block"]] = Start(inside, depth)
        change = r["inside"] if inside else r["outside"]
        ends[r["file"]] = (inside ^ (r["quotes"] % 2 == 1), depth + change, r["blank"])
    for file, (inside, depth, blank) in ends.items():
        # blank text after the document got a brace that is not there
        if inside or depth != (-1 if blank and depth < 0 else 0):
            raise ValueError(f"{file} is not a whole JSON document")
    return starts


def _located(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[tuple]:
    """(file, range, whether it begins, its start, bytes, places, depth before, sign) of every lot."""
    key, inside, depth = None, False, 0
    for file, block, data, _ in _lots(batches):
        begins = (file, block) != key
        if begins:
            key = file, block
            if key not in starts:
                raise ValueError(f"{file} was cut into other ranges than before")
            inside, depth = starts[key].inside, starts[key].depth
        places, signs, within, quotes = structure(data)
        real = within == inside
        places, signs = places[real], signs[real]
        after = depth + signs.cumsum()
        yield file, block, begins, starts[key], data, places, after - signs, signs
        depth, inside = int(after[-1]) if len(after) else depth, inside ^ (quotes % 2 == 1)


def _members(fragments: DataFrame, starts: dict) -> dict[tuple[str, int], Start]:
    """The ranges' beginnings with the member of the document they begin in."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, _, _, data, places, depth, signs in _located(batches, starts):
            for at in places[(depth == 1) & (signs == 1)]:
                found = _KEY.search(data, max(0, at - 512), at)
                name = found.group(1).decode() if found else ""
                yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "member": name}])

    rows = fragments.mapInArrow(find, "file string, block long, member string")
    last = rows.withColumn("nth", F.monotonically_increasing_id()).groupBy("file", "block").agg(
        F.max_by("member", "nth").alias("member")
    )
    named = {(r["file"], r["block"]): r["member"] for r in last.collect()}  # a row per range
    out, member, of = {}, None, None
    for key in sorted(starts):
        if key[0] != of:
            member, of = None, key[0]
        out[key] = Start(starts[key].inside, starts[key].depth, member)
        member = named.get(key, member)
    return out


def _objects(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
    """``file, block, member, part, text``: whole objects (part 0), ends of one that began before the range (1),
    what lies inside a longer one (2) and beginnings (3)."""
    rows: list[dict] = []
    held: list[bytes] = []
    file = block = member = None
    begun = False

    def put(part: int) -> None:
        rows.append({"file": file, "block": block, "member": member, "part": part, "text": b"".join(held).decode()})
        held.clear()

    def is_inside(depth: int) -> bool:
        return depth >= {_FEATURES: 3, _CRS: 2}.get(member, 1 << 30)

    inside = False
    for here, at_block, begins, start, data, places, depth, signs in _located(batches, starts):
        if begins:
            if inside:
                put(3 if begun else 2)
            file, block, member, begun = here, at_block, start.member, False
            inside = is_inside(start.depth)
        cut = 0
        # only what opens or closes a member or an object in the array matters
        for i in np.flatnonzero(np.minimum(depth, depth + signs) <= 2):
            at, before, sign = int(places[i]), int(depth[i]), int(signs[i])
            if sign > 0 and before == 1:
                found = _KEY.search(data, max(0, at - 512), at)
                member = found.group(1).decode() if found else ""
            was, now = inside, is_inside(before + sign)
            if now and not was:
                inside, begun, cut = True, True, at
            elif was and not now:
                held.append(data[cut : at + 1])
                put(0 if begun else 1)
                inside = False
        if inside:
            held.append(data[cut:])
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, _OBJECT_FIELDS)
            rows.clear()
    if inside:
        put(3 if begun else 2)
    yield pa.RecordBatch.from_pylist(rows, _OBJECT_FIELDS)


_OBJECT_FIELDS = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("member", pa.string()), ("part", pa.int32()), ("text", pa.string())]
)
_OBJECTS = "file string, block long, member string, part int, text string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, feature (type, geometry, properties), crs (text)`` of every feature of the documents.

    A document that ends early or a feature that is not JSON stops the job.
    """
    fragments = _fragments(spark, path)
    starts = _members(fragments, _beginnings(fragments))
    # written out: the pieces, the coordinate system and the features would each read the documents again
    stored = scratch_path(spark, "geojson")
    fragments.mapInArrow(lambda batches: _objects(batches, starts), _OBJECTS).write.parquet(stored)
    found = spark.read.schema(_OBJECTS).parquet(stored)
    # an object that a border cuts: a beginning, then what follows up to the next beginning
    pieces = found.where("part > 0").withColumn(
        "nth", F.expr("count(if(part = 3, 1, null)) over (partition by file order by block, part)")
    )
    joined = pieces.groupBy("file", "nth").agg(
        F.max("member").alias("member"),
        F.expr("array_join(transform(array_sort(collect_list(struct(block, part, text))), p -> p.text), '')").alias("text"),
    )
    objects = found.where("part = 0").select("file", "member", "text").unionByName(joined.drop("nth"))
    crs = objects.where(F.col("member") == _CRS).groupBy("file").agg(F.min("text").alias("crs"))
    parsed = F.from_json("text", FEATURE_SCHEMA, {"mode": "FAILFAST"}).alias("feature")
    return objects.where(F.col("member") == _FEATURES).select("file", parsed).join(crs, "file", "left")
