"""Which documents hold whole windows of benchmark items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A
document holds a window where its words stand in the same order without a gap.

The join follows the prefix filter: a window is the set of its shingles (three words, each with its
place; fewer only for windows that are shorter), and a document must hold all of them, so one
necessary shingle is a sufficient prefix. Shingles are ordered by how often the documents hold them
and every window is joined by its rarest. The window's place must fit inside the document (length
and positional bounds), and all its shingles must then be found at their places, which is exact
containment, since shingles are compared as words.

Only DataFrame functions are used. Documents are read and cut into words once; what goes on from
there are the places that hold a shingle of some item, and one row with the number of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.tables import document_key, lower_ascii, stored

WINDOW = 10
SHINGLE = 3
#: item shingles up to this number are broadcast (some 100 bytes each); beyond, both sides are shuffled
BROADCAST_SHINGLES = 300_000
#: keys that the rows standing for whole documents are dealt over
LEADS = 1024
_OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    split = F.split(lower_ascii(text), _OTHER)
    # only the first and the last part of a split can be empty
    from_ = F.when(F.get(split, F.lit(0)) == "", 2).otherwise(1)
    to = F.size(split) - F.when(F.element_at(split, -1) == "", 1).otherwise(0)
    return F.coalesce(F.slice(split, from_, F.greatest(to - from_ + 1, F.lit(0))), F.array().cast("array<string>"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (the window's words): the distinct windows of all items. Null texts have none."""
    w = F.col("w")
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return (
        items.select("item_id", words(F.col("text")).alias("w"))
        .where(n > 0)
        .select("item_id", "w", F.explode(starts).alias("start"))
        .select("item_id", F.slice(w, F.col("start"), F.lit(window)).alias("win"))
        .distinct()
    )


def _shingles(wins: DataFrame) -> DataFrame:
    """win_id, size, place and the shingle's words for every place of a window."""
    win = F.col("win")
    size = F.size(win)
    places = F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0)))
    return wins.select("win_id", size.alias("size"), win, F.explode(places).alias("place")).select(
        "win_id", "size", "place", F.slice(win, F.col("place") + 1, F.lit(SHINGLE)).alias("shingle")
    )


def _keyed(size: Column, words_of: list[Column]) -> Column:
    return F.xxhash64(size, *words_of)


def shingle_places(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """doc (key), at, shingle, room: every place where a document holds a shingle of ``parts``, and how many words
    are left from there; with ``at`` -1 and an empty shingle one row per row of ``documents``, its words.

    A text is read and cut once. Places are looked up by hash, then compared as words.
    """
    # few, whatever the items: shingles are shorter only in windows that are
    lengths = sorted(r[0] for r in parts.select(F.size("shingle")).distinct().collect()) or [SHINGLE]
    distinct = parts.select("shingle").distinct()
    by_word = [F.get("shingle", F.lit(i)) for i in range(SHINGLE)]
    keys = [F.when(F.size("shingle") == n, _keyed(F.lit(n), by_word[:n])) for n in lengths]
    known = distinct.select("shingle", F.coalesce(*keys).alias("hash"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(LEADS - 1))).alias("lead")
    leads = documents.sparkSession.range(1).select(spread).select(
        F.array().cast("array<string>").alias("shingle"), F.xxhash64(F.lit("document"), "lead").alias("hash")
    )
    few = distinct.count() <= BROADCAST_SHINGLES
    known = known.unionByName(leads)

    cut = documents.select(document_key().alias("doc"), words(F.col("text")).alias("w"))
    lead = F.xxhash64(F.lit("document"), F.pmod(F.xxhash64("doc"), F.lit(LEADS)).cast("int"))
    # the row before the first word stands for the document
    here = cut.select("doc", "w", lead.alias("lead"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    here = here.withColumn("at", F.col("at") - 1)
    room = F.size("w") - F.greatest("at", F.lit(0))
    following = [F.col("word"), *(F.get("w", F.col("at") + i) for i in range(1, SHINGLE))]
    hashes = [F.when(room >= n, _keyed(F.lit(n), following[:n])) for n in lengths]
    own = F.when(F.col("at") < 0, F.col("lead"))
    if len(lengths) == 1:
        place = here.withColumn("hash", own.otherwise(hashes[0]))
    else:
        several = F.filter(F.array(*hashes), lambda h: h.isNotNull())
        place = here.withColumn("hash", F.explode(F.when(F.col("at") < 0, F.array("lead")).otherwise(several)))
    room = room.alias("room")
    if few:
        same = F.slice("w", F.greatest("at", F.lit(0)) + 1, F.size("shingle")) == F.col("shingle")
        return place.join(F.broadcast(known), "hash").where(same).select("doc", "at", "shingle", room)
    # the words of the place travel, not those of the text
    ahead = F.slice("w", F.greatest("at", F.lit(0)) + 1, F.lit(SHINGLE)).alias("ahead")
    moved = place.where("hash is not null").select("doc", "at", "hash", room, ahead).join(known, "hash")
    same = F.slice("ahead", F.lit(1), F.size("shingle")) == F.col("shingle")
    return moved.where(same).select("doc", "at", "shingle", "room")


def _found(documents: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The stored places of shingles, and doc, item_id, start, size of the windows that are there."""
    owned = stored(windows_of(items, window), "item-windows")
    wins = owned.select("win").distinct().withColumn("win_id", F.md5(F.to_json(F.struct("win")).cast("binary")))
    parts = stored(_shingles(wins), "item-shingles")
    places = stored(shingle_places(documents, parts), "shingle-places")
    hits = places.where("at >= 0")

    often = hits.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = parts.join(often, "shingle")  # a window with a shingle that no document holds has no occurrence
    complete = F.count("*") == F.greatest(F.first("size") - SHINGLE + 1, F.lit(1))
    prefix = stored(
        ranked.groupBy("win_id", "size")
        .agg(F.min(F.struct("often", "place", "shingle")).alias("rarest"), complete.alias("complete"))
        .where("complete")
        .select("win_id", "size", "rarest.place", "rarest.shingle"),
        "window-prefixes",
    )
    start = F.col("at") - F.col("place")
    candidates = (
        hits.join(prefix, "shingle")
        .where((start >= 0) & (F.col("room") + F.col("place") >= F.col("size")))
        .select("doc", start.alias("start"), "win_id", "size")
        .distinct()
    )
    # all shingles of the window have to stand at their places
    wanted = candidates.join(parts.drop("size"), "win_id").withColumn("at", F.col("start") + F.col("place"))
    verified = (
        wanted.join(hits.select("doc", "at", "shingle").distinct(), ["doc", "at", "shingle"])
        .groupBy("doc", "start", "win_id", "size")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.greatest(F.col("size") - SHINGLE + 1, F.lit(1)))
    )
    owners = owned.join(wins, "win").select("win_id", "item_id")
    return places, verified.join(owners, "win_id").select("doc", "item_id", "start", "size")


def occurrences(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc (key), item_id, start, size: every place where a document holds a window of an item."""
    return _found(documents, items, window)[1]


def judge(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; without items nothing is hit. Rows of ``items``
    that repeat are one item, and an item without an id counts but is left out of the joined ids.
    """
    places, found = _found(documents, items, window)
    found = stored(found, "occurrences")
    covered = (
        found.select("doc", "start", "size")
        .distinct()
        .select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
        .distinct()
        .groupBy("doc")
        .agg(F.count("*").alias("n_hit"))
    )
    named = (
        found.select("doc", "item_id")
        .distinct()
        .groupBy("doc")
        .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    )
    hit = covered.join(named, "doc").select(
        "doc", "n_hit", "n_items", F.array_join("ids", ",").alias("ids")
    )
    rows = places.where("at < 0").select("doc", F.col("room").cast("long").alias("n_words"))
    return rows.join(hit, "doc", "left").select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without those that hold a window of an item; rows of one document go together."""
    found = occurrences(documents, items, window).select("doc").distinct()
    rows = documents.select(F.struct(*documents.columns).alias("row"), document_key().alias("doc"))
    return rows.join(found, "doc", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))
