"""Lines that repeat an earlier line with at most one word changed, and texts without them.

A line is the words (``[^\\x20\\x09-\\x0D]+``) between two line feeds; a line without a word is never
removed. Two lines are alike when they have the same words, or when both have at least ``near_words``
words and one word inserted, deleted or replaced makes them equal. A line goes if a line that is
alike stands earlier (smaller doc_id, then by the text's hash, then the line's place), judged on
the input and not on what is left.

The deletion neighbourhood of a line is the line itself and the line without each one of its words.
Two lines of one length are one edit apart when they agree without the word at one place; lines of
lengths n and n + 1 when the longer without some word is the shorter. All lines that meet in an
entry are therefore alike to the earliest of them, and one minimum per entry replaces their pairs.
An entry is a hash: words and places are hashed and combined by xor, so a running xor gives all
entries of a line in linear time. The earliest partner is verified on the words.

Before that, lines without a possible partner are left out. One edit touches only one half of a
line, so alike lines share their words up to the middle of the shorter, or from there on.

Only DataFrame functions are used. The identity of equal lines is their md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichegrid.llm.tables import document_key, stored

#: shorter lines have to be equal: one word of a few makes another line
NEAR_WORDS = 8
_GAPS = "[\\x20\\x09-\\x0D]+"


def _lines(documents: DataFrame) -> DataFrame:
    """doc, place, line (its words joined by single spaces); lines without a word are left out."""
    # the key first: beside the unfolding it would be worked out for every line
    keyed = documents.select(document_key().alias("doc"), "text")
    rows = keyed.select("doc", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    raw = F.col("raw")
    # the usual line has single spaces already; only the others are put together anew
    uneven = raw.startswith(" ") | raw.endswith(" ") | raw.contains("  ")
    for space in "\t\x0b\x0c\r":
        uneven = uneven | raw.contains(space)
    words = F.filter(F.split(raw, _GAPS), lambda word: word != "")
    line = F.when(uneven, F.array_join(words, " ")).otherwise(raw)
    # unfolding an array of one makes the line a column of its own, worked out once however often it is used
    return rows.select("doc", "place", F.explode(F.array(line)).alias("line")).where("line <> ''")


def _size(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the first and the last half, as the line and as the longer of two lines cuts them."""
    keys = []
    for shorter in (n, n - 1):
        middle = F.floor(shorter / 2).cast("int")
        for head, words in ((True, middle), (False, middle - shorter)):  # so many from the start or the end
            part = F.call_function("substring_index", line, F.lit(" "), words)
            keys.append(F.struct(F.xxhash64(F.lit(head), shorter, part).alias("half"), F.lit(head).alias("head")))
    return F.array(*keys)


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _entries(lines: DataFrame) -> DataFrame:
    """doc, place (of a first occurrence) and its entries; ``kind`` is 0 for a line that agrees but for the
    word at one place, 1 for a line without one of its words, 2 for the line itself.

    ``lines``: doc, place, line, head and tail (whether a partner shares that half), laid out by (doc,
    place), which the window then needs no shuffle for. Words of a shared half are not taken out.
    """
    words = F.split("line", " ")
    sums = lines.select(
        "doc",
        "place",
        "head",
        "tail",
        words.alias("words"),
        F.explode(
            F.array(
                F.struct(
                    _xor(F.transform(words, lambda word, at: F.xxhash64(word, at))).alias("here"),
                    _xor(F.transform(words, lambda word, at: F.xxhash64(word, at - 1))).alias("before"),
                )
            )
        ).alias("sums"),
    )
    each = sums.select("doc", "place", "head", "tail", F.size("words").alias("n"), "sums", F.posexplode("words").alias("at", "word"))
    own = F.xxhash64("word", F.col("at"))
    moved = F.xxhash64("word", F.col("at") - 1)
    # what comes before the word keeps its place, what comes after moves up by one
    passed = F.bit_xor(own.bitwiseXOR(moved)).over(
        Window.partitionBy("doc", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    )
    each = each.withColumn("without", F.col("sums.before").bitwiseXOR(passed).bitwiseXOR(own))
    n, at, without = F.col("n"), F.col("at"), F.col("without")

    def entry(kind: int, *parts: Column) -> Column:
        return F.struct(F.lit(kind).cast("byte").alias("kind"), F.xxhash64(F.lit(kind == 0), *parts).alias("entry"))

    # the longer line without some word is the whole of the shorter
    parts = F.array(entry(0, n, at, without), entry(1, n - 1, without))
    itself = F.array(entry(2, n, F.col("sums.here")))
    outside = (F.col("head") & (at >= F.floor((n - 1) / 2))) | (F.col("tail") & (at <= F.floor(n / 2)))
    none = F.slice(parts, 1, 0)
    return each.where(outside | (at == 0)).select(
        "doc", "place", F.inline(F.concat(F.when(outside, parts).otherwise(none), F.when(at == 0, itself).otherwise(none)))
    )


def _alike(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x
    )
    longer = F.when(F.size(a) > F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) > F.size(b), b).otherwise(a)
    # the common front, then one word passed over in the longer line
    front = F.array_position(F.zip_with(shorter, F.slice(longer, F.lit(1), F.size(shorter)), lambda x, y: x != y), True)
    front = F.when(front == 0, F.size(shorter)).otherwise(front - 1).cast("int")
    rest = F.slice(longer, front + 2, F.size(longer)) == F.slice(shorter, front + 1, F.size(longer))
    return F.when(F.size(a) == F.size(b), differ <= 1).otherwise((F.size(longer) == F.size(shorter) + 1) & rest)


def kept_lines(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc, place of the lines with a word that stay: the first of its words, and none alike before."""
    # a column of its own: inside conditions it would be counted again for every use
    lines = _lines(documents).select("*", F.explode(F.array(_size(F.col("line")))).alias("n"))
    n = F.col("n")
    marked = stored(
        lines.select(
            "doc",
            "place",
            F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"),
            F.when(n >= near_words, _halves(F.col("line"), n)).alias("halves"),
        ),
        "lines",
    )
    first = F.min(F.struct("doc", "place")).alias("first")
    firsts = stored(marked.groupBy("id").agg(first, F.first("halves").alias("halves")), "first-lines")
    halves = firsts.where("halves is not null").select("first.*", F.inline("halves"))
    place = F.xxhash64("doc", "place")
    shared = halves.groupBy("half").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
    may = (
        halves.join(shared.select("half"), "half")
        .groupBy("doc", "place")
        .agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))
    )
    candidates = stored(
        lines.where(n >= near_words).drop("n").join(may, ["doc", "place"]).dropDuplicates(["doc", "place"]),
        "candidate-lines",
    )
    entries = stored(_entries(candidates.repartition("doc", "place")), "line-entries")
    line = F.struct("doc", "place")
    # lines that are each without a word, but none whole, are two edits apart: they count with a whole one only
    groups = (
        entries.groupBy("entry")
        .agg(
            F.min(line).alias("least"),
            F.min(F.when(F.col("kind") == 2, line)).alias("whole"),
            F.min("kind").alias("kind_"),
            F.count("*").alias("members"),
        )
        .where("members > 1 and (kind_ = 0 or whole is not null)")
        .drop("members", "kind_")
    )
    partner = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("least"))
    met = (
        entries.join(groups, "entry")
        .select("doc", "place", partner.alias("partner"))
        .where(F.col("partner") < F.struct("doc", "place"))
        .groupBy("doc", "place")
        .agg(F.min("partner").alias("partner"))
    )
    texts = candidates.select(F.col("doc").alias("_doc"), F.col("place").alias("_place"), F.col("line").alias("_line"))
    repeated = (
        met.join(candidates, ["doc", "place"])
        .join(texts, (F.col("partner.doc") == F.col("_doc")) & (F.col("partner.place") == F.col("_place")))
        .where(_alike(F.split("line", " "), F.split("_line", " ")))
        .select("doc", "place")
    )
    return firsts.select("first.*").join(repeated, ["doc", "place"], "left_anti")


def dedup(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """Every row of ``documents`` with its text less the lines that go, and ``n_lines``, ``n_removed``.

    ``n_lines`` counts lines with a word. Columns of these two names are replaced. Null text stays
    null with zero counts; a text whose lines all go becomes the lines without a word, or empty. Rows
    that repeat a document (id and text) are one document and come out alike.
    """
    kept = kept_lines(documents, near_words).groupBy("doc").agg(F.collect_list("place").alias("places"))
    rows = documents.select(F.struct(*documents.columns).alias("_d"), document_key().alias("doc"))
    text = F.col("_d.text")
    joined = rows.join(kept, "doc", "left").withColumn("lines", F.split(text, "\n"))
    places = F.coalesce("places", F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    blank = F.filter(every, lambda i: ~F.get("lines", i).rlike("[^\\x20\\x09-\\x0D]"))
    n_lines = F.size("lines") - F.size("blank")
    joined = joined.withColumn("blank", blank).withColumn("places", places)
    stay = F.array_intersect(every, F.concat("places", "blank"))
    removed = n_lines - F.size("places")
    cut = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    columns = [F.col(f"_d.{c}").alias(c) for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    out = joined.select(
        *columns,
        F.when(removed > 0, cut).otherwise(text).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.select(*documents.columns, *(c for c in ("n_lines", "n_removed") if c not in documents.columns))


def rewrite(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``documents`` with the columns it has: the text less the lines that go, ``n_chars`` made to fit.

    A document that loses every line with a word has nothing left and goes; one that had none stays.
    """
    # the text once: the rows are dealt by their document
    others = [c for c in documents.columns if c != "text"]
    rows = dedup(documents.select(F.struct(*others).alias("row"), "doc_id", "text"), near_words)
    rows = rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    fresh = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        fresh["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    return rows.select(
        *(
            (fresh[c].cast(documents.schema[c].dataType) if c in fresh else F.col(f"row.{c}")).alias(c)
            for c in documents.columns
        )
    )
