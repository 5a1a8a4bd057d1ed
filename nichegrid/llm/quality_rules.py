"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text when ``1000 * numerator > cut * denominator``. For each stratum the cuts of a
rule are tested from lenient to strict on one half of the labelled good documents: a cut is
certified when the exact binomial test refutes "it rejects more than ``alpha / rules`` of the good
documents" at level ``delta / (strata * rules)``. Testing in a fixed order and stopping at the first
cut that is not certified keeps the familywise error without a charge for the number of cuts; the
division by strata and rules is the Bonferroni share. The other half chooses, among the certified
cuts, the one that separates best. A stratum with too few labels certifies nothing and rejects
nothing, so its clean documents stay.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichegrid.llm.tables import stored

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: rule -> (numerator, denominator)
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
}
#: per mille, lenient to strict
CUTS = (900, 700, 500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 20)
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Risk:
    """At most ``alpha`` of a stratum's good documents go, with probability ``1 - delta`` for all strata.

    A certified cut is used only where it rejects ``gain`` times the share of bad documents that it
    rejects of good ones; 10 keeps clean documents where a rule says little.
    """

    alpha: float = 0.04
    delta: float = 0.05
    gain: int = 10


def text_features(raw: bytes | None) -> tuple[int, ...]:
    """The seven counts of FEATURES. A null or empty text has zeros, but one (empty) line if empty."""
    if raw is None:
        return (0,) * 7
    words = raw.split()  # bytes split on exactly space and \x09-\x0D
    n = len(words)
    chars = len(raw.translate(None, _SPACES + _CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lines = raw.split(b"\n")
    filled = [line for line in lines if line.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = bytearray(n)
        for i, window in enumerate(windows):
            if times[window] > 1:
                hit[i] = hit[i + 1] = hit[i + 2] = 1
        repeated = sum(hit)
    return n, chars, symbols, len(filled) - len(set(filled)), repeated, len(filled), upper


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(x) for x in texts], columns=list(FEATURES), dtype="int64")


def with_features(documents: DataFrame) -> DataFrame:
    """``documents`` with a struct ``_f`` of counts and ``_base_failed``; other columns stay in the JVM."""
    return documents.withColumn("_f", _features(F.col("text").cast("binary"))).withColumn(
        "_base_failed",
        (F.col("_f.n_words") < 50) | (F.col("_f.n_repeat_words") * 100 > F.col("_f.n_words") * 50),
    )


def _rejects(cut, rule: str):
    num, den = RULES[rule]
    return F.col(f"_f.{num}") * 1000 > cut * F.col(f"_f.{den}")


def _tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly up to rounding."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many of the cuts, in order, are certified. ``rejected``: good documents each cut rejects."""
    for i, k in enumerate(rejected):
        if n == 0 or k > alpha * n or _tail(k, n, alpha) > level:
            return i
    return len(rejected)


def cutoffs(judged: DataFrame, labels: DataFrame, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum that has a certified cut: stratum and a cut (or null) per rule.

    ``judged``: doc_id, the stratum, ``_f`` and ``_base_failed``. Labels without a document, without
    a quality or with contradicting qualities are left out. Only counts per stratum, rule and cut
    travel; the final choice runs on the strata that could be certified at all, whose number the
    labels bound.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high")
        .select("doc_id", (F.col("_low") == 1).alias("_good"))
    )
    rows = judged.where(~F.col("_base_failed")).join(known, "doc_id")
    half = F.md5(F.col("doc_id").cast("string").cast("binary")) < "8"
    ratios = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), F.col(f"_f.{num}").alias("num"), F.col(f"_f.{den}").alias("den"))
            for rule, (num, den) in RULES.items()
        )
    )
    each = rows.select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
        "_good",
        half.alias("_certify"),
        F.inline(ratios),
    ).withColumn("cut", F.explode(F.array(*map(F.lit, CUTS))))
    groups = {
        "certify": F.col("_good") & F.col("_certify"),
        "good": F.col("_good") & ~F.col("_certify"),
        "bad": ~F.col("_good"),
    }
    over = F.col("num") * 1000 > F.col("cut") * F.col("den")
    seen = each.groupBy("_stratum", "rule", "cut").agg(
        *(F.sum(who.cast("long")).alias(f"n_{part}") for part, who in groups.items()),
        *(F.sum((who & over).cast("long")).alias(f"over_{part}") for part, who in groups.items()),
    )
    seen = stored(seen, "quality-counts")
    strata = seen.select("_stratum").distinct().count()
    share, level = risk.alpha / len(RULES), risk.delta / max(strata * len(RULES), 1)
    enough = math.ceil(math.log(level) / math.log1p(-share))  # fewer certify nothing even without a rejection
    usable = seen.where((F.col("n_certify") >= enough) & (F.col("n_bad") > 0))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        """One stratum: a row per rule and cut."""
        cuts = {}
        for rule, own in frame.sort_values("cut", ascending=False).groupby("rule"):
            rows = [{k: int(v) for k, v in x.items() if k not in ("_stratum", "rule")} for x in own.to_dict("records")]
            n = certified([x["over_certify"] for x in rows], rows[0]["n_certify"], share, level)
            # the difference of two shares over their common denominator, so that it stays an integer
            worth = [
                x["over_bad"] * max(x["n_good"], 1) - risk.gain * x["over_good"] * x["n_bad"] for x in rows[:n]
            ]
            best = max(range(n), key=lambda i: (worth[i], -i), default=None)
            if best is not None and worth[best] > 0:
                cuts[f"cut_{rule}"] = rows[best]["cut"]
        names = ["_stratum", *(f"cut_{r}" for r in RULES)]
        out = pd.DataFrame([{"_stratum": frame["_stratum"].iloc[0], **cuts}], columns=names)
        return out.astype({name: "Int64" for name in names[1:]})

    schema = "_stratum string, " + ", ".join(f"cut_{r} long" for r in RULES)
    return usable.groupBy("_stratum").applyInPandas(choose, schema)


def _verdict(judged: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    # every row of cuts rests on hundreds of labelled documents of its stratum; Spark chooses the join
    # from the stored size, and adaptive execution splits a stratum that holds most documents
    cuts = stored(cuts, "quality-cuts")
    joined = judged.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(
        cuts, "_stratum", "left"
    )
    failed = F.lit(False)
    for rule in RULES:
        failed = failed | F.coalesce(_rejects(F.col(f"cut_{rule}"), rule), F.lit(False))
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~failed)


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """One row per row of ``documents``: doc_id, stratum, the counts, the cuts, base_failed and kept.

    Null text: no words, so it fails the base. Null stratum: a stratum of its own. Repeated rows are
    judged each by itself. No labels: nothing beyond the base is rejected.
    """
    wanted = documents.select("doc_id", F.col(stratum).alias("_by"), "text")
    judged = stored(with_features(wanted).drop("text"), "quality-features")
    cuts = cutoffs(judged, labels, "_by", risk)
    return _verdict(judged, cuts, "_by").select(
        "doc_id",
        F.col("_by").alias("stratum"),
        "_f.*",
        *(f"cut_{r}" for r in RULES),
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of ``documents`` that are kept, with their columns; the texts are not shuffled.

    The counts are made twice, once for the cutoffs and once beside the text, which costs less than
    moving every text to its verdict.
    """
    wanted = documents.select("doc_id", F.col(stratum).alias("_by"), "text")
    labelled = wanted.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    cuts = cutoffs(with_features(labelled).drop("text"), labels, "_by", risk)
    columns = [F.col(f"_d.{c}").alias(c) for c in documents.columns]
    rows = documents.select(
        F.struct(*documents.columns).alias("_d"), F.col(stratum).alias("_by"), F.col("text").alias("text")
    )
    return _verdict(with_features(rows), cuts, "_by").where("_kept").select(*columns)
