"""Quality rules whose cutoffs come from labelled documents with a bound on false rejection.

A rule rejects a document whose statistic lies above a cutoff. For each stratum and rule, the
labelled good documents above each cutoff of a fixed grid are counted, and the exact binomial tail
says how surely the true share of good documents above it stays below the limit. Cutoffs are tested
from the loosest to the strictest and the first one not proven ends the row, which needs no
correction for the number of cutoffs; the error is shared out over all rules and strata
(Bonferroni). So with chance 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents. Among proven cutoffs the one that rejects most bad less good documents is taken.

All of it is DataFrame functions. Only the cutoffs, one row per stratum, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the rules, and the characters counted as symbols. Fixed values.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Statistics that rules look at, all from 0 to 1 and worse when higher.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "capital_share")
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02, 0.01)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Settings:
    """Of all good documents of a stratum at most ``alpha`` may be rejected, with error ``delta`` over
    all strata together. At most ``max_strata`` strata."""

    alpha: float = 0.02
    delta: float = 0.05
    max_strata: int = 10_000


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column) -> Column:
    """Words in windows of eight that stand twice or more in the array.

    Windows are compared by 64-bit hashes. Only where there are fewer distinct ones than windows,
    they are sorted with their places, and what equal neighbours cover is added up.
    """
    n = F.size(words) - (WINDOW - 1)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(p: Column) -> Column:
        pairs = F.array_sort(F.arrays_zip(p["h"].alias("h"), F.sequence(F.lit(0), F.size(p["h"]) - 1).alias("i")))
        return F.element_at(F.transform(F.array(F.struct(pairs.alias("s"))), among), 1)

    def among(p: Column) -> Column:
        s, last = p["s"], F.size(p["s"]) - 1
        at = lambda i: F.get(s, i)["h"]
        twice = F.filter(
            s,
            lambda x, i: F.when(i > 0, at(i - 1) == x["h"]).otherwise(False)
            | F.when(i < last, at(i + 1) == x["h"]).otherwise(False),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # Each window adds what the one before it has not covered.
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    def total(p: Column) -> Column:
        fewer = F.size(F.array_distinct(p["h"])) < F.size(p["h"])
        return F.when(fewer, covered(p)).otherwise(F.lit(0).cast("long"))

    return F.element_at(F.transform(F.array(F.struct(hashes.alias("h"))), total), 1)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with the counts of ``COUNTS``, replaced if they are there.

    A null text counts as an empty one, which has no words, lines or symbols.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in (*COUNTS, "_words", "_lines", "_counts")])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, SPACE)) > 0)
    distinct = F.element_at(
        F.transform(
            F.array(F.struct(lines.alias("x"))),
            lambda p: F.struct(
                F.size(p["x"]).cast("long").alias("n"),
                (F.size(p["x"]) - F.size(F.array_distinct(p["x"]))).cast("long").alias("dup"),
            ),
        ),
        1,
    )
    out = base.withColumn("_words", F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    out = out.withColumn("_lines", distinct)
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(t, SPACE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.col("_lines.dup").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.col("_lines.n").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    # A filter on a generator's result is not moved below it, where all counts would be made once more.
    kept = [F.col(f"`{c}`") for c in base.columns]
    return out.select(*kept, F.explode(F.array(counts)).alias("_counts")).select(*kept, "_counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def statistics() -> dict[str, Column]:
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "capital_share": _share("n_capitals", "word_chars"),
    }


def _log_gamma(x: Column) -> Column:
    """By Stirling's series eight above ``x``, which is 1 at least; about eleven digits."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Chance of ``k`` or fewer among ``n`` at chance ``p`` each; 1 where ``k`` is not below n * p.

    The terms fall from ``k`` down; those beyond twelve standard deviations add nothing.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 40).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    summed = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.transform(
            F.array(s["term"] * ((k - i) * (1 - p) / ((n - k + i + 1) * p))),
            lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")),
        )[0],
        lambda s: s["sum"],
    )
    return F.when(k < n * p, F.least(F.lit(1.0), first * summed)).otherwise(1.0)


def fit(counted: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Cutoffs per stratum: (stratum, rule, cutoff, n_good, good_above, bad_above, tail).

    ``counted`` is a result of ``with_counts``. Labels with a quality of 1 are good, 0 bad; a document
    with several labels is good if all are, null labels are no labels. Documents that fail the base
    rules are not looked at, as they go anyway. Rules without a proven cutoff have no row.
    """
    marked = labels.where(F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    values = F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("value")) for r, s in statistics().items()])
    level = F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: c >= F.col("v.value")))
    counts = (
        counted.where(~base_failed())
        .select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), values.alias("v"))
        .join(marked, key)
        .select("stratum", "quality", F.explode("v").alias("v"))
        # Cutoff number c lies below the value from this level on.
        .groupBy("stratum", F.col("v.rule").alias("rule"), level.alias("level"))
        .agg(
            F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"),
        )
    )
    strata = counts.select("stratum").distinct().agg(F.count("*").alias("n_strata"))
    by_rule = counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.collect_list(F.struct("level", "good", "bad")).alias("levels")
    )
    above = lambda c, kind: F.aggregate(
        F.filter("levels", lambda x: x["level"] <= c), F.lit(0).cast("long"), lambda a, x: a + x[kind]
    )
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1)),
        lambda c: F.struct(
            c.alias("no"),
            F.element_at(F.array(*map(F.lit, CUTOFFS)), c + 1).alias("cutoff"),
            above(c, "good").alias("good_above"),
            above(c, "bad").alias("bad_above"),
        ),
    )
    share = settings.alpha / len(RULES)
    tested = (
        by_rule.select("stratum", "rule", "n_good", F.explode(grid).alias("g"))
        .select("stratum", "rule", "n_good", "g.*")
        .withColumn("tail", binomial_tail(F.col("good_above"), F.col("n_good"), share))
        .crossJoin(F.broadcast(strata))
    )
    error = settings.delta / (len(RULES) * F.col("n_strata"))
    row = Window.partitionBy("stratum", "rule")
    proven = tested.withColumn(
        "proven", F.min(F.col("tail") <= error).over(row.orderBy("no"))
    ).where("proven")
    gain = (F.col("bad_above") - F.col("good_above")).alias("gain")
    best = proven.withColumn("place", F.row_number().over(row.orderBy(gain.desc(), "no")))
    return best.where("place = 1").select(
        "stratum", "rule", "cutoff", "n_good", "good_above", "bad_above", "tail"
    )


def judge(counted: DataFrame, limits: DataFrame, stratum: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``, replaced if they are there.

    ``limits`` is a result of ``fit`` and is fetched: one row per stratum and rule, checked against
    ``max_strata``. Strata without limits keep what passes the base rules.
    """
    most = settings.max_strata * len(RULES)
    rows = limits.select("stratum", "rule", "cutoff").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {settings.max_strata} strata")
    by: dict[str, dict[str, float]] = {}
    for r in rows:
        by.setdefault(r["stratum"], {})[r["rule"]] = r["cutoff"]
    base = counted.drop(*[c for c in counted.columns if c.lower() in ("base_failed", "kept", "_limits")])
    empty = F.lit(None).cast("array<double>")
    limit = empty
    if by:
        pairs = [(F.lit(s), F.array(*[F.lit(own.get(r)).cast("double") for r in RULES])) for s, own in sorted(by.items())]
        limit = F.create_map(*[c for pair in pairs for c in pair])[F.coalesce(F.col(stratum).cast("string"), F.lit(""))]
    stats = statistics()
    too_high = [F.coalesce(stats[r] > F.get("_limits", F.lit(i)), F.lit(False)) for i, r in enumerate(RULES)]
    rejected = too_high[0]
    for x in too_high[1:]:
        rejected = rejected | x
    return base.withColumn("_limits", limit).select(
        *[F.col(f"`{c}`") for c in base.columns],
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )
