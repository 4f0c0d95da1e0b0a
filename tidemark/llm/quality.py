"""Quality rules, by document and by host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, Cut, small

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected if, after shrinkage, more than this share of its documents fails a rule.
MAX_HOST_RATE = 0.5


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures of each whole text.

    A null text counts as one without words. Windows are compared by the 64-bit hash of their words, within one
    text. Only texts in which some hash repeats pay for the sort that finds where.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    out = docs.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+")),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]")),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        }
    )
    hashed = "transform(sequence(0, size(_words) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))"
    out = out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, F.expr(hashed)).alias("_h"),
    )
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("array_sort(transform(_h, (x, i) -> struct(x, i)))"))).drop("_h")
    out = out.withColumn("_at", F.expr("array_sort(transform(filter(_s, (s, j) -> (j > 0 AND s.x = _s[greatest(j, 1) - 1].x) OR (j < size(_s) - 1 AND s.x = _s[least(j + 1, size(_s) - 1)].x)), s -> s.i))"))
    covered = F.expr(f"aggregate(_at, struct(-{WINDOW} AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least({WINDOW}, x - a.last) AS n), a -> a.n)")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s", "_at")


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """Failures by host, with rates shrunk by a beta prior fitted to all hosts by moments.

    The prior's mean is the failure rate of all documents; its strength comes from the variance of the hosts'
    rates about that mean beyond what their sizes explain. Few or like hosts give a strong prior, at most 1e6
    documents' worth. Hosts are summed before the shuffle, so a host with most documents is no burden.
    """
    hosts = rows.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    totals = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.count("*").alias("k"), F.sum(F.pow("host_failed", F.lit(2)) / F.col("host_docs")).alias("q"), F.sum(F.pow("host_docs", F.lit(2))).alias("n2"))
    m = F.col("f") / F.col("n")
    # between-host variance (moments): sum n_i (p_i - m)^2 = (k - 1) m (1 - m) + between * (n - n2 / n) with within-host noise m (1 - m)
    spread = F.col("q") - F.pow("f", F.lit(2)) / F.col("n")
    between = F.try_divide(spread - (F.col("k") - 1) * m * (1 - m), F.col("n") - F.col("n2") / F.col("n"))
    strength = F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.coalesce(F.when(between > 0, F.try_divide(m * (1 - m), between) - 1), F.lit(1e6))))
    prior = totals.select(F.struct((m * strength).alias("a"), ((1 - m) * strength).alias("b")).alias("p"))
    p = prior.scalar()
    hosts = hosts.withColumn("_p", p)
    rate = (F.col("host_failed") + F.col("_p.a")) / (F.col("host_docs") + F.col("_p.a") + F.col("_p.b"))
    return hosts.withColumn("host_rate", rate).drop("_p")


def quality_rules(spark: SparkSession, docs: DataFrame, host: str = "source", keep_text: bool = False) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, the host's shrunk failure rate and the verdict ``kept``.

    A document is kept if it passes the base rules and its host is not rejected. Null hosts are one host; rows
    that repeat are each judged; an empty table gives no rows. Columns that clash with a measure's name are
    replaced by it. Texts are read once: the measures go to the shared folder, and hosts are summed from there. Texts are in the result only if asked for. Verdicts
    are broadcast if they are counted and few, so that texts stay where they are.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failed", "host_rate", "kept", "_words", "_lines", "_h", "_s", "_at", "_p", "_host"}
    docs = docs.drop(*(c for c in docs.columns if c in made))
    rows = measures(docs).withColumn("base_failed", base_failed())
    cut = Cut(spark, "quality")
    rows = cut(rows if keep_text else rows.drop("text"))
    rates = small(cut(host_rates(rows, host).withColumnRenamed(host, "_host")))
    return rows.join(rates, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE))
