"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a document whose signal is above a cutoff. Cutoffs come from a fixed grid. For each
stratum (language subtag), rule and cutoff, the labelled good rows that it would reject are counted
and the exact binomial tail decides whether the false-rejection rate is below its share of ALPHA; the
confidence is divided by the number of all tests (Bonferroni), so that all chosen cutoffs hold
together with probability 1 - DELTA. Among the cutoffs that hold, the loosest is taken that separates
labelled bad rows from good rows nearly as well as the best; a rule without one rejects nothing there.

The bound needs independent votes, so a text has one vote in its stratum, however many copies it has; one that
is labelled both good and bad votes good.

Defined results: null and empty texts have no words and fail the base rule; a stratum with few labels
gets no cutoffs; repeated rows get equal results and one vote; extra columns are ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strideframe.llm._common import table
from strideframe.llm.storage import materialise

ALPHA, DELTA = 0.05, 0.05
#: A falsely rejected good share weighs so many times a rightly rejected bad share; a rule must be worth this much,
#: and the loosest cutoff is taken that is worth nearly as much as the best.
CAUTION, LEAST_GAIN, NEARLY = 50.0, 0.05, 0.9
BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Signals and their cutoffs, from strict to loose.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_share": [0.01, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2, 0.25, 0.28],
    "long_words": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0],
    "short_words": [-5.0, -4.5, -4.0, -3.8, -3.6, -3.4, -3.2, -3.0, -2.5, -2.0, -1.5],
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANK), lambda w: w != "")


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, a hash of the text, the base counts and the signals of every row."""
    subtag = F.regexp_extract(F.lower(F.coalesce(F.col("lang").cast("string"), F.lit(""))), "^([a-z]{2})", 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(subtag == "", "other").otherwise(subtag).alias("stratum"),
        F.xxhash64(text, F.length(text)).alias("text_key"),
        words_of(F.col("text")).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "doc_id", "stratum", "text_key", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    parts = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    windows = hashed.select(
        "*",
        F.expr(f"CASE WHEN size(h) >= {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({parts})) ELSE array() END").cast("array<bigint>").alias("win"),
    ).drop("h")
    order = windows.select(
        "*",
        F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN array_sort(transform(win, (h, i) -> struct(h, i))) ELSE array() END").cast("array<struct<h:bigint,i:int>>").alias("s"),
    ).drop("win")
    repeated = order.select(
        "*",
        F.expr("array_sort(transform(filter(s, (x, j) -> (j > 0 AND get(s, j - 1).h = x.h) OR get(s, j + 1).h = x.h), x -> x.i))").alias("p"),
    ).drop("s")
    counted = repeated.select(
        "*",
        F.expr(f"aggregate(p, named_struct('n', 0L, 'stop', 0), (a, x) -> named_struct('n', a.n + {WINDOW} - greatest(a.stop - x, 0), 'stop', x + {WINDOW}), a -> a.n)").alias("n_repeat_words"),
    ).drop("p")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id", "stratum", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("word_chars") / n).alias("long_words"),
        (-F.col("word_chars") / n).alias("short_words"),
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, where five terms are exact to the last bits of a double; x is 1 or more."""
    y = x + 8
    tail = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + tail - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for X ~ Binomial(n, p), k below n * p.

    Terms are added in multiples of the largest, that of k. Those over twelve deviations below are left out: together
    they are less than the last bit of the sum. So the work grows with the root of n.
    """
    n = n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(12 * F.sqrt(n * p)) + 50).cast("int"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        below = a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)
        return F.struct(below.alias("t"), (a["s"] + a["t"]).alias("s"))

    return top + F.log(F.aggregate(steps, zero, add, lambda a: a["s"]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and the cutoff of each rule, null where none holds. At most 677 rows: two letters, or other."""
    marks = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    votes = measured.join(marks, "doc_id").groupBy("stratum", "text_key").agg(F.max("quality").alias("quality"), *[F.max(r).alias(r) for r in RULES])
    labelled = votes.select(
        "stratum",
        "quality",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sum((F.col(r) > c).cast("int") for c in grid).alias("above")) for r, grid in RULES.items()])).alias("x"),
    )
    bins = labelled.groupBy("stratum", "x.rule", "x.above").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")
    )
    # a row that exceeds `above` cutoffs is rejected by the first `above` of the grid
    width = max(map(len, RULES.values()))
    steps = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("step")).where("step <= above")
    tested = steps.groupBy("stratum", "rule", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    whole = tested.where("step = 0").select("stratum", "rule", F.col("good").alias("n"), F.col("bad").alias("n_bad"))
    strata = tested.select("stratum").distinct().count()
    tests = max(1, strata * sum(map(len, RULES.values())))
    p = alpha / len(RULES)
    # cutoffs that no labelled row exceeds are not tested: they would reject nothing
    each = tested.where("step > 0").join(whole, ["stratum", "rule"]).where(F.col("good") < F.col("n") * p)
    held = each.where(log_binomial_cdf(F.col("good"), F.col("n"), p) <= F.log(F.lit(delta / tests)))
    gain = F.col("bad") / F.greatest(F.col("n_bad"), F.lit(1)) - CAUTION * F.col("good") / F.col("n")
    grid = F.create_map(*[x for r, g in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    best = held.select("stratum", "rule", F.element_at(F.element_at(grid, F.col("rule")), F.col("step")).alias("cutoff"), gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    top = best.withColumn("top", F.max("gain").over(Window.partitionBy("stratum", "rule")))  # at most as many rows as a grid has
    best = top.where(F.col("gain") >= NEARLY * F.col("top")).groupBy("stratum", "rule").agg(F.max("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, kept and failed_rules of every row."""
    measured, _ = materialise(signals(docs))
    cuts = cutoffs(measured, labels, alpha, delta)
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.join(F.broadcast(cuts), "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on every whole text of documents."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")
