"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Five transformed statistics describe a text. Per language and source, a minimum-covariance-determinant estimate of
their centre and scatter is found by concentration steps: the three quarters (``SUPPORT``) of the group nearest to the
present centre give the next one. Three starts per group (quartiles; spatial signs; all rows) take the first steps in the
same passes; the one of least determinant goes on until its determinant stops falling. A text whose squared Mahalanobis
distance from its group's final estimate exceeds a quantile of the chi-squared distribution is rejected.

Ranks within a group are read off a histogram of distances, whose size has a bound, so no group is ever sorted or
gathered; the nearest part is all rows up to the bin that reaches its rank. Sums are in whole numbers, so results do not
depend on the order of rows.

Defined cases: a null or blank text has no words and fails the base rules; rows that fail those take no part in the
estimates; null languages and sources are groups of their own; groups of a handful of rows lean on the least deviations
below and keep what is near; repeated rows are judged each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.llm.common import SPACE, stored
from gaugeline.session import checkpointed, small_side

LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Share of a group that the estimate rests on, steps that every start takes, bins of a doubling of the distance.
SUPPORT, TRIALS, FINE = 0.75, 2, 32
#: The least fall of the logarithm of the determinant that calls for another step. That logarithm is never below nought,
#: since least deviations are added, so steps end.
FALL = 1e-4
#: Products of spatial signs are rounded to parts of one, so that their sums do not depend on the order of rows.
SIGN_PARTS = 1 << 20
#: The 0.9999 quantile of chi-squared with five degrees of freedom, and the factor that makes up for the scatter of the
#: nearest three quarters of a normal sample.
CUTOFF, CONSISTENCY = 25.745, 1.412
#: Least deviation of each statistic: log words, log word length, log symbols, log repeated lines, log repeated words.
STATISTICS = {"x0": 0.5, "x1": 0.06, "x2": 0.5, "x3": 1.0, "x4": 1.0}
NAMES, SIZE = list(STATISTICS), len(STATISTICS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
#: Parts of a least deviation that statistics are rounded to, and bins of one in the start's histograms.
PARTS, COARSE = 1024, 8


def let(value: Column, use) -> Column:
    """Bind a value once and use it in an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: str) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are hashed and sorted with their places; equal neighbours repeat, and their places are put together.
    """
    w = F.col(words)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        equal = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(s, lambda e, k: equal(e, k - 1) | equal(e, k + 1))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(F.size(w) >= 3, let(F.array_sort(windows), covered)).otherwise(F.lit(0).cast("long"))


def base_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source", F.filter(F.split(t, SPACE, -1), lambda x: x != "").alias("words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words("words").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def transformed() -> dict[str, Column]:
    """The statistics of a row, in parts of their least deviation."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log1p(100 * F.col(c) / n)
    values = (F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"))
    return {k: F.round(v / d * PARTS).cast("long") for (k, d), v in zip(STATISTICS.items(), values, strict=True)}


def whole(value: Column) -> Column:
    """The exact sum of whole numbers."""
    return F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)")


def sums() -> list[Column]:
    """Rows, sums and sums of products of the statistics."""
    return [
        F.count(F.lit(1)).alias("n"), *[whole(F.col(x)).alias(f"s{i}") for i, x in enumerate(NAMES)],
        *[whole(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def moments(factor: float) -> dict[str, Column]:
    """The centre and, times a factor, the scatter that such sums give."""
    n, mean = F.col("n").cast("double"), [F.col(f"s{i}").cast("double") / F.col("n") / PARTS for i in range(SIZE)]
    scatter = {f"c{i}{j}": (F.col(f"p{i}{j}").cast("double") / n / PARTS**2 - mean[i] * mean[j]) * factor for i, j in PAIRS}
    return {f"m{i}": mean[i] for i in range(SIZE)} | scatter


def quartiles(rows: DataFrame) -> DataFrame:
    """Per group: medians m, and quartile distances as deviations d, off histograms of whole bins."""
    width = PARTS // COARSE
    longer = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) / width) for x in NAMES])).alias("k", "bin"))
    bins = longer.groupBy("g", "k", "bin").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("g", "k").orderBy("bin")
    ranked = bins.select("g", "k", "bin", F.sum("n").over(up).alias("to"), F.sum("n").over(Window.partitionBy("g", "k")).alias("all"))
    at = lambda q: F.min(F.when(F.col("to") >= F.col("all") * q, F.col("bin")))
    marks = ranked.groupBy("g", "k").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    middle, spread = (F.col("mid") + 0.5) / COARSE, (F.col("high") - F.col("low")) / COARSE / 1.349
    pick = lambda k, value: F.max(F.when(F.col("k") == k, value))
    return marks.groupBy("g").agg(*[pick(k, middle).alias(f"m{k}") for k in range(SIZE)], *[pick(k, spread).alias(f"d{k}") for k in range(SIZE)])


def starts(rows: DataFrame) -> DataFrame:
    """Per group three estimates, numbered s: quartiles alone; spatial signs about the medians; all rows.

    The sign of a row is its way from the medians, in quartile deviations and least deviations, brought to length one.
    """
    robust = small_side(quartiles(rows))
    unit = [F.sqrt(F.col(f"d{i}") * F.col(f"d{i}") + 1.0) for i in range(SIZE)]
    away = rows.join(robust, "g").withColumns({f"z{i}": (F.col(x) / PARTS - F.col(f"m{i}")) / unit[i] for i, x in enumerate(NAMES)})
    length = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(SIZE)), F.lit(0.0))
    away = away.withColumn("length", F.greatest(length, F.lit(1e-12)))
    signs = [F.sum(F.round(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length") * SIGN_PARTS).cast("long")).alias(f"q{i}{j}") for i, j in PAIRS]
    about = checkpointed(away.groupBy("g").agg(*sums(), *signs).join(robust, "g"))
    centre = {f"m{i}": F.col(f"m{i}") for i in range(SIZE)}
    deviations = {f"c{i}{j}": F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0) for i, j in PAIRS}
    directions = {f"c{i}{j}": F.col(f"q{i}{j}").cast("double") / F.col("n") / SIGN_PARTS * SIZE * unit[i] * unit[j] for i, j in PAIRS}
    kinds = [centre | deviations, centre | directions, moments(1.0)]
    each = F.array(*[F.struct(F.lit(s).alias("s"), *[c.alias(name) for name, c in kind.items()]) for s, kind in enumerate(kinds)])
    return factored(about.select("g", F.inline(each)))


def factored(estimates: DataFrame) -> DataFrame:
    """Per group and start: the centre, the Cholesky factor of the scatter, to whose diagonal the least deviations are
    added, and the logarithm of its determinant."""
    parts: dict[tuple[int, int], str] = {}
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") + (1.0 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(parts[i, k]) * F.col(parts[j, k])
        parts[i, j] = f"l{i}{j}"
        estimates = estimates.withColumn(parts[i, j], F.sqrt(rest) if i == j else rest / F.col(parts[j, j]))
    determinant = sum((2 * F.log(F.col(parts[i, i])) for i in range(SIZE)), F.lit(0.0))
    return estimates.select("g", "s", *[f"m{i}" for i in range(SIZE)], *parts.values(), determinant.alias("determinant"))


def distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(SIZE):
        rest = F.col(NAMES[i]) / PARTS - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(SIZE)), F.lit(0.0)))


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: the estimates from each group's nearest rows. Sums are kept by bin of the distance, so one pass does."""
    near = distance(rows.join(small_side(estimates), "g"))
    bin_of = F.floor(FINE * F.log2(F.greatest(F.least(F.col("d2"), F.lit(2.0**20)), F.lit(2.0**-20))))
    bins = near.withColumn("bin", bin_of).groupBy("g", "s", "bin").agg(*sums())
    group = Window.partitionBy("g", "s")
    ranked = bins.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(group))
    held = ranked.where(F.col("before") < F.col("all") * SUPPORT).groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in bins.columns[3:]])
    return factored(held.withColumns(moments(CONSISTENCY)))


def settled(rows: DataFrame) -> DataFrame:
    """One estimate per group: the start of least determinant after the first steps, stepped on until that stops falling."""
    estimates = starts(rows)
    for _ in range(TRIALS):
        estimates = concentrated(rows, estimates)
    least = estimates.groupBy("g").agg(F.min_by(F.struct(*estimates.columns[1:]), F.struct("determinant", "s")).alias("e"))
    best = checkpointed(least.select("g", "e.*", F.lit(True).alias("moving")))
    while not best.where("moving").isEmpty():
        step = concentrated(rows, best.where("moving").drop("moving"))
        step = step.select("g", F.struct(*step.columns[1:]).alias("new"))
        fell = F.coalesce(F.col("new.determinant") < F.col("determinant") - FALL, F.lit(False))
        next_of = [F.when(fell, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in estimates.columns[1:]]
        best = checkpointed(best.join(step, "g", "left").select("g", *next_of, fell.alias("moving")))
    return best.drop("moving")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: the base statistics, base_failed, distance (squared; null if failed) and kept."""
    group = F.to_json(F.struct("lang", "source"))
    rows = stored(base_statistics(docs, doc_id, text, lang, source).withColumns(transformed()).withColumn("g", group), "rules")
    sound = rows.where(~F.col("base_failed")).select("g", *NAMES)
    judged = distance(rows.join(small_side(settled(sound)), "g", "left"))
    far = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("d2") <= CUTOFF)).alias("kept"), far.alias("distance"),
    )
