"""Operator 8: quality rules with robust multivariate outliers, in DataFrame functions only.

Each text gets counts by built-in functions. Texts that fail the base rules
(fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT`` percent of words
in windows of five words that occur again in the text) are rejected. The others are
judged by the Mahalanobis distance of their transformed statistics (``STATS``)
from a minimum-covariance-determinant estimate of their group, language and
source:

- three deterministic starts from each group's medians and median absolute deviations:
  these alone, the covariance of the texts' spatial signs, and that of the hyperbolic
  tangents of their standardised statistics;
- a concentration step takes the ``CORE`` share of the group with the smallest distances
  for the next mean and covariance. After ``FIRST_STEPS`` steps of every start each group
  goes on with that of the smallest determinant, until no group's determinant falls any further
  (``MOST_STEPS`` at most);
- an estimate is shrunk toward that of its language, and a language's toward that of all
  texts, as if ``PRIOR`` texts of the parent had been seen beside the group's own. So a
  small group mostly has its parent's estimate and a large one its own, without a switch;
- a variance, given the statistics before it, is ``FLOOR`` at least, the size of what
  can be measured, since some statistics are constant in the core; distances are
  scaled so that their median (shrunk alike) is at most that of the chi-squared distribution.

A text is kept if its scaled squared distance is at most ``CUT``, the chi-squared
quantile of 0.9999.

Group statistics are sums and quantile summaries, so the hot group is combined before any
shuffle. Null language or source is a group value of its own. Null and wordless texts
have no words, fail the base rules and are not kept. Every row gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load

MIN_WORDS = 10
MAX_REPEAT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Texts of the parent that stand beside a group's own.
PRIOR = 50
CORE = 0.75
FIRST_STEPS, MOST_STEPS = 2, 30
#: A smaller fall of a determinant's logarithm is none: what the quantiles' error alone can make of it.
SAME = 2e-3
#: Quantiles are right to this share of their rank.
ACCURACY = 10_000
#: Smallest variances of the transformed statistics: 10 % in the number of words, 10 % in their mean
#: length (the error of a text of 25 words), 0.25 % symbols, 3 % repeats.
FLOOR = (0.01, 0.01, 0.0025, 0.0009)
#: Median of the chi-squared distribution with as many degrees of freedom as statistics.
CHI_MEDIAN = 3.357
#: Quantile 0.9999 of that distribution; texts beyond it are rejected.
CUT = 23.513

STATS = ("log_words", "word_length", "symbol_share", "repeat_share")
P = len(STATS)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Windows are compared by 64-bit hashes within one text."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - REPEAT_WINDOW + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, REPEAT_WINDOW)))

    def covered(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return _let(
                F.sort_array(again),
                lambda at: F.aggregate(
                    F.transform(at, lambda i, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(at, k + 1), i + REPEAT_WINDOW) - i)),
                    F.lit(0).cast("long"),
                    lambda t, x: t + x,
                ),
            )

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(_let(order, of_sorted))

    return F.when(n < REPEAT_WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def counts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measured(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(
            F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            lambda words: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
            ),
        )

    return docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), _let(text, measured).alias("c")).select("doc_id", "lang", "source", "c.*")


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MEAN = [f"m{i}" for i in range(P)]
COV = [f"c{i}{j}" for i, j in PAIRS]
LOW = [f"l{i}{j}" for i, j in PAIRS]


#: Squared Mahalanobis distance by forward substitution, each z made of those before it.
_Z = [f"({s} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i}" for i, s in enumerate(STATS)]
_D2 = " + ".join(f"z{i} * z{i}" for i in range(P))


def _shrunk(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """``child`` (a size, mean and covariance for each key) as if PRIOR texts of ``parent`` stood beside its own: the moments of that mixture."""
    both = child.join(parent.selectExpr(*on, *[f"{c} AS p_{c}" for c in MEAN + COV]), on)
    mixed = lambda c: f"p_{c} + w * ({c} - p_{c})"
    return both.withColumn("w", F.expr(f"size / (size + {PRIOR})")).selectExpr(
        *[c for c in child.columns if c not in MEAN + COV],
        *[f"{mixed(m)} AS {m}" for m in MEAN],
        *[f"{mixed(f'c{i}{j}')} + w * (1 - w) * (m{i} - p_m{i}) * (m{j} - p_m{j}) AS c{i}{j}" for i, j in PAIRS],
    )


def _rolled_up(parts: DataFrame, by: list[str]) -> DataFrame:
    """Estimates of groups put together to those of ``by``. There is a row per group, so the sums of squares about zero are few and small."""
    names = MEAN + [f"q{i}{j}" for i, j in PAIRS]
    squares = parts.selectExpr(*by, "size", *MEAN, *[f"c{i}{j} + m{i} * m{j} AS q{i}{j}" for i, j in PAIRS])
    sums = squares.groupBy(*by).agg(F.sum("size").alias("size"), *[F.expr(f"sum(size * {c}) / sum(size) AS {c}") for c in names])
    return sums.selectExpr(*by, "size", *MEAN, *[f"q{i}{j} - m{i} * m{j} AS c{i}{j}" for i, j in PAIRS])


def _factored(sums: DataFrame) -> DataFrame:
    """The Cholesky factor in place of the covariance, with floored variances, and ``log_det``."""
    low = []
    for i, j in PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        low.append(f"sqrt(greatest({rest}, {FLOOR[i]}D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return sums.selectExpr(*[c for c in sums.columns if c not in COV], *low, " + ".join(f"2 * ln(l{i}{i})" for i in range(P)) + " AS log_det")


def _hierarchical(parts: DataFrame) -> DataFrame:
    """Estimates (start, group, lang, size, mean, covariance) shrunk toward their language's, and those toward that of all."""
    all_texts = _rolled_up(parts, ["start"])
    languages = _shrunk(_rolled_up(parts, ["start", "lang"]), all_texts, ["start"])
    return _factored(_shrunk(parts, languages, ["start", "lang"])).drop("size")


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("start", "group", "lang").agg(
        F.count("*").cast("double").alias("size"), *[F.avg(s).alias(m) for s, m in zip(STATS, MEAN)], *[F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    )


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with their squared distance; those of several starts are given once for each of them."""
    return rows.join(estimate.drop("lang", "log_det"), "group").selectExpr("*", *_Z).selectExpr(*rows.columns, "start", f"{_D2} AS d2")


def _concentrated(rows: DataFrame, estimate: DataFrame, scratch: Scratch) -> DataFrame:
    """The next estimates, from the core of each group and start."""
    scratch.settle()
    near = _measured(rows, estimate)
    limit = scratch.write(near.groupBy("start", "group").agg(F.percentile_approx("d2", CORE, ACCURACY).alias("limit")))
    return scratch.write(_hierarchical(_moments(near.join(limit, ["start", "group"]).where("d2 <= limit"))))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """First estimates of each group: medians and deviations (0), spatial signs (1), hyperbolic tangents (2)."""
    median = scratch.write(rows.groupBy("group").agg(*[F.percentile_approx(s, 0.5, 1000).alias(m) for s, m in zip(STATS, MEAN)]))
    off = rows.join(median, "group")
    spread = scratch.write(
        off.groupBy("group", "lang").agg(F.count("*").cast("double").alias("size"), *[F.percentile_approx(F.abs(F.col(s) - F.col(m)), 0.5, 1000).alias(f"s{i}") for i, (s, m) in enumerate(zip(STATS, MEAN))]).join(median, "group")
    )
    sigma = [f"sqrt(greatest(pow(1.4826D * s{i}, 2), {FLOOR[i]}D)) AS g{i}" for i in range(P)]
    kept = ["group", "lang", "size", *MEAN, *[f"g{i}" for i in range(P)]]
    ahead = rows.join(spread.drop("lang"), "group").selectExpr("*", *sigma, *[f"({s} - m{i}) / g{i} AS z{i}" for i, s in enumerate(STATS)], f"greatest(sqrt({_D2}), 1e-9D) AS length")
    forms = ("z{} / length", "tanh(z{})")
    joint = ahead.groupBy(*kept).agg(*[F.expr(f"covar_pop({f.format(i)}, {f.format(j)}) AS v{k}_{i}{j}") for k, f in enumerate(forms) for i, j in PAIRS])
    # Correlations of the transformed statistics, with the deviations as scales. A constant statistic has none.
    norm = "greatest(sqrt(greatest(v{0}_{1}{1} * v{0}_{2}{2}, 0D)), 1e-12D)"
    shaped = scratch.write(joint.selectExpr(*kept, *[f"v{k}_{i}{j} / {norm.format(k, i, j)} AS r{k}_{i}{j}" for k in range(len(forms)) for i, j in PAIRS if i != j]))
    found = None
    for start in range(3):
        share = lambda i, j: "1D" if i == j else "0D" if start == 0 else f"r{start - 1}_{i}{j}"  # noqa: B023, E731
        one = shaped.selectExpr(f"{start} AS start", "group", "lang", "size", *MEAN, *[f"g{i} * g{j} * {share(i, j)} AS c{i}{j}" for i, j in PAIRS])
        found = one if found is None else found.union(one)
    return scratch.write(_hierarchical(found))


def _falling(last: DataFrame, now: DataFrame) -> DataFrame:
    """Groups whose determinant fell."""
    return last.alias("a").join(now.alias("b"), ["start", "group"]).where(f"a.log_det - b.log_det > {SAME}").select("group")


def _scales(rows: DataFrame, estimate: DataFrame, scratch: Scratch) -> DataFrame:
    """Per group the factor that brings its median distance down to that of the chi-squared distribution, shrunk like the estimates."""
    middle = _measured(rows, estimate).rollup("lang", "group").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("middle"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    middle = scratch.write(middle)
    own, lang, whole = middle.where("level = 0"), middle.where("level = 1"), middle.where("level = 3")
    # One row beside a row per group.
    joined = own.join(lang.selectExpr("lang", "middle AS middle_2", "n AS n_2"), "lang").withColumn("one", F.lit(1)).join(whole.selectExpr("1 AS one", "middle AS middle_3"), "one")
    parent = f"(n_2 * middle_2 + {PRIOR} * middle_3) / (n_2 + {PRIOR})"
    return joined.selectExpr("group", f"greatest((n * middle + {PRIOR} * {parent}) / (n + {PRIOR}) / {CHI_MEDIAN}D, 1D) AS scale")


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per group of ``rows`` (group, lang, STATS): mean and Cholesky factor, log_det, scale."""
    scratch.settle()
    estimate = _starts(rows, scratch)
    for _ in range(FIRST_STEPS):
        estimate = _concentrated(rows, estimate, scratch)
    columns = [c for c in estimate.columns if c not in ("group", "lang")]
    best = estimate.groupBy("group", "lang").agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("b"))
    # From here on there is one start.
    estimate = scratch.write(best.select("group", "lang", F.lit(0).alias("start"), *[f"b.{c}" for c in columns if c != "start"]))
    for _ in range(MOST_STEPS):
        last, estimate = estimate, _concentrated(rows, estimate, scratch)
        if _falling(last, estimate).isEmpty():
            break
    scratch.settle()
    return scratch.write(estimate.join(_scales(rows, estimate, scratch), "group").drop("start", "lang"))


def outliers(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``counted`` (of texts with words) with d2, the scaled squared distance from its group's robust estimate."""
    n = F.col("n_words")
    stats = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": F.log(F.col("word_chars") / n),
        "symbol_share": F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        "repeat_share": F.col("n_repeat_words") / n,
    }
    # Values of a language or source as JSON, which tells null from any text.
    rows = scratch.write(counted.withColumns({**stats, "group": F.to_json(F.struct("lang", "source")), "__lang": F.to_json(F.struct("lang"))}))
    found = estimates(rows.select("group", F.col("__lang").alias("lang"), *STATS), scratch)
    return rows.join(found, "group").selectExpr("*", *_Z).selectExpr(*counted.columns, f"({_D2}) / scale AS d2")


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept, d2 (null where the base rules failed)."""
    scratch = Scratch(docs.sparkSession, "quality")
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * n)
    counted = scratch.write(counts(docs).withColumn("base_failed", failed))
    passed = outliers(counted.where("not base_failed"), scratch)
    out = passed.unionByName(counted.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(F.col("d2") <= CUT, F.lit(False)).alias("kept"), "d2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).drop("d2")
