"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules reject short and self-repeating documents.  The rest are judged by a vector of transformed statistics: the
minimum-covariance-determinant estimate of each (language, source) gives a centre and a scatter that outliers do not
move, and a document goes if its squared Mahalanobis distance exceeds a chi-square cutoff.

The estimate is the deterministic and regularised kind.  From three starts (medians and spreads, the plain mean and
covariance, and the covariance of the directions from the medians) concentration steps re-estimate centre and scatter
from the share of rows that lie nearest, until the determinant falls no more; the least determinant of the starts wins.
What is minimised is the determinant of the estimate itself: the scatter of the nearest rows, made consistent, and the
squares of ``FLOORS`` on its diagonal, so that a statistic that hardly varies makes no singular matrix.

Vectors are whole multiples of ``1 / UNIT``, so that sums are exact and the same in whatever order executors add them,
and fit for up to 3e10 rows of a group; a step is one grouped aggregate over a few numbers a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage, table

#: Words, word boundaries and symbols, fixed by the contract.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30

#: Share of a group's rows that the concentration steps keep.
SHARE = 0.75
#: A step counts if the logarithm of the determinant falls by more.
GAIN = 1e-6
#: Groups with fewer rows that pass the base rules take their language's estimate, languages with fewer that of all rows.
MIN_GROUP = 60
#: Least standard deviation of each statistic: what is constant among good documents must not reject by a trifle.
FLOORS = {"length": 0.8, "word": 0.18, "symbols": 0.01, "lines": 0.07, "repeats": 0.08}
#: Squared distance beyond which a row is an outlier (the 0.99999 quantile of chi-square with 5 degrees is 30.9).
CUTOFF = 45.0
UNIT = 1024.0
STATS = tuple(FLOORS)
#: Squared distances are counted in bins of this many to a unit of the logarithm, to find the nearest share.
BINS = 64


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null text: no words.  Existing columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))

    def windows(w: Column) -> Column:
        """Hashes of all 8-word windows, doubling the width three times; the last hashes of the array take in nulls and go."""
        def widened(k: int):
            return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))

        wider = F.transform(w, lambda x: F.xxhash64(x))
        for k in (1, 2, 4):
            wider = let(wider, widened(k))
        return F.slice(wider, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))

    def repeated(h: Column) -> Column:
        """Words covered by windows that occur twice or more."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(F.transform(s, lambda p, k: F.struct(
            p["i"].alias("i"), ((F.get(s, k - 1)["x"] == p["x"]) | (F.get(s, k + 1)["x"] == p["x"])).alias("t"))), lambda p: p["t"]), lambda p: p["i"]))
        covered = let(F.array_sort(twice), lambda at: F.aggregate(F.transform(at, lambda i, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - i), F.lit(WINDOW))), F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered)

    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), let(windows(w), repeated).alias("r")))
    out = docs.withColumns({
        "_w": of_words,
        "n_symbols": (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long"),
        "_l": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
    })
    out = out.withColumns({"n_words": F.col("_w")["n"], "word_chars": F.col("_w")["c"], "n_repeat_words": F.col("_w")["r"], "n_dup_lines": F.col("_l")["d"], "_lines": F.col("_l")["n"]}).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def vectors(df: DataFrame) -> DataFrame:
    """df with the transformed statistics v0 .. v4 as whole numbers of 1 / UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = {
        "length": F.log1p("n_words"),
        "word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) * 2,
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "lines": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
    }
    return df.withColumns({f"v{i}": F.round(raw[k] * UNIT).cast("long") for i, k in enumerate(STATS)})


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


MEANS, FACTOR = [f"m{i}" for i in range(P)], [f"l{i}{j}" for i, j in PAIRS]
KEY = ["_lang", "_source"]


def _factor(groups: DataFrame) -> DataFrame:
    """groups with the Cholesky factor of c_ij and the floors, and the logarithm of its determinant."""
    out = groups
    for i in range(P):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + (FLOORS[STATS[i]] * UNIT) ** 2)
    for j in range(P):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(1e-6))))
        for i in range(j + 1, P):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", 2 * sum((F.log(f"l{j}{j}") for j in range(1, P)), F.log("l00")))


def _sums() -> list[Column]:
    return [F.sum(f"v{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}{j}") for i, j in PAIRS]


def _moments(groups: DataFrame, stretch: float) -> DataFrame:
    """groups with means m_i and stretched covariances c_ij from n, sums s_i and q_ij."""
    out = groups.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    return out.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * stretch for i, j in PAIRS})


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        y.append((F.col(f"v{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * y[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((x * x for x in y[1:]), y[0] * y[0])


def _starts(rows: DataFrame, least: int) -> DataFrame:
    """A row a group of at least so many rows and start: size, centre, factor."""
    middle = rows.groupBy(*KEY).agg(F.count("*").alias("size"), *[F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i in range(P)]).where(f"size >= {least}")
    for i in range(P):
        spread = F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOORS[STATS[i]] * UNIT))
        middle = middle.withColumns({f"m{i}": F.col(f"p{i}")[1].cast("double"), f"d{i}": spread.cast("double")})
    middle = stage(middle.select(*KEY, "size", *MEANS, *[f"d{i}" for i in range(P)]), "medians")
    shape = ["size", *MEANS, *FACTOR]
    zero = lambda i, j: F.col(f"d{i}") if i == j else F.lit(0.0)
    by_spread = middle.select(*KEY, F.lit(0).alias("start"), "size", *MEANS, *[zero(i, j).alias(f"l{i}{j}") for i, j in PAIRS])
    z = [(F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(P)]
    length = F.greatest(sum((x * x for x in z[1:]), z[0] * z[0]), F.lit(1e-9))
    turns = [F.sum(F.round(z[i] * z[j] / length * (1 << 20)).cast("long")).alias(f"t{i}{j}") for i, j in PAIRS]
    seen = join_groups(rows, middle).where("size is not null").groupBy(*KEY).agg(F.count("*").alias("n"), *_sums(), *turns)
    seen = stage(seen.join(middle, KEY), "moments")
    plain = _factor(_moments(seen.drop(*MEANS), 1.0)).select(*KEY, F.lit(1).alias("start"), *shape)
    turned = seen.withColumns({f"c{i}{j}": F.col(f"t{i}{j}") / F.col("n") / (1 << 20) * P * F.col(f"d{i}") * F.col(f"d{j}") for i, j in PAIRS})
    turned = _factor(turned).select(*KEY, F.lit(2).alias("start"), *shape)
    return by_spread.unionByName(plain).unionByName(turned)


def estimates(rows: DataFrame, share: float = SHARE, least: int = MIN_GROUP) -> DataFrame:
    """Centre, Cholesky factor and logdet of each (_lang, _source) with at least so many rows ``(_lang, _source, v0 ..)``.

    The table has a row a group.  A step bins the distances, finds in each group the bin at which the share is reached,
    and sums over the rows up to it; the bins of a group are few hundred whatever the rows are.  A group's start goes on
    until a step doesn't lower its determinant, and each step must lower it by ``GAIN``: the steps come to an end.
    """
    key = [*KEY, "start"]
    now = stage(_starts(rows, least).withColumns({"logdet": F.lit(float("inf")), "open": F.lit(True)}), "mcd")
    while not now.where("open").isEmpty():
        far = join_groups(rows, now.where("open")).where("size is not null").withColumn("bin", F.floor(F.log1p(_distance()) * BINS))
        seen = far.groupBy(*key, "bin").agg(F.count("*").alias("n"), F.first("size").alias("size"), *_sums())
        # the bins of a group meet in its window: at most BINS times the logarithm's range of them
        before = F.sum("n").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        near = seen.withColumn("before", before).where(F.col("before") < share * F.col("size"))
        sums = near.groupBy(*key).agg(F.first("size").alias("size"), *[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]])
        # the nearest share of a normal sample is narrower than the whole: 1 / factor for 5 dimensions and this share
        made = _factor(_moments(sums, consistency(share)))
        state = ["size", *MEANS, *FACTOR, "logdet"]
        both = now.select(*key, F.struct(*state, "open").alias("old")).join(made.select(*key, F.struct(*state, F.lit(True).alias("open")).alias("new")), key, "left")
        fell = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - GAIN, F.lit(False))
        closed = F.col("old").withField("open", F.lit(False))
        old, now = now, stage(both.select(*key, F.when(fell, F.col("new")).otherwise(closed).alias("x")).select(*key, "x.*"), "mcd")
        discard(old)
    best = now.groupBy(*KEY).agg(F.min(F.struct("logdet", "start", "size", *MEANS, *FACTOR)).alias("x"))
    return best.select(*KEY, "x.size", *[f"x.{c}" for c in [*MEANS, *FACTOR]], "x.logdet")


def consistency(share: float) -> float:
    """share / P(chi-square with P + 2 degrees below the share's quantile of chi-square with P degrees)."""
    import math

    def cdf(x: float, k: int) -> float:  # odd k
        t = math.erf(math.sqrt(x / 2))
        term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for d in range(1, k - 1, 2):
            t -= term
            term *= x / (d + 2)
        return t

    low, high = 0.0, 200.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, P) < share else (low, mid)
    return share / cdf(low, P + 2)


#: Groups up to which their table is broadcast; beyond, Spark joins by the key and splits hot ones.
BROADCAST_GROUPS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, KEY, "left")


MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of docs' columns ``keep``, all by default) with the statistics, base_failed, distance2 and kept.

    Needs columns lang and source; nulls there form groups of their own.  Documents that fail the base rules take no part
    in the estimates.  Groups of under ``MIN_GROUP`` rows are judged by the estimate of their language, and if that has
    too few rows as well, by that of all rows, however few.  Repeated rows are judged each; long texts are taken whole;
    no rows: no rows.
    """
    keep = list(docs.columns) if keep is None else keep
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # docs' columns travel within a struct: whatever their names, they don't meet those made here
    bare = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("_text"), group("lang").alias("_lang"), group("source").alias("_source"))
    with_stats = vectors(base_statistics(bare, "_text"))
    rows = stage(with_stats.select("row", *MADE, *KEY, *[f"v{i}" for i in range(P)]), "statistics")
    good = rows.where("not base_failed").select(*KEY, *[f"v{i}" for i in range(P)])
    found = estimates(good)
    # for groups that have none: their language's, else that of all
    left = stage(rows.select(*KEY).distinct().join(found, KEY, "left_anti"), "small-groups")
    if not left.isEmpty():
        langs = left.select("_lang").distinct()
        pooled = stage(estimates(good.join(langs, "_lang", "left_semi").withColumn("_source", F.lit(""))).drop("_source"), "mcd-languages")
        found = found.unionByName(left.join(pooled, "_lang"))
        left = left.join(pooled, "_lang", "left_anti")
        if not left.isEmpty():
            every = estimates(good.withColumns({"_lang": F.lit(""), "_source": F.lit("")}), least=1).drop(*KEY)
            found = found.unionByName(left.withColumn("_one", F.lit(1)).join(every.withColumn("_one", F.lit(1)), "_one").drop("_one"))  # one estimate
    out = join_groups(rows, stage(found, "mcd-all")).withColumn("distance2", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF)).select("row", *MADE, "distance2", "kept")


def op4(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", *MADE, "distance2", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, in their own columns."""
    return judged(docs).where("kept").select("row.*")
