"""Rules on text statistics and robust multivariate outliers per language and source. DataFrame functions only.

A small group is held against its language, a small language against all rows, and few rows in all against PRIOR.

Minimum covariance determinant: from several starts (medians and quartile spreads, the rows in the central box, all rows)
concentration steps keep the three quarters of a group's rows with the smallest Mahalanobis distance and estimate mean and
covariance from them again. After some steps each group goes on with the start whose determinant is the smallest, until no
group's determinant falls any more. All estimates are mergeable aggregates, so a hot group is pre-aggregated in every task;
the matrices are factored by Cholesky in column expressions.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, maybe_in, stage, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
#: Share of a group's rows that the estimates rest on, and rows below which a group uses the next wider estimate.
SHARE, LEAST = 0.75, 60
#: Concentration steps with all starts, most steps after those, and the fall of a log determinant that counts as none.
STEPS, MOST_STEPS, STILL = 2, 12, 1e-3
#: Files of a table of estimates: a row a group, so small that size-based broadcasts see it as such.
FILES = 4
#: Chance that a clean Gaussian row is rejected.
ALPHA = 1e-9
#: Least standard deviation of each transformed statistic: many groups have no spread at all in some of them.
FLOOR = (0.05, 0.15, 0.15, 0.1)
#: Means and standard deviations of prose where there are under LEAST rows in all: wider than what sf0.001 and sf0.01 give over all rows.
PRIOR = ((1.61, 0.15), (0.0, 0.2), (0.24, 0.2), (0.0, 0.12))
DIM = len(FLOOR)
X = [f"x{i}" for i in range(DIM)]
PAIRS = list(combinations_with_replacement(range(DIM), 2))


def _repeat_words() -> Column:
    """Words in 8-word windows that occur twice or more: sort (hash, place), keep places beside an equal hash, measure their union."""
    n = F.size("_h")
    # single elements, since a slice copies the whole array each time; _h is named more than once, since a column that is
    # used once would be inlined into the lambda and computed for each window
    hashed = lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)])
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    s = F.col("_s")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
    at = F.col("_at")
    union = F.aggregate(
        at, F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["total"] + F.least(F.lit(WINDOW), p - a["last"])).cast("bigint").alias("total"), p.alias("last")),
        lambda a: a["total"],
    )
    return windows, twice, union


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs plus the base statistics, base_failed and the transformed vector x0..x3 (names of docs must not clash with these)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    windows, twice, union = _repeat_words()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    out = docs.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    out = out.withColumn("_s", F.array_sort(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    out = out.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"]))).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": (F.length(F.regexp_replace(text, SPACES, ""))).cast("bigint"),
        "n_symbols": count(r"[#*$%&|<>]").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": union,
        "_upper": count(r"\p{Lu}").cast("bigint"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    # Short texts are drawn to the middle, so that chance does not make them outliers.
    n, c = F.col("n_words"), F.col("word_chars")
    out = out.withColumns({
        "x0": F.log((c + 500.0) / (n + 100.0)),
        "x1": F.asinh(F.col("n_symbols") * 50.0 / (c + 500.0)),
        "x2": F.asinh(F.col("_upper") * 20.0 / (c + 500.0)),
        "x3": F.sqrt(F.col("n_repeat_words") / (n + 20.0)),
    })
    return out.drop("_w", "_h", "_s", "_at", "_lines", "_upper")


def _chi2(x: float, k: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    h, term, total = x / 2, 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= h / (i + 1)
    return 1 - math.exp(-h) * total


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return low


CUTOFF = _chi2_quantile(1 - ALPHA, DIM)
#: Makes the covariance of the central share consistent for Gaussian rows.
CONSISTENT = SHARE / _chi2(_chi2_quantile(SHARE, DIM), DIM + 2)


def distance(params: str = "_p") -> Column:
    """Squared Mahalanobis distance of x0.. by forward substitution with the factor l_ij in a struct column."""
    y: list[Column] = []
    for i in range(DIM):
        rest = F.col(X[i]) - F.col(f"{params}.m{i}")
        for j in range(i):
            rest = rest - F.col(f"{params}.l{i}{j}") * y[j]
        y.append(rest / F.col(f"{params}.l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factored(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Means m_i and covariances c_ij (j <= i) to means and the Cholesky factor, with the floor added to the diagonal."""
    out = estimates
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * CONSISTENT + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit((FLOOR[i] / 10) ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    cols = [f"m{i}" for i in range(DIM)] + [f"l{i}{j}" for j, i in PAIRS]
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, DIM)), 2 * F.log("l00"))
    return out.select(*keys, F.struct(*cols).alias("_p"), "_n", logdet.alias("_det"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)] + [F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for j, i in PAIRS]
    return rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *sums)


def _concentrated(both: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every (group, start) in params."""
    keys = ["_l", "_g", "_s"]
    far = both.join(params, ["_l", "_g"]).withColumn("_d", distance())
    cut = stage(far.groupBy(*keys).agg(F.percentile_approx("_d", SHARE, 1000).alias("_cut")).coalesce(FILES), "mcd-cut")
    core = far.select(*keys, "_n", "_d", *X).join(cut, keys).where(F.col("_d") <= F.col("_cut"))
    out = stage(_factored(_moments(core, keys), keys).coalesce(FILES), "mcd")
    discard(cut)
    return out


def fit(rows: DataFrame) -> DataFrame:
    """(lang, source, _p, _n) from rows with lang, source and x0..: one robust estimate for each pair that has LEAST rows,
    one a language (_g "*") and one over all rows (_l "*" too) for the rest. rows must be cheap to read again."""
    # null keys are groups of their own; the marks keep them apart from the wider estimates
    keyed = rows.select(_key("lang").alias("_l"), _key("source").alias("_g"), F.lit("*").alias("_all"), *X)
    both = keyed.withColumn("_k", F.explode(F.array(*[F.struct(F.col(a).alias("_l"), F.col(b).alias("_g")) for a, b in (("_l", "_g"), ("_l", "_all"), ("_all", "_all"))])))
    both = both.select("_k.*", *X)
    keys = ["_l", "_g"]
    wide = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(X)])
    wide = stage(wide.where((F.col("_n") >= LEAST) | (F.col("_g") == "*")).coalesce(FILES), "mcd-quartiles")
    spread = {f"c{i}{j}": (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) / CONSISTENT if i == j else F.lit(0.0)) for j, i in PAIRS}
    middle = wide.withColumns({f"m{i}": F.col(f"q{i}")[1] for i in range(DIM)} | spread)
    boxed = both.join(wide, keys)
    inside = [F.abs(F.col(x) - F.col(f"q{i}")[1]) <= F.col(f"q{i}")[2] - F.col(f"q{i}")[0] for i, x in enumerate(X)]
    starts = [middle, _moments(boxed.where(reduce(Column.__and__, inside)), keys), _moments(boxed, keys)]
    params = stage(reduce(DataFrame.unionByName, [_factored(s, keys).withColumn("_s", F.lit(i)) for i, s in enumerate(starts)]).coalesce(FILES), "mcd")
    discard(wide)
    for _ in range(STEPS):
        before, params = params, _concentrated(both, params)
        discard(before)
    best = params.groupBy(*keys).agg(F.min_by(F.struct("_s", "_p", "_n", "_det"), F.struct("_det", "_s")).alias("_b")).select(*keys, "_b.*")
    before, params = params, stage(best.coalesce(FILES), "mcd")
    discard(before)
    for _ in range(MOST_STEPS):
        before, params = params, _concentrated(both, params)
        fall = before.select(*keys, F.col("_det").alias("_old")).join(params, keys).agg(F.max(F.col("_old") - F.col("_det"))).first()[0]
        discard(before)
        if fall is None or fall < STILL:
            break
    return params


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))


def judge(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows plus mahalanobis2 and kept, by the narrowest estimate that rests on LEAST rows, or else by PRIOR."""
    own = params.where(F.col("_g") != "*").select("_l", "_g", F.col("_p").alias("_own"))
    wide = params.where((F.col("_g") == "*") & (F.col("_l") != "*") & (F.col("_n") >= LEAST)).select("_l", F.col("_p").alias("_wide"))
    every = params.where((F.col("_l") == "*") & (F.col("_n") >= LEAST)).select(F.col("_p").alias("_every"))
    prior = F.struct(*[F.lit(m).alias(f"m{i}") for i, (m, _) in enumerate(PRIOR)], *[F.lit(PRIOR[i][1] if i == j else 0.0).alias(f"l{i}{j}") for j, i in PAIRS])
    keyed = rows.withColumns({"_l": _key("lang"), "_g": _key("source")})
    # both tables hold a row a group; the optimizer broadcasts them while they are below its threshold
    joined = keyed.join(own, ["_l", "_g"], "left").join(wide, "_l", "left").join(F.broadcast(every), F.lit(True), "left")
    joined = joined.withColumn("_p", F.coalesce("_own", "_wide", "_every", prior))
    d = distance()
    return joined.withColumns({"mahalanobis2": d, "kept": ~F.col("base_failed") & (d <= CUTOFF)}).drop("_l", "_g", "_own", "_wide", "_every", "_p")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, mahalanobis2. Null or empty texts have no words and fail the base rules."""
    rows = stage(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    out = judge(rows, fit(rows.where(~F.col("base_failed")).select("lang", "source", *X)))
    return out.select("doc_id", *BASE, "base_failed", "kept", "mahalanobis2")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names.

    Verdicts follow from text, language and source alone, so statistics are written under 128 bits of these, without the
    texts, and what is kept is read from docs, which must read the same again. Only rows that may go meet in a join.
    """
    held = ("text", "lang", "source")
    rows = stage(with_statistics(docs.select(*[_hash(i).alias(f"_k{i}") for i in (1, 2)], *held)).drop("text"), "quality")
    params = fit(rows.where(~F.col("base_failed")).select("lang", "source", *X))
    gone = stage(judge(rows, params).where(~F.coalesce("kept", F.lit(False))).select("_k1", "_k2").distinct(), "gone")
    discard(rows, params)
    keyed = docs.select(*[_hash(i).alias(f"_k{i}") for i in (1, 2)], F.struct(*docs.columns).alias("_doc"))
    asked = maybe_in(keyed, "_k1", gone.select("_k1")).join(gone, ["_k1", "_k2"], "left_anti")
    return maybe_in(keyed, "_k1", gone.select("_k1"), inside=False).unionByName(asked).select("_doc.*")


def _hash(seed: int) -> Column:
    """Equal for rows that the rules can't tell apart: a null text is an empty one."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("text"), F.lit("")), _key("lang"), _key("source"))
