"""Quality rules and robust multivariate outliers, in DataFrame expressions only.

Each text gets counting statistics and two plain rules.  The statistics are turned
into a vector of ratios on scales that spread them evenly.  For every language and
source, a minimum covariance determinant estimate of mean and covariance is found by
concentration steps: distances, the half of the rows with the smallest distances
((n + p + 1) / 2 of n rows and p statistics, so that just under half of a group may be
junk), their mean and covariance, again distances, until the determinant stops
falling.  Two starts are taken (medians with median deviations; plain mean and
covariance) and the estimate of the smallest determinant wins.  A document whose
squared Mahalanobis distance is above ``CUTOFF`` is rejected.

Every step is an aggregation that is combined in the tasks before its shuffle (sums,
products, quantile sketches), so a hot source is no hot task.  The group tables have
one row per language and source, or per cell: a group, a language or all rows.

Defined results: null or empty text has zero counts and fails the rule on words; null
languages and sources are groups of their own; a group of fewer than ``MIN_ROWS`` rows
has the estimate of its language, or of all rows if its language is as small, so
every document is measured at every table size; equal rows get equal verdicts; an empty table
gives no rows; clashing input columns are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import SPACE_WORD, stash

SHINGLE = 5
GROUP = ["lang", "source"]
SYMBOLS = "#*$%&|<>"
# Transformed statistics and the least standard deviation each is given: smaller
# spreads are no evidence against a document.
FEATURES = {"f_length": 0.10, "f_symbols": 0.06, "f_lines": 0.15, "f_repeats": 0.15, "f_upper": 0.08}
# A fall of the log determinant up to this ends the steps of a group.
LEAST_FALL = 1e-3
MIN_ROWS = 50
# Chi-square, 5 degrees of freedom: exceeded with probability 0.0001.
CUTOFF = 25.74
ACCURACY = 2000


def _chi_square(x: float, k: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    term, rest = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for j in range(1, k, 2):
        rest += term
        term *= x / (j + 2)
    return math.erf(math.sqrt(x / 2)) - rest


def consistency(share: float) -> float:
    """``share`` over the part of the variance that the nearest ``share`` of normal rows sees."""
    p = len(FEATURES)
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, p) < share else (low, mid)
    return 1.0 if share >= 1 else share / _chi_square(high, p + 2)


# Core sizes in hundredths of the rows, and their factors.
SHARES = [k / 100 for k in range(50, 101)]
FACTORS = [consistency(x) for x in SHARES]


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines and n_upper."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_text", text).withColumn("_w", F.regexp_extract_all("_text", F.lit(SPACE_WORD), F.lit(0)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACE_WORD))
    d = d.withColumn("_lines", lines)
    w = F.col("_w")
    whole = F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
    key = F.transform(whole, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
    d = d.withColumn("_keys", key)
    twice = F.size(F.array_distinct("_keys")) < F.size("_keys")
    place = F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    none = F.array().cast("array<struct<k:bigint,i:int>>")
    d = d.withColumn("_sorted", F.when(twice, F.sort_array(place)).otherwise(none))
    s = F.col("_sorted")
    again = F.filter(
        s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
    )
    d = d.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col("_at")
    # words covered: each window adds those up to the next window's start
    covered = F.transform(at, lambda x, j: F.least(F.lit(SHINGLE), F.coalesce(F.get(at, j + 1) - x, F.lit(SHINGLE))))
    chars = F.length("_text")
    return d.select(
        *[c for c in docs.columns if c not in COUNTED],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (chars - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )


COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def features(counted: DataFrame) -> DataFrame:
    """Add the vector; an empty text has all zeros."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.withColumns(
        {
            "f_length": F.log1p(ratio("word_chars", "n_words")),
            "f_symbols": F.sqrt(ratio("n_symbols", "word_chars")),
            "f_lines": F.sqrt(ratio("n_dup_lines", "n_lines")),
            "f_repeats": F.sqrt(ratio("n_repeat_words", "n_words")),
            "f_upper": F.sqrt(ratio("n_upper", "word_chars")),
        }
    )


def _same_group(left: DataFrame, right: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Join a group table on the null-safe group."""
    right = right.withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by))
    return left.join(right, on).drop(*(f"_g_{c}" for c in by))


def _factor(groups: DataFrame, by: list[str]) -> DataFrame:
    """Cholesky factor l_i_j and log determinant of c_i_j plus the least variances."""
    names = list(FEATURES)
    p = len(names)
    for i in range(p):
        for j in range(i + 1):
            rest: Column = F.col(f"c_{j}_{i}")
            if i == j:
                rest = rest + F.lit(FEATURES[names[i]] ** 2)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}")
            groups = groups.withColumn(f"l_{i}_{j}", value)
    logdet = reduce(lambda a, b: a + b, (2 * F.log(f"l_{i}_{i}") for i in range(p)))
    keep = [*by, *(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1))]
    return groups.select(*keep, logdet.alias("logdet"))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and covariance (times ``_scale``) of each group, factored."""
    names = list(FEATURES)
    p = len(names)
    got = rows.groupBy(*by).agg(
        *(F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)),
        *(
            (F.covar_pop(names[j], names[i]) * F.max("_scale")).alias(f"c_{j}_{i}")
            for i in range(p)
            for j in range(i + 1)
        ),
    )
    return stash(_factor(got, by))


def distances(rows: DataFrame, groups: DataFrame, by: list[str] = GROUP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution, and the
    ``carry`` columns of the groups (a row for each estimate of its group)."""
    d = _same_group(rows, groups.drop("logdet"), by=by)
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        d = d.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, (F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(FEATURES))))
    return d.withColumn("d2", d2).select(*rows.columns, *carry, "d2")


def _core(measured: DataFrame, by: list[str]) -> DataFrame:
    """The (n + p + 1) / 2 rows of each group with the smallest distances."""
    more = F.ceil(F.lit(50.0 * (len(FEATURES) + 1)) / F.count("*"))
    cut = measured.groupBy(*by).agg(
        F.percentile_approx("d2", SHARES, ACCURACY).alias("_cuts"), F.least(more, F.lit(50)).cast("int").alias("_at")
    )
    factors = F.array(*(F.lit(x) for x in FACTORS))
    cut = cut.select(*by, F.get("_cuts", F.col("_at")).alias("_cut"), F.get(factors, F.col("_at")).alias("_scale"))
    return _same_group(measured, stash(cut), by=by).where(F.col("d2") <= F.col("_cut")).drop("_cut", "d2")


def _median_start(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the distance from the medians in units of median deviations."""
    names = list(FEATURES)
    mid = rows.groupBy(*by).agg(*(F.percentile_approx(x, 0.5, ACCURACY).alias(f"_m{i}") for i, x in enumerate(names)))
    d = _same_group(rows, stash(mid), by=by)
    mad = d.groupBy(*by).agg(
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"_m{i}")), 0.5, ACCURACY).alias(f"_s{i}") for i, x in enumerate(names))
    )
    d = _same_group(d, stash(mad), by=by)
    unit = lambda i, x: (F.col(x) - F.col(f"_m{i}")) / F.greatest(1.4826 * F.col(f"_s{i}"), F.lit(FEATURES[x]))
    d2 = reduce(lambda a, b: a + b, (unit(i, x) * unit(i, x) for i, x in enumerate(names)))
    return d.withColumn("d2", d2).select(*rows.columns, "d2")


def _cells(rows: DataFrame) -> DataFrame:
    """lang, source, cell (whose estimate the group has), member (a cell its rows are
    part of, if any group has that cell's estimate): one row per member."""
    size = stash(rows.groupBy(*GROUP).agg(F.count("*").alias("_rows")))
    lang = size.groupBy("lang").agg(F.sum("_rows").alias("_lang_rows"))
    # as JSON, which leaves nulls out: a key that is never null
    keys = [F.to_json(F.struct(F.lit(k).alias("level"), *cols)) for k, cols in enumerate((GROUP, ["lang"], []))]
    cell = F.when(F.col("_rows") >= MIN_ROWS, keys[0]).when(F.col("_lang_rows") >= MIN_ROWS, keys[1]).otherwise(keys[2])
    groups = stash(_same_group(size, lang, by=["lang"]).select(*GROUP, cell.alias("cell"), F.array(*keys).alias("_keys")))
    used = groups.select(F.col("cell").alias("member")).distinct()
    return stash(groups.withColumn("member", F.explode("_keys")).drop("_keys").join(used, "member"))


def estimates(rows: DataFrame) -> DataFrame:
    """One robust mean and factored covariance per group: its own if it has enough rows,
    else that of its language or of all rows."""
    cells = _cells(rows)
    rows = _same_group(rows, cells.select(*GROUP, F.col("member").alias("cell"))).drop(*GROUP)
    by = ["cell", "_start"]
    plain = _moments(rows.withColumn("_scale", F.lit(1.0)), ["cell"])
    starts = [d.withColumn("_start", F.lit(k)) for k, d in enumerate((_median_start(rows, ["cell"]), distances(rows, plain, ["cell"])))]
    last = _moments(_core(starts[0].unionByName(starts[1]), by), by)
    found = [last]
    while not last.isEmpty():  # the determinants are bounded below by the least deviations
        now = _moments(_core(distances(rows, last, ["cell"], ("_start",)), by), by)
        found.append(now)
        before = last.select(*by, F.col("logdet").alias("_before"))
        last = stash(_same_group(now, before, by=by).where(F.col("_before") - F.col("logdet") > LEAST_FALL).drop("_before"))
    every = reduce(DataFrame.unionByName, found)
    value = F.struct("logdet", "_start", *(c for c in last.columns if c not in (*by, "logdet")))
    best = stash(every.groupBy("cell").agg(F.min(value).alias("_v")).select("cell", "_v.*").drop("_start"))
    return stash(cells.select(*GROUP, "cell").distinct().join(best, "cell").drop("cell"))


def judge(counted: DataFrame) -> DataFrame:
    """Add base_failed, d2 and kept to counted documents."""
    counted = counted.drop("base_failed", "d2", "kept")
    rows = features(counted)
    groups = estimates(rows.select(*GROUP, *FEATURES))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        distances(rows, groups)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF))
        .select(*counted.columns, "base_failed", "d2", "kept")
    )


def screen_documents(docs: DataFrame) -> DataFrame:
    """Verdicts on all documents: doc_id, lang, source, counts, base_failed, d2, kept."""
    return judge(stash(counts(docs.select("doc_id", "text", *GROUP)).drop("text")))
