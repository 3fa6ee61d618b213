"""Operator 8, quality rules: base counts, then minimum-covariance-determinant outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import checkpoint, few, table, words_of

SYMBOLS = "#*$%&|<>"
#: Statistics are held as whole numbers of 1/SCALE, so that their sums do not depend on the order of rows.
SCALE = 256
FEATURES = ("q_length", "q_symbols", "q_lines", "q_repeats")
#: Least standard deviation of each feature, in octaves: a statistic that is the same nearly everywhere still has a scale.
#: Its square is added to the variance. As a mere lower bound it would let a mixture along a line have the least determinant.
FLOOR = (0.25, 1.0, 1.0, 1.0)
#: Share of a group that the covariance determinant is made least over, and its correction for four normal features.
SHARE, CORRECTION = 0.5, 2.109
#: The last estimate is over all vectors within this squared distance, 97.5 % of normal ones, with its own correction.
NEAR, NEAR_CORRECTION = 11.143, 1.0645
#: Concentration starts from the centres at these quantiles of each feature, and from mean and covariance.
QUANTILES = (0.5, 0.25, 0.75)
#: It ends when a step lowers the logarithm of the determinant by no more than this.
CONVERGED = 1e-3
#: A vector is rejected beyond this squared Mahalanobis distance, which four normal features pass once in 20,000 rows.
CUTOFF = 25.0
#: A group with fewer passing rows is judged by the estimate of its language, a language with fewer by that of the whole table.
LEAST_ROWS = 40
#: Estimates are broadcast up to this many groups, 200 bytes each; more groups are joined by a shuffle.
BROADCAST_GROUPS = 40_000


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the q_ columns: counts, base verdict, group and features. All in one pass over each text, without a shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumns({"q_words": words_of(F.col("text").cast("string")), "q_text": text})
    spaces = "\x20\x09\x0a\x0b\x0c\x0d"
    lines = F.filter(F.split("q_text", "\n"), lambda x: F.translate(x, spaces, "") != "")
    docs = docs.withColumns({
        "q_n": F.size("q_words").cast("long"),
        "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
        "q_chars": F.length(F.translate("q_text", spaces, "")).cast("long"),
        "q_n_symbols": (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long"),
        "q_all_lines": lines,
    })
    h = F.col("q_hashes")
    grams = F.transform(F.sequence(F.lit(0), F.size("q_hashes") - 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))
    docs = docs.withColumns({"q_grams": F.when(F.size("q_hashes") >= 5, grams).otherwise(F.array().cast("array<bigint>")), "q_n_dup": (F.size("q_all_lines") - F.size(F.array_distinct("q_all_lines"))).cast("long")})
    # Only a text in which some window comes again is sorted.
    ordered = F.array_sort(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_grams")) < F.size("q_grams"), ordered).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    s = F.col("q_sorted")
    again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    covered = F.aggregate(starts, start, lambda a, x: F.struct((a["n"] + 5 - F.greatest(F.lit(0), a["end"] - x)).cast("long").alias("n"), (x + 5).cast("int").alias("end")), lambda a: a["n"])
    docs = docs.withColumn("q_n_repeat", covered).drop("q_words", "q_text", "q_hashes", "q_all_lines", "q_grams", "q_sorted")
    n = F.greatest(F.col("q_n"), F.lit(1))

    def octaves(x: Column) -> Column:
        return F.round(F.log2(x) * SCALE).cast("long")

    return docs.withColumns({
        "q_failed": (F.col("q_n") < 10) | (100 * F.col("q_n_repeat") > 20 * F.col("q_n")),
        "q_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "q_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "q_length": octaves(1 + F.col("q_chars") / n),
        "q_symbols": octaves(1 + 100 * F.col("q_n_symbols") / n),
        "q_lines": octaves(1 + 100 * F.col("q_n_dup") / n),
        "q_repeats": octaves(1 + 100 * F.col("q_n_repeat") / n),
    })


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(vectors, pairs, number of groups) of the rows that pass the base rules.

    vectors: the distinct feature vectors of each group g that is estimated, each with its number k of rows.
    pairs: each language and source with its g, the array of both, of the language alone, or of nothing.
    """
    vectors = checkpoint(rows.groupBy("q_lang", "q_source", *FEATURES).agg(F.count("*").alias("k")), small=True)
    pairs = few(vectors.groupBy("q_lang", "q_source").agg(F.sum("k").alias("n")))
    langs = few(pairs.groupBy("q_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least")))
    own, lang, whole = F.array("q_lang", "q_source"), F.array("q_lang"), F.array().cast("array<string>")
    pairs = checkpoint(pairs.join(langs, "q_lang").withColumn("g", F.when(F.col("n") >= LEAST_ROWS, own).when(F.col("n_lang") >= LEAST_ROWS, lang).otherwise(whole)), small=True)
    n_groups = few(pairs.select("g").distinct()).count()
    any_whole = F.lit(pairs.where(F.size("g") == 0).limit(1).count() > 0)
    by_lang = (F.col("least") < LEAST_ROWS) & (F.col("n_lang") >= LEAST_ROWS)
    of = F.array_compact(F.array(F.when(F.size("g") == 2, own), F.when(by_lang, lang), F.when(any_whole, whole)))
    vectors = vectors.join(pairs, ["q_lang", "q_source"]).select(F.explode_outer(of).alias("g"), *FEATURES, "k")
    return checkpoint(vectors.groupBy("g", *FEATURES).agg(F.sum("k").alias("k")), small=True), pairs.select("q_lang", "q_source", "g"), n_groups


def _estimate(vectors: DataFrame, keys: list[str], correction: float) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of the covariance of each group, from exact whole-number sums."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    sums = few(vectors.groupBy(*keys).agg(
        F.sum("k").alias("n"),
        *[F.sum(F.col("k") * F.col(x)).alias(f"s{i}") for i, x in enumerate(FEATURES)],
        *[F.sum((F.col("k") * F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(38,0)")).alias(f"p{i}{j}") for i, j in pairs],
    ))
    mean = [F.col(f"s{i}") / F.col("n") / SCALE for i in range(4)]
    cov = {(i, j): F.col(f"p{i}{j}").cast("double") / F.col("n") / SCALE**2 - mean[i] * mean[j] for i, j in pairs}
    out = sums.select(
        *keys,
        *[mean[i].alias(f"m{i}") for i in range(4)],
        *[(cov[i, j] * correction + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs],
    )
    # Cholesky's factor l and its inverse w, on the few rows of estimates: d2 is then the squared length of w (x - m).
    for i, j in pairs:
        left = F.col(f"c{i}{j}")
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-3))) if i == j else left / F.col(f"l{j}{j}"))
    for j in range(4):
        for i in range(j, 4):
            left = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                left = left - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", left / F.col(f"l{i}{i}"))
    det = 2 * F.log(F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33"))
    return out.select(*keys, *[f"m{i}" for i in range(4)], *[f"w{i}{j}" for i, j in pairs], det.alias("det"))


def _with_distance(rows: DataFrame, estimates: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance; null where there is no estimate."""
    joined = rows.join(F.broadcast(estimates) if n_groups <= BROADCAST_GROUPS else estimates, keys, "left")
    apart = [F.col(x) / SCALE - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    white = [sum((F.col(f"w{i}{j}") * apart[j] for j in range(1, i + 1)), F.col(f"w{i}0") * apart[0]) for i in range(4)]
    return joined.withColumn("d2", sum((z * z for z in white[1:]), white[0] * white[0]))


def _starts(vectors: DataFrame, n_groups: int) -> DataFrame:
    """(g, start, estimate): mean and covariance, and for each of QUANTILES the centre there with the median distance from it as scale.

    Quantiles are exact: they count the whole-number values of each feature.
    """
    k, n = F.col("k"), len(QUANTILES)
    centres = few(vectors.groupBy("g").agg(*[F.percentile(x, list(QUANTILES), k).alias(f"h{i}") for i, x in enumerate(FEATURES)]))
    apart = vectors.join(F.broadcast(centres) if n_groups <= BROADCAST_GROUPS else centres, "g")
    scales = [F.percentile(F.abs(F.col(x) - F.get(f"h{i}", F.lit(q))), 0.5, k).alias(f"a{i}{q}") for i, x in enumerate(FEATURES) for q in range(n)]
    found = few(apart.groupBy("g").agg(*[F.first(f"h{i}").alias(f"h{i}") for i in range(4)], *scales))

    def values(q: int) -> list[Column]:
        sds = [F.greatest(1.4826 * F.col(f"a{i}{q}") / SCALE, F.lit(FLOOR[i])) for i in range(4)]
        inverse = [(1 / sds[i] if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i in range(4) for j in range(i + 1)]
        return [F.lit(q + 1).alias("start"), *[(F.get(f"h{i}", F.lit(q)) / SCALE).alias(f"m{i}") for i in range(4)], *inverse]

    own = [F.struct(*values(q)) for q in range(n)]
    robust = found.select("g", F.explode_outer(F.array(*own)).alias("v")).select("g", "v.*")
    plain = _estimate(vectors, ["g"], 1.0).drop("det").withColumn("start", F.lit(0))
    return robust.unionByName(plain)


def mcd_estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(estimates, their number): one row for each language and source with rows that pass the base rules.

    Concentration steps from each of the starts: a step keeps the SHARE of the group that lies nearest and
    estimates anew, for as long as that lowers the determinant. Which rows lie nearest is read from a
    histogram of distances in 1/8 octaves, counted over all rows of the group. The start that ends with the
    least determinant gives the group's estimate, made anew over all vectors within NEAR of it. Histograms and
    estimates are small whatever the number of rows, so each stage of a step runs in few() tasks.
    """
    vectors, pairs, n_groups = _groups(rows.where("NOT q_failed"))
    n_starts = n_groups * (1 + len(QUANTILES))
    keys = ["g", "start"]
    state = checkpoint(_starts(vectors, n_groups).withColumns({"det": F.lit(float("inf")), "moving": F.lit(True)}), small=True)
    while state.where("moving").limit(1).count():
        placed = _with_distance(vectors, state.where("moving").drop("det", "moving"), ["g"], n_starts).where("start IS NOT NULL")
        placed = placed.withColumn("bin", F.floor(8 * F.log2(F.col("d2") + 1e-6)).cast("int")).select(*keys, *FEATURES, "k", "bin")
        bins = few(placed.groupBy(*keys, "bin").agg(F.sum("k").alias("k")))
        whole = Window.partitionBy(*keys)
        bins = bins.withColumns({"up": F.sum("k").over(whole.orderBy("bin")), "all": F.sum("k").over(whole)})
        limits = few(bins.where(F.col("up") >= F.col("all") * SHARE).groupBy(*keys).agg(F.min("bin").alias("limit")))
        near = placed.join(F.broadcast(limits) if n_starts <= BROADCAST_GROUPS else limits, keys).where("bin <= limit")
        step = _estimate(near, keys, CORRECTION)
        new = step.select(*keys, F.struct(*[c for c in step.columns if c not in keys]).alias("new"))
        both = state.join(F.broadcast(new) if n_starts <= BROADCAST_GROUPS else new, keys, "left")
        lower = F.coalesce(F.col("new.det") < F.col("det") - CONVERGED, F.lit(False))
        state = checkpoint(both.select(*keys, *[F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in step.columns if c not in keys], lower.alias("moving")), small=True)
    values = F.struct(*[c for c in state.columns if c not in ("g", "moving")])
    least = few(state.groupBy("g").agg(F.min_by(values, F.struct("det", "start")).alias("v"))).select("g", "v.*").drop("det", "start")
    near = _with_distance(vectors, least, ["g"], n_groups).where(F.col("d2") <= NEAR)
    estimates = _estimate(near, ["g"], NEAR_CORRECTION).drop("det")
    estimates = checkpoint(pairs.join(F.broadcast(estimates) if n_groups <= BROADCAST_GROUPS else estimates, "g").drop("g"), small=True)
    return estimates, estimates.count()


def with_verdict(rows: DataFrame, estimates: DataFrame, n_groups: int) -> DataFrame:
    """rows with q_kept: false if the base rules fail, else whether the vector lies within CUTOFF of its group."""
    own = rows.columns
    # One comparison, not a conjunction: a filter on it then stays above the join instead of computing statistics twice.
    score = F.greatest(F.coalesce("d2", F.lit(0.0)), F.col("q_failed").cast("double") * 1e300)
    return _with_distance(rows, estimates, ["q_lang", "q_source"], n_groups).select(*own, (score <= CUTOFF).alias("q_kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs.

    A null or empty text has no words and fails the base rules. Null language or source counts as the
    empty string. Groups with fewer than LEAST_ROWS passing rows are judged by their language, and by the
    whole table where that has fewer too. Every row is judged, repeated ones alike. Columns other than doc_id, text, lang and source are ignored.
    """
    rows = checkpoint(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text", "lang", "source"))
    return with_verdict(rows, *mcd_estimates(rows)).select(
        "doc_id", F.col("q_n").alias("n_words"), F.col("q_chars").alias("word_chars"), F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup").alias("n_dup_lines"), F.col("q_n_repeat").alias("n_repeat_words"), F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs, whatever they are called.

    The caller's row travels as one struct, so no name of it meets one used here. It is written out beside its
    statistics, so that these are computed once.
    """
    rows = docs.select(F.struct("*").alias("own"), "text", "lang", "source")
    rows = checkpoint(with_statistics(rows).drop("text", "lang", "source"))
    return with_verdict(rows, *mcd_estimates(rows)).where("q_kept").select("own.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
