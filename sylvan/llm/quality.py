"""Quality rules: per-text statistics and robust multivariate outliers, in DataFrame functions only.

Each text gives five statistics (length, length of words, symbols, repeated lines, repeated passages), transformed and
rounded to integers. For each language and source the minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps: keep the share ALPHA of rows that lie nearest by Mahalanobis distance, estimate anew from
these, and repeat. Two deterministic starts run side by side (medians with quartile ranges; covariance of winsorised rows)
and the one with the smaller determinant stays. The sums behind a step are sums of integers, so that no order of tasks can
change a result. Rows are rejected whose distance, scaled so that the ALPHA quantile is that of a normal vector, exceeds
CUTOFF. All steps run over the table of statistics, not over texts.

Cases: a null or blank text has no words and fails the base rule; null language and null source are values of their own;
rows of a language and source with fewer than LEAST usable rows are judged with the other small groups of their language,
and if these are too few with all rows left over; if those are too few too, only the base rule counts. Copies and near copies
can't take an estimate over: a cell of like statistics that holds over 1 / CELL_SHARE of the weight of a group is weighed down
to that share (`_weights`), and the scale is never below LEAST_SCALE. In groups without such a cell repeated rows count each.
Of rows that tie at the ALPHA quantile all those in its cell of distances are held, so no order decides. A very long text is
counted whole, in arrays of its own row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.runtime import discard, join_per_key, materialize

from .common import SPACE_CLASS, SPACES, broadcast_if_few, free_name, text_or_empty

WINDOW = 8
#: Share of rows that the estimate rests on, rows that a group needs, concentration steps, squared distance that rejects.
#: CUTOFF is the 1 - 1e-9 quantile of chi-square with 5 degrees, ALPHA_QUANTILE its ALPHA quantile.
ALPHA, LEAST, STEPS, CUTOFF, ALPHA_QUANTILE = 0.75, 60, 6, 50.8, 6.6257
#: Cells are half a floor wide; FULL is the weight of a row outside of crowded cells. LEAST_SCALE is below the scale of a
#: normal group in which one statistic alone varies (0.54), so that only groups with no spread of their own meet it.
CELL_SHARE, FULL, LEAST_SCALE = 16, 1 << 20, 0.5
#: Statistics in units of 1 / SCALE, and the least standard deviation that each is given (in those units).
#: Those of repeated lines and passages let a share of either alone pass CUTOFF: half of the lines up to a scale of 0.98, the
#: 0.3 that the base rule lets through up to one of 0.92, while one repeated heading of three lines stays from one of 0.66 on.
SCALE = 1000
STATS = {"_x0": 100, "_x1": 30, "_x2": 30, "_x3": 100, "_x4": 80}
X = list(STATS)
P = len(X)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _sum(terms) -> Column:
    return reduce(add, terms)


def row_key() -> Column:
    """A hash of what decides a row's verdict; rows with equal keys have equal verdicts."""
    return F.xxhash64(F.col("doc_id").cast("string"), text_or_empty(), F.col("lang"), F.col("source"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, _rk, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed of every row."""
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), row_key().alias("_rk"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+")).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "_rk", "n_symbols",
        F.size("_words").cast("bigint").alias("n_words"), F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    # Only texts with a repeated window sort theirs.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed)).drop("_windows")
    again = lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"])
    rows = rows.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(again(x, i), F.get("_sorted", i + 1)["h"] == x["h"], F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate("_starts", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("bigint")).drop("_starts")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vectors(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    kinds = [F.log(1.0 + F.col("n_words")), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumns({x: F.round(SCALE * e).cast("bigint") for x, e in zip(X, kinds, strict=True)})


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """_g, the group whose estimate judges a row, for each language and source; _n: its usable rows, _own: all rows of the pair."""
    sizes = rows.groupBy("_l", "_s").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_usable"), F.count("*").alias("_own"))
    small = lambda n: F.col(n) < least
    level = F.when(~small("_usable"), F.struct(F.lit(0).alias("k"), F.col("_l"), F.col("_s")))
    left = F.sum(F.when(small("_usable"), F.col("_usable")).otherwise(0)).over(Window.partitionBy("_l"))
    sizes = sizes.withColumn("_left", left)
    pooled = F.when(~small("_left"), F.struct(F.lit(1).alias("k"), F.col("_l"), F.lit("").alias("_s"))).otherwise(F.struct(F.lit(2).alias("k"), F.lit("").alias("_l"), F.lit("").alias("_s")))
    return sizes.select("_l", "_s", "_own", F.to_json(F.coalesce(level, pooled)).alias("_g"))


def _at_share(counts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the least value at or below which these shares of its rows lie. counts: by, value and n."""
    w = Window.partitionBy(*by)
    cum = counts.withColumns({"_c": F.sum("n").over(w.orderBy(value)), "_t": F.sum("n").over(w)})
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("_c") >= F.ceil(F.col("_t") * s), F.col(value))).alias(k) for k, s in shares.items()])


def _moments(rows: DataFrame, by: list[str], y: list[str]) -> DataFrame:
    """Weight, sums and sums of products of the integer columns y, weighed by _u, exact whatever the order."""
    sums = [F.sum((F.col("_u") * F.col(y[i])).cast("decimal(18,0)")).cast("double").alias(f"_s{i}") for i in range(P)]
    products = [F.sum((F.col("_u") * F.col(y[i]) * F.col(y[j])).cast("decimal(19,0)")).cast("double").alias(f"_p{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.sum("_u").cast("double").alias("_h"), *sums, *products)


def _weights(rows: DataFrame) -> DataFrame:
    """For each group its number of rows _rows and _crowded, the weight of a row by crowded cell.

    With the k fullest cells capped at c the others hold r rows; c = r / (CELL_SHARE - k) makes each capped cell weigh
    1 / CELL_SHARE of all. The least k whose next cell needs no cap is taken; where there are too few cells for that, each
    weighs as one row.
    """
    cells = materialize(rows.groupBy("_g", _place().alias("_at")).agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("_g").agg(F.sum("n").alias("_rows"))
    w = Window.partitionBy("_g").orderBy(F.desc("n"), "_at")
    top = cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= CELL_SHARE)
    top = materialize(top.join(sizes, "_g").withColumn("_rest", F.col("_rows") - F.sum("n").over(w) + F.col("n")), "fullest")
    fits = top.where(F.col("n") * (CELL_SHARE + 1 - F.col("_r")) <= F.col("_rest"))
    caps = fits.groupBy("_g").agg(F.min_by(F.col("_rest") / (CELL_SHARE + 1 - F.col("_r")), "_r").alias("_cap"))
    capped = top.join(caps, "_g", "left").withColumn("_cap", F.greatest(F.lit(1.0), F.coalesce("_cap", F.lit(1.0)))).where("n > _cap")
    capped = capped.select("_g", F.struct("_at", F.greatest(F.lit(1), F.floor(FULL * F.col("_cap") / F.col("n"))).cast("bigint").alias("u")).alias("_e"))
    return sizes.join(capped.groupBy("_g").agg(F.map_from_entries(F.collect_list("_e")).alias("_crowded")), "_g", "left")


def _place() -> Column:
    """The cell of a row's statistics."""
    return F.concat_ws(" ", *[F.floor(F.col(x) * 2 / floor).cast("string") for x, floor in STATS.items()])


def _estimate(moments: DataFrame, by: list[str]) -> DataFrame:
    """Means _m, the inverse Cholesky factor _w of the covariance (floored on its diagonal) and its log determinant."""
    out = moments.select(*by, "_h", *[(F.col(f"_s{i}") / F.col("_h")).alias(f"_m{i}") for i in range(P)], *[F.col(f"_p{i}{j}") for i, j in PAIRS])
    cov = {(i, j): F.col(f"_p{i}{j}") / F.col("_h") - F.col(f"_m{i}") * F.col(f"_m{j}") for i, j in PAIRS}
    out = out.select(*by, *[f"_m{i}" for i in range(P)], *[(F.greatest(c, F.lit(0.0)) + float(STATS[X[i]]) ** 2 if i == j else c).alias(f"_c{i}{j}") for (i, j), c in cov.items()])
    for i in range(P):  # Cholesky, row by row
        for j in range(i + 1):
            rest = F.col(f"_c{i}{j}") - _sum([F.lit(0.0), *(F.col(f"_k{i}{k}") * F.col(f"_k{j}{k}") for k in range(j))])
            out = out.withColumn(f"_k{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"_k{j}{j}"))
    for j in range(P):  # its inverse, column by column
        out = out.withColumn(f"_w{j}{j}", 1.0 / F.col(f"_k{j}{j}"))
        for i in range(j + 1, P):
            out = out.withColumn(f"_w{i}{j}", -_sum(F.col(f"_k{i}{k}") * F.col(f"_w{k}{j}") for k in range(j, i)) / F.col(f"_k{i}{i}"))
    return out.select(*by, *[f"_m{i}" for i in range(P)], *[f"_w{i}{j}" for i, j in PAIRS], _sum(F.log(f"_k{i}{i}") for i in range(P)).alias("_det"))


def _distance(y: list[str]) -> Column:
    """Squared Mahalanobis distance to the estimate in the same row."""
    return _sum(F.pow(_sum(F.col(f"_w{i}{j}") * (F.col(y[j]) - F.col(f"_m{j}")) for j in range(i + 1)), F.lit(2.0)) for i in range(P))


def _cell(d: Column) -> Column:
    """Distances in steps of 1/64 of a power of e: some thousand cells at most."""
    return F.floor(64 * F.log(d + 1e-6)).cast("int")


def robust_estimates(rows: DataFrame, total: int, steps: int = STEPS) -> DataFrame:
    """For each group (_g) of rows (_g, _n, x0 .. x4; usable ones only): the MCD estimate, and _cut, the distance that rejects."""
    weights = materialize(_weights(rows), "weights")
    weighed = join_per_key(rows, weights, ["_g"], "_rows", total, ["doc_id", *X])
    rows = materialize(weighed.select("doc_id", "_g", *X, F.coalesce(F.element_at("_crowded", _place()), F.lit(FULL)).cast("bigint").alias("_u")), "weighed")
    hist = rows.select("_g", "_u", F.posexplode(F.array(*X)).alias("_i", "_v")).groupBy("_g", "_i", "_v").agg(F.sum("_u").alias("n"))
    mid = _at_share(hist, ["_g", "_i"], "_v", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    at = lambda i, name: F.max(F.when(F.col("_i") == i, F.col(name)))
    start = mid.groupBy("_g").agg(*[at(i, "mid").alias(f"_o{i}") for i in range(P)], *[F.greatest(F.lit(float(STATS[x])), at(i, "hi") - at(i, "lo"), F.lit(0.0)).alias(f"_q{i}") for i, x in enumerate(X)])
    start = materialize(start.join(weights.select("_g", "_rows"), "_g"), "starts")
    join = lambda right: join_per_key(rows, right, ["_g"], "_rows", total, ["doc_id", *X])
    # Rows are centred on the median, so that sums of products stay small.
    y = [f"_y{i}" for i in range(P)]
    rows = materialize(join(start).select("doc_id", "_g", "_u", *X, *[(F.col(X[i]) - F.col(f"_o{i}")).cast("bigint").alias(y[i]) for i in range(P)], *[f"_q{i}" for i in range(P)]), "centred")
    # Start 0: quartile ranges alone; start 1: covariance of rows winsorised at 1.5 quartile ranges (two standard deviations).
    clipped = rows.select("_g", "_u", *[F.greatest(F.least(F.col(y[i]), F.ceil(1.5 * F.col(f"_q{i}")).cast("bigint")), -F.ceil(1.5 * F.col(f"_q{i}")).cast("bigint")).alias(y[i]) for i in range(P)])
    flat = start.select("_g", F.lit(1.0).alias("_h"), *[F.lit(0.0).alias(f"_s{i}") for i in range(P)], *[(F.pow(F.col(f"_q{i}") / 1.349, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"_p{i}{j}") for i, j in PAIRS])
    est = _estimate(flat, ["_g"]).withColumn("_start", F.lit(0)).unionByName(_estimate(_moments(clipped, ["_g"], y), ["_g"]).withColumn("_start", F.lit(1)))
    sizes = start.select("_g", "_rows", *[f"_o{i}" for i in range(P)])
    both = lambda e: e.groupBy("_g").agg(F.collect_list(F.struct("_start", *[f"_m{i}" for i in range(P)], *[f"_w{i}{j}" for i, j in PAIRS])).alias("_e"))
    est, old = materialize(both(est).join(sizes.select("_g", "_rows"), "_g"), "estimate"), None
    rows = rows.select("doc_id", "_g", "_u", *y, *X)
    for step in range(steps):
        far = join_per_key(rows, est, ["_g"], "_rows", total, ["doc_id", *X]).select("_g", "_u", *y, F.explode("_e").alias("_e")).select("_g", "_u", *y, "_e.*")
        far = far.select("_g", "_start", "_u", _cell(_distance(y)).alias("_d"))
        near = _at_share(far.groupBy("_g", "_start", "_d").agg(F.sum("_u").alias("n")), ["_g", "_start"], "_d", {"_near": ALPHA})
        near = materialize(near.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_start", "_near"))).alias("_near")).join(est, "_g"), "near")
        held = join_per_key(rows, near, ["_g"], "_rows", total, ["doc_id", *X]).select("_g", "_u", *y, "_near", F.explode("_e").alias("_e")).select("_g", "_u", *y, "_near", "_e.*")
        held = held.where(_cell(_distance(y)) <= F.element_at("_near", F.col("_start")))
        new = _estimate(_moments(held, ["_g", "_start"], y), ["_g", "_start"])
        if step == steps - 1:
            w = Window.partitionBy("_g").orderBy("_det", "_start")
            new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
            best = materialize(new.join(sizes, "_g"), "best")
        else:
            old, est = est, materialize(both(new).join(sizes.select("_g", "_rows"), "_g"), "estimate")
            discard(old)
    # Scale: the ALPHA quantile of the distances is that of a normal vector.
    far = join_per_key(rows, best, ["_g"], "_rows", total, ["doc_id", *X]).select("_g", "_u", _cell(_distance(y)).alias("_d")).groupBy("_g", "_d").agg(F.sum("_u").alias("n"))
    scale = _at_share(far, ["_g"], "_d", {"_near": ALPHA})
    return best.join(scale, "_g").withColumn("_cut", CUTOFF * F.greatest(F.lit(LEAST_SCALE), F.exp((F.col("_near") + 1) / 64.0) / ALPHA_QUANTILE)).drop("_near", "_start", "_rows", "_det")


def quality_verdicts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where no estimate applies), kept, lang and source of every row."""
    stats = materialize(_vectors(text_statistics(docs)).withColumns({"_l": F.coalesce(F.col("lang"), F.lit("\x00")), "_s": F.coalesce(F.col("source"), F.lit("\x00"))}), "statistics")
    total = stats.count()
    groups = materialize(_grouped(stats, least), "groups")
    named = materialize(join_per_key(stats, groups, ["_l", "_s"], "_own", total, ["doc_id", *X]).drop("_own", "_l", "_s"), "grouped")
    discard(stats)
    best = robust_estimates(named.where(~F.col("base_failed")).select("doc_id", "_g", *X), total)
    sizes = named.groupBy("_g").agg(F.count("*").alias("_all"), F.count(F.when(~F.col("base_failed"), 1)).alias("_usable"))
    best = materialize(sizes.join(best, "_g", "left"), "estimates")
    judged = join_per_key(named, best, ["_g"], "_all", total, ["doc_id", *X])
    y = [f"_y{i}" for i in range(P)]
    judged = judged.withColumns({y[i]: F.col(X[i]) - F.col(f"_o{i}") for i in range(P)}).withColumn("distance", F.when(F.col("_usable") >= least, CUTOFF * _distance(y) / F.col("_cut")))
    fine = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", fine.alias("kept"), "lang", "source", "_rk")


def keep_good(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs that are kept, all columns unchanged. Rows that are equal in doc_id, text, lang and source share a verdict."""
    bad = quality_verdicts(docs, least).where("not kept").select(F.col("_rk").alias("_bad"), F.col("doc_id").alias("_bad_id"))
    few = broadcast_if_few(materialize(bad.distinct(), "rejected"))
    own = free_name(docs, "_own")
    rows = docs.withColumn(own, row_key())
    return rows.join(few, (rows[own] == few["_bad"]) & rows["doc_id"].eqNullSafe(few["_bad_id"]), "left_anti").drop(own)
