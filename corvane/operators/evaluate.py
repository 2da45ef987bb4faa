"""Contingency tables, entropies, skill scores, reliability, ROC and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .order import positions, running_sums


def contingency(df: DataFrame, truth: str = "truth", ret: str = "ret") -> DataFrame:
    """Counts by truth and retrieved class with margins; null marks a margin."""
    return df.cube(truth, ret).agg(F.count("*").alias("n"))


def uncertainty(df: DataFrame, truth: str = "truth", ret: str = "ret") -> DataFrame:
    """Uncertainty coefficients of truth given retrieval, of retrieval given truth, and symmetric."""
    n_ln_n = F.sum(F.col("n") * F.log("n"))
    cells = df.groupBy(truth, ret).agg(F.count("*").alias("n"))
    t = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg((-n_ln_n).alias("ht"), F.sum("n").cast("double").alias("n"))
    r = cells.groupBy(ret).agg(F.sum("n").alias("n")).agg((-n_ln_n).alias("hr"))
    both = cells.agg((-n_ln_n).alias("hrt"))
    x = t.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(both))  # one row each
    nn = F.col("n") * F.log("n")
    uc = F.col("ht") - F.col("hrt") + F.col("hr") + nn
    return x.select((uc / (F.col("ht") + nn)).alias("uc"), (uc / (F.col("hr") + nn)).alias("ucr"), (2 * uc / (F.col("hr") + F.col("ht") + 2 * nn)).alias("ucs"))


def accuracy(df: DataFrame, truth: str = "truth", ret: str = "ret") -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(ret)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def joint_entropy(df: DataFrame, cls: str, p: str, classes: int) -> DataFrame:
    """Entropies in bits of rows' class and of their probabilities `p`, an array with one of each class.

    With n_j rows of class j among n: joint is the mean over rows of -sum(n_j log p_j) / n, conditional the same of p_j over the row's
    total, total the mean of -log of the row's total, each over probabilities that aren't 0; class is -sum(n_j log(n_j / n)) / n.
    """
    n = [F.sum((F.col(cls) == j).cast("double")).alias(f"n{j}") for j in range(classes)]
    rows = df.crossJoin(F.broadcast(df.agg(F.count("*").cast("double").alias("_n"), *n)))
    share = F.array(*[F.col(f"n{j}") / F.col("_n") for j in range(classes)])
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    logs = lambda over: F.aggregate(F.zip_with(p, share, lambda x, s: F.when(x == 0, 0.0).otherwise(-s * F.log2(x / over))), F.lit(0.0), lambda a, x: a + x)
    own = sum(F.when(F.first(f"n{j}") == 0, 0.0).otherwise(-F.first(f"n{j}") / F.first("_n") * F.log2(F.first(f"n{j}") / F.first("_n"))) for j in range(classes))
    return rows.agg(F.avg(logs(F.lit(1.0))).alias("h_joint"), F.avg(logs(total)).alias("h_cond"), F.avg(F.when(total == 0, 0.0).otherwise(-F.log2(total))).alias("h_total"), own.alias("h_class"))


def skills(nt: Column, nf: Column, ht: Column, hf: Column) -> dict[str, Column]:
    """2 by 2 scores from hits `ht` of `nt` positives and false alarms `hf` of `nf` negatives: accuracy, correlation and the uncertainty coefficient of truth given
    what is retrieved; null where they have no value."""
    n = nt + nf
    retrieved = ht + hf
    corr = F.try_divide(n * ht - nt * retrieved, F.sqrt(nt * nf * retrieved * (n - retrieved)))
    log = lambda *counts: sum(F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts)
    truth, both = log(n) - log(nt, nf), log(ht, hf, nt - ht, nf - hf) - log(retrieved, n - retrieved)
    return {"acc": (ht + nf - hf) / n, "corr": corr, "uc": F.try_divide(truth + both, truth)}


def reliability(df: DataFrame, bins: int, con: str = "con", hit: str = "hit") -> DataFrame:
    """Mean confidence and hit rate in even bins of confidence; the last bin holds 1 too."""
    b = F.least(F.greatest(F.floor(F.col(con) * bins), F.lit(0)), F.lit(bins - 1))
    return df.withColumn("bin", b.cast("int")).groupBy("bin").agg(F.avg(con).alias("con"), F.avg(F.col(hit).cast("double")).alias("acc"), F.count("*").alias("n"))


def signed_reliability(df: DataFrame, bins: int, r: str = "r", truth: str = "truth") -> DataFrame:
    """For two classes: mean difference of probabilities r (-1 to 1) and the hits' share h as 2 h - 1, of the same sign, in 2 * `bins` even bins of r; r = 0 calls class 1."""
    b = F.least(F.greatest(F.floor((F.col(r) + 1) * bins), F.lit(0)), F.lit(2 * bins - 1))
    hit = (F.when(F.col(r) < 0, 0).otherwise(1) == F.col(truth)).cast("double")
    each = df.withColumn("bin", b.cast("int")).groupBy("bin").agg(F.avg(r).alias("r"), (2 * F.avg(hit) - 1).alias("acc"), F.count("*").alias("n"))
    return each.withColumn("acc", F.when(F.col("bin") < bins, -F.col("acc")).otherwise(F.col("acc")))


def probability_scores(df: DataFrame, p: str = "p", t: str = "t", pivot: float = 0.5) -> DataFrame:
    """Correlation and slope through the origin of summed outcomes and summed probabilities, and root mean square error.

    Rows are in the order of p, then outcome. From the last row with p <= pivot on, sums run upward over p and t; before it they run
    downward over p - 1 and t - 1: so both are 0 at the pivot, and good probabilities make a line of slope 1.
    """
    rows = df.select(F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t"))
    x = saved(running_sums(rows, ["p", "t"], ["p", "t"]))
    n, at, brier = x.agg(F.count("*"), F.count_if(F.col("p") <= pivot), F.sqrt(F.avg((F.col("p") - F.col("t")) ** 2))).first()
    middle = min(max(at - 1, 0), max(n - 1, 0))
    zero = x.where(F.col("position") == middle).select(F.col("p_before").alias("_p0"), F.col("t_before").alias("_t0"))
    ends = x.where(F.col("position") == n - 1).select(F.lit(n).alias("position"), (F.col("p_before") + F.col("p")).alias("p_before"), (F.col("t_before") + F.col("t")).alias("t_before"))
    points = x.select("position", "p_before", "t_before").unionByName(ends).crossJoin(F.broadcast(zero))
    below = F.least(F.col("position") - middle, F.lit(0))
    side = F.when(F.col("position") < middle, -1.0).otherwise(1.0)
    a, b = ((side * (F.col(f"{c}_before") - F.col(f"_{c}0")) + below).alias(c) for c in ("t", "p"))
    s = points.select(a, b)
    return s.agg(F.corr("t", "p").alias("r"), (F.sum(F.col("t") * F.col("p")) / F.sum(F.col("t") ** 2)).alias("slope"), F.lit(brier).alias("brier"))


def ranked_counts(df: DataFrame, score: str, truth: str, order: str) -> DataFrame:
    """Counts of positives and negatives up to each different score, from counts by score; `order` is ignored for ties.

    Scores are counted first, so equal scores make one row and a score that a third of rows have is one row. The running
    sum goes over ranges of the score, with an offset for each range.
    """
    by = saved(df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("n1"), F.count("*").alias("n")))
    return running(by.withColumn("n0", F.col("n") - F.col("n1")).drop("n"), "s", ["n1", "n0"])


def running(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Running sums (`c`_upto) and totals (`c`_all) of columns in the order of a different-valued key, over ranges of the key (see
    order.running_sums); the plan is the same at every size."""
    sums = running_sums(df, [key], columns)
    whole = sums.agg(*(F.sum(c).alias(f"{c}_all") for c in columns))
    return sums.crossJoin(F.broadcast(whole)).select(*df.columns, *((F.col(f"{c}_before") + F.col(c)).alias(f"{c}_upto") for c in columns), *(f"{c}_all" for c in columns))  # one row


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Hit and false-alarm rates of calling a score above each threshold."""
    x = ranked_counts(df, score, truth, "")
    return x.select("s", (1 - F.col("n1_upto") / F.col("n1_all")).alias("hit"), (1 - F.col("n0_upto") / F.col("n0_all")).alias("false_alarm"))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """The area under the ROC curve: pairs of a positive above a negative, ties by half."""
    x = ranked_counts(df, score, truth, "")
    below = F.col("n0_upto") - F.col("n0")
    return x.agg((F.sum(F.col("n1") * (below + F.col("n0") / 2)) / F.max(F.col("n1_all") * F.col("n0_all"))).alias("auc"))


def threshold_skills(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(s, acc, corr, uc): the skills (see `skills`) of calling scores above each threshold s."""
    x = ranked_counts(df, score, truth, "")
    nt, nf = F.col("n1_all").cast("double"), F.col("n0_all").cast("double")
    k = skills(nt, nf, nt - F.col("n1_upto"), nf - F.col("n0_upto"))
    return x.select("s", *(v.alias(n) for n, v in k.items()))


def best_threshold(df: DataFrame, score: str, truth: str, skill: str = "corr") -> DataFrame:
    """The threshold (scores above it are called) of the highest skill, corr, acc or uc, lowest first among equals."""
    y = threshold_skills(df, score, truth).select("s", F.round(skill, 9).alias(skill)).where(f"{skill} is not null and not isnan({skill})")
    return y.agg(F.max_by("s", F.struct(skill, -F.col("s"))).alias("threshold"), F.max(skill).alias(skill))


def moving_accuracy(df: DataFrame, r: str, truth: str, width: int, key: str, rows: int = 100_000) -> DataFrame:
    """Mean atanh of r and mean truth over `width` rows in order of r, from each row on where there are as many.

    Rows are numbered, and cut in chunks of `rows` that share `width` - 1 rows with the next one."""
    d = positions(df.select(key, F.col(r).alias("_r"), F.col(truth).cast("double").alias("_t")), ["_r", key])
    chunk, size = F.floor(F.col("position") / max(rows, width)), max(rows, width)
    both = F.when((F.col("position") % size < width - 1) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    d = d.withColumn("_c", F.explode(both))
    w = Window.partitionBy("_c").orderBy("position").rowsBetween(0, width - 1)
    x = d.select(key, "_c", chunk.alias("_own"), F.avg(F.atanh("_r")).over(w).alias("x"), F.avg("_t").over(w).alias("acc"), F.count("*").over(w).alias("_n"))
    return x.where((F.col("_n") == width) & (F.col("_c") == F.col("_own"))).select(key, "x", "acc")
