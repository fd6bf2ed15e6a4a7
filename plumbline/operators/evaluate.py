"""Accuracy of scores against labels, comparison of arms, and splits; sums over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import text as T
from plumbline.plans.score import COUNTS

THRESHOLDS = (5, 10, 15, 20, 25)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def confusion(scored: DataFrame, positive: Column, thresholds: tuple[int, ...] = (10,)) -> DataFrame:
    """One row per threshold: counts and rates, flagging scores over it. One pass counts for all thresholds."""
    hit, n = F.col("score"), lambda c: F.count_if(c)
    each = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), n(positive & (hit > t)).alias("tp"), n(~positive & (hit > t)).alias("fp"), n(~positive & (hit <= t)).alias("tn"), n(positive & (hit <= t)).alias("fn"))
            for t in thresholds
        ]
    )
    rows = scored.agg(each.alias("e")).select(F.inline("e"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = rows.withColumns({"recall": _share(tp, tp + fn), "specificity": _share(tn, tn + fp), "precision": _share(tp, tp + fp), "accuracy": _share(tp + tn, tp + fp + tn + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """The 95 % interval of a share as ``(low, high)``; (0, 0) without trials."""
    p = k.cast("double") / n
    low = lambda sign: (p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    known = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(0.0)
    return F.struct(known(low(-1)).alias("low"), known(low(1)).alias("high"))


def score_distribution(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy(label).agg(F.count("*").alias("samples"), F.min("score").alias("least"), F.max("score").alias("most"), T.rounded(F.sum("score").cast("double") / F.count("*"), 1).alias("mean"), F.median("score").cast("double").alias("median"))


def rule_diagnostics(scored: DataFrame, positive: Column) -> DataFrame:
    """Per rule that fires: samples, and share of either label's samples. All rules are counted in one pass."""
    yes, no = F.count_if(positive), F.count_if(~positive)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(F.col(c) > 0).alias("samples"), F.count_if(positive & (F.col(c) > 0)).alias("positives"), F.count_if(~positive & (F.col(c) > 0)).alias("negatives"), yes.alias("y"), no.alias("n")) for rule, c in COUNTS.items()])
    rows = scored.agg(each.alias("e")).select(F.inline("e")).where("samples > 0")
    return rows.select("rule", "samples", "positives", "negatives", T.rounded(_share(F.col("positives"), F.col("y")), 3).alias("positive_rate"), T.rounded(_share(F.col("negatives"), F.col("n")), 3).alias("negative_rate"))


def arm_summary(scored: DataFrame, arm: str) -> DataFrame:
    """Per arm: n, mean score, mean of rounded variation, grades and tells."""
    aggregates = [F.count("*").alias("n"), T.rounded(F.sum("score").cast("double") / F.count("*"), 1).alias("mean_score"), F.sum(T.rounded(F.col("cv") * 100).cast("long")).alias("cv_hundredths")]
    aggregates += [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    aggregates += [F.sum(c).alias(c) for c in COUNTS.values()]
    rows = scored.groupBy(arm).agg(*aggregates)
    return rows.withColumn("mean_cv", T.rounded(F.col("cv_hundredths") / 100.0 / F.col("n"), 3)).drop("cv_hundredths")


def dominant_grade(summary: DataFrame) -> Column:
    """The most frequent grade, the best among equals."""
    return F.array_sort(F.array(*[F.struct((-F.col(f"grade_{g.lower()}")).alias("n"), F.lit(g).alias("g")) for g in "ABCDF"]))[0]["g"]


def against_baseline(summary: DataFrame, arm: str, baseline: str) -> DataFrame:
    """Each arm's mean score and variation less the baseline arm's; the baseline is one row."""
    base = summary.where(F.col(arm) == baseline).select(F.col("mean_score").alias("b_score"), F.col("mean_cv").alias("b_cv")).limit(1)
    joined = summary.join(F.broadcast(base), F.lit(True), "left")
    return joined.select(arm, "n", "mean_score", "mean_cv", T.rounded(F.col("mean_score") - F.col("b_score"), 1).alias("score_delta"), T.rounded(F.col("mean_cv") - F.col("b_cv"), 3).alias("cv_delta"))


def gap_closed(base: Column, prompt: Column, arm: Column) -> Column:
    """Percent of the gap from base to prompt that an arm closes; NaN without a gap."""
    return F.when(base - prompt > 0, (base - arm) / (base - prompt) * 100).otherwise(F.lit(float("nan")))


def holdout(pairs: DataFrame, source: str, text: str, share: float = 0.15) -> DataFrame:
    """Adds ``held``: the first rows by (source, sha1 of the text), as many as the half-even rounded share, one at least.

    Counts by source tell which sources are held whole, which not at all, and which one is cut; there, counts by the first
    digits of the hash tell where. Only the rows of that one range, about one in 65,536 of its source, are put in order."""
    keyed = pairs.withColumns({"_sha": F.sha1(T.as_text(F.col(text))), "_source": F.coalesce(F.col(source).cast("string"), F.lit(""))})
    keyed = keyed.withColumn("_digits", F.left("_sha", F.lit(4)))
    sizes = keyed.groupBy("_source", "_digits").agg(F.count("*").alias("_rows"))
    sources = sizes.groupBy("_source").agg(F.sum("_rows").alias("_size"))
    before, whole = W.orderBy("_source").rowsBetween(W.unboundedPreceding, -1), W.orderBy("_source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    k = F.greatest(F.lit(1.0), F.bround(F.sum("_size").over(whole) * share)).cast("long")
    sources = sources.select("_source", "_size", F.least("_size", F.greatest(F.lit(0).cast("long"), k - F.coalesce(F.sum("_size").over(before), F.lit(0)))).alias("_take"))
    inside = W.partitionBy("_source").orderBy("_digits").rowsBetween(W.unboundedPreceding, -1)
    cut = sizes.join(sources.where("_take > 0 and _take < _size"), "_source").withColumn("_before", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    cut = cut.select("_source", "_digits", (F.col("_take") - F.col("_before")).alias("_left"), "_rows")
    placed = keyed.join(sources, "_source").join(cut, ["_source", "_digits"], "left")
    known = F.when(F.col("_left").isNull(), F.col("_take") > 0).when(F.col("_left") >= F.col("_rows"), True).when(F.col("_left") <= 0, False)
    placed = placed.withColumn("held", known)
    edge = placed.where("held is null").withColumn("_n", F.row_number().over(W.partitionBy("_source", "_digits").orderBy("_sha", text)))
    edge = edge.withColumn("held", F.col("_n") <= F.col("_left"))
    return placed.where("held is not null").select(*pairs.columns, "held").union(edge.select(*pairs.columns, "held"))


def filter_pairs(scored: DataFrame, limit: int = 15) -> DataFrame:
    """Adds ``kept``: score at most the limit."""
    return scored.withColumn("kept", F.col("score") <= limit)


def kept_pairs(scored: DataFrame, columns: list[str], limit: int = 15) -> DataFrame:
    """The pairs that stay, without what scoring added: what a JSON-lines sink writes."""
    return filter_pairs(scored, limit).where("kept").select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; null fields are left out. Files are written by the tasks that hold the rows."""
    df.write.json(path)


def outputs_of(samples: DataFrame, arms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Each held-out sample with its arm's output, empty where there is none."""
    own = arms.select(F.col(key), F.col(text).alias("output"))
    return samples.join(own, key, "left").withColumn("output", T.as_text(F.col("output")))


def paired(samples: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The samples whose ids are listed, once for each time they are."""
    return samples.join(ids.select(key), key)


def first_outputs(outputs: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The first outputs by key, for a person to read."""
    return outputs.orderBy(key).limit(most)


def best_of(drafts: DataFrame, group: str, order: str) -> DataFrame:
    """The draft of least score per group, the first among equals."""
    return drafts.groupBy(group).agg(F.min_by(F.struct(*drafts.columns), F.struct("score", order)).alias("d")).select("d.*")


def fired_rules(scored: DataFrame) -> DataFrame:
    """``rule``: the names of the rules that fire in any row, in order of name."""
    fired = F.array_compact(F.array(*[F.when(F.max(c) > 0, rule) for rule, c in COUNTS.items()]))
    return scored.agg(fired.alias("rules")).select(F.explode(F.array_sort("rules")).alias("rule"))
