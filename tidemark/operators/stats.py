"""Outcome statistics: pooling, clustered tests, quantiles, cohorts. Every total is an aggregate; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY, EPS = 2.2250738585072014e-308, 2.220446049250313e-16
LARGEST = 1.7976931348623157e308


def partial_pooling(rows: DataFrame, member: str, x: str) -> DataFrame:
    """An empirical normal hierarchy over members, by moments.

    Returns member, n, mean, shrinkage, posterior_mean, posterior_sd. Where every member has one row the
    within-variance is not known: shrinkage 1, the global mean, and a null deviation.
    """
    per = rows.where(F.col(x).isNotNull()).groupBy(member).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    one = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.avg("mean").alias("center"), F.sum(F.col("v") * F.col("n")).alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.var_samp("mean").alias("spread"), F.avg(1 / F.col("n")).alias("inv"))
    size = F.greatest(F.abs("lo"), F.abs("hi"), F.col("hi") - F.col("lo"), F.lit(TINY**0.5))
    least = F.greatest(F.pow(EPS * size, F.lit(2.0)), F.lit(1 / LARGEST))
    one = one.withColumn("within", F.when(F.col("rows") > F.col("groups"), F.greatest(F.col("ss") / (F.col("rows") - F.col("groups")), least)))
    one = one.withColumn("between", F.when(F.col("within").isNotNull(), F.greatest(F.coalesce("spread", F.lit(0.0)) - F.col("within") * F.col("inv"), least)))
    all_ = per.select(member, "n", "mean").crossJoin(F.broadcast(one.select("center", "within", "between")))
    shrink = F.when(F.col("within").isNull(), 1.0).otherwise(F.col("within") / (F.col("n") * F.col("between") + F.col("within")))
    out = all_.withColumn("shrinkage", shrink)
    return out.select(member, "n", "mean", "shrinkage", ((1 - F.col("shrinkage")) * F.col("mean") + F.col("shrinkage") * F.col("center")).alias("posterior_mean"), F.sqrt(F.col("shrinkage") * F.col("between")).alias("posterior_sd"))


def member_ranking(labels: DataFrame) -> DataFrame:
    """Per member the episodes, mean alpha and share of gains."""
    return labels.groupBy("member").agg(F.count(F.lit(1)).alias("episodes"), F.avg("alpha").alias("mean_alpha"), F.avg((F.col("alpha") > 0).cast("double")).alias("positive_rate"))


def score_quantiles(rows: DataFrame, date: str, score: str, bins: int = 5) -> DataFrame:
    """Quantile 1..bins of the score within a date by average ranks; a lone row is in the last, a date of ties in the middle."""
    w = Window.partitionBy(date)
    tie = F.count(F.lit(1)).over(Window.partitionBy(date, score))
    n = F.count(F.lit(1)).over(w)
    place = (F.rank().over(w.orderBy(score)) + (tie - 1) / 2) / n
    by_place = F.least(F.lit(bins), F.ceil(place * bins)).cast("int")
    return rows.withColumn("quantile", F.when(n == 1, bins).when(tie == n, (bins + 1) // 2).otherwise(by_place))


def welch(rows: DataFrame, group: Column, x: str, *keys: str) -> DataFrame:
    """Sizes and means of both groups, and Welch's t of their difference."""
    g1, g0 = F.when(group == 1, F.col(x)), F.when(group == 0, F.col(x))
    s = rows.groupBy(*keys).agg(F.count(g1).alias("n1"), F.count(g0).alias("n0"), F.avg(g1).alias("mean1"), F.avg(g0).alias("mean0"), F.var_samp(g1).alias("v1"), F.var_samp(g0).alias("v0"))
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return s.select(*keys, "n1", "n0", "mean1", "mean0", t.alias("welch_t"))


def clustered_t(rows: DataFrame, z: str, x: str, cluster: str) -> DataFrame:
    """T of a 0/1 treatment in least squares, variance robust to clusters: sums per cluster, then totals."""
    per = rows.where(F.col(x).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(z).alias("n1"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(z)).alias("s1"))
    tot = per.agg(F.sum("n").alias("all"), F.sum("n1").alias("all1"), F.sum("sx").alias("all_x"), F.sum("s1").alias("all_x1"), F.count(F.lit(1)).alias("clusters"))
    both = per.crossJoin(F.broadcast(tot))
    n, n1 = F.col("all"), F.col("all1")
    b0 = (F.col("all_x") - F.col("all_x1")) / (n - n1)
    b1 = F.col("all_x1") / n1 - b0
    u0 = F.col("sx") - b0 * F.col("n") - b1 * F.col("n1")  # score of the constant
    u1 = F.col("s1") - (b0 + b1) * F.col("n1")
    # The second row of the inverse of X'X is (-1/(n-n1), n/(n1 (n-n1))).
    lead = -u0 / (n - n1) + u1 * n / (n1 * (n - n1))
    v = both.where((n1 > 0) & (n1 < n) & (F.col("clusters") > 1)).groupBy("all", "clusters").agg(F.first(b1).alias("beta"), F.sum(lead * lead).alias("m"))
    scale = F.col("clusters") / (F.col("clusters") - 1) * (n - 1) / (n - 2)
    return v.select(n.alias("rows"), "clusters", "beta", F.when(F.col("m") > 0, F.col("beta") / F.sqrt(F.col("m") * scale)).alias("clustered_t"))


def cluster_mean_stats(rows: DataFrame, group: str, cluster: str, x: str) -> DataFrame:
    """Per group the pooled mean, the mean of cluster means and its t."""
    per = rows.groupBy(group, cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    m = F.col("s") / F.col("n")
    out = per.where("n > 0").groupBy(group).agg((F.sum("s") / F.sum("n")).alias("pooled_mean"), F.avg(m).alias("cluster_mean"), F.count(F.lit(1)).alias("clusters"), F.stddev_samp(m).alias("sd"))
    return out.select(group, "pooled_mean", "cluster_mean", "clusters", (F.col("cluster_mean") / (F.col("sd") / F.sqrt("clusters"))).alias("t"))


# Cumulated Poisson probabilities of 0, 1, 2, ... with mean 1.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def bootstrap_means(means: DataFrame, keys: list[str], cluster: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """A 95 % interval of the mean of ``m`` over clusters, per ``keys``, one row for each cluster and keys.

    How often a repetition draws a cluster is Poisson with mean 1, by a hash of seed, repetition and cluster. So no
    cluster needs a place in an order, and repetitions are sums that combine before the shuffle.
    """
    text = F.md5(F.concat_ws("|", F.lit(seed), F.col("rep"), F.col(cluster).cast("string")).cast("binary"))
    u = F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / 2.0**32
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    draws = means.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("times", times)
    per = draws.groupBy(*keys, "rep").agg((F.sum(F.col("times") * F.col("m")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    return per.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("reps"))


def cluster_bootstrap(rows: DataFrame, cluster: str, x: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """A 95 % interval of the mean of cluster means."""
    return bootstrap_means(rows.where(F.col(x).isNotNull()).groupBy(cluster).agg(F.avg(x).alias("m")), [], cluster, reps, seed)


def cohort_summary(panel: DataFrame, reps: int = 200, seed: int = 1) -> DataFrame:
    """Means over decision dates of groups and score quintiles, ranked less each baseline on common dates, and the verdict.

    ``panel`` has as_of, ranked, entry_eligible, score_quintile (Q1 to Q5) and excess. A row can be in several groups;
    rows without excess are in none. The verdict stands on the primary row, the top quintile against zero: PASS where
    mean and lower bound are above zero, NOT VALIDATABLE below two dates.
    """
    ranked = F.coalesce("ranked", F.lit(False))
    groups = F.array_compact(F.array(F.when(ranked, "ranked"), F.when(~ranked & F.col("entry_eligible"), "eligible_not_ranked"), F.when(~F.col("entry_eligible"), "ineligible"), F.col("score_quintile")))
    means = panel.where("excess IS NOT NULL").select("as_of", "excess", F.explode(groups).alias("group_a")).groupBy("group_a", "as_of").agg(F.avg("excess").alias("m"), F.sum("excess").alias("s"), F.count(F.lit(1)).alias("n"))
    of = lambda g: F.max(F.when(F.col("group_a") == g, F.struct("m", "s", "n")))
    dates = means.groupBy("as_of").agg(of("ranked").alias("r"), of("eligible_not_ranked").alias("e"), of("ineligible").alias("i"))
    sides = F.explode(F.array(F.struct(F.lit("eligible_not_ranked").alias("group_b"), F.col("e").alias("b")), F.struct(F.lit("ineligible").alias("group_b"), F.col("i").alias("b"))))
    apart = dates.select("as_of", "r", sides.alias("x")).select(F.lit("ranked_minus_baseline").alias("metric"), F.lit("ranked").alias("group_a"), "x.group_b", "as_of", (F.col("r.m") - F.col("x.b.m")).alias("m"), F.col("r.s").alias("s"), F.col("r.n").alias("n"), F.col("x.b.s").alias("s2"), F.col("x.b.n").alias("n2"))
    quintile = F.col("group_a").rlike("^Q[1-5]$")
    primary = F.when(F.col("group_a") == "Q5", F.array(F.lit("score_quintile_mean"), F.lit("primary_top_quintile_vs_zero"))).when(quintile, F.array(F.lit("score_quintile_mean"))).otherwise(F.array(F.lit("group_mean")))
    alone = means.withColumn("metric", F.explode(primary)).withColumn("group_b", F.when(F.col("metric").startswith("primary"), "zero").otherwise(""))
    both, keys = alone.unionByName(apart, allowMissingColumns=True), ["metric", "group_a", "group_b"]
    stats = both.groupBy(*keys).agg(F.sum("n").alias("n_ticker_dates"), F.count("m").alias("clusters"), (F.sum("s") / F.sum("n") - F.coalesce(F.sum("s2") / F.sum("n2"), F.lit(0.0))).alias("mean_pooled"), F.avg("m").alias("mean_cluster"), F.stddev_samp("m").alias("sd"))
    mean, se = F.col("mean_cluster"), F.col("sd") / F.sqrt("clusters")
    t = F.when(se > 0, mean / se).when(se.isNotNull() & (mean == 0), 0.0).when(se.isNotNull(), F.signum(mean) * float("inf"))
    out = stats.join(bootstrap_means(both.where("m IS NOT NULL"), keys, "as_of", reps, seed), keys, "left")
    verdict = F.when(F.col("clusters") < 2, "NOT VALIDATABLE").when((mean > 0) & (F.col("low") > 0), "PASS").otherwise("NOT VALIDATED")
    return out.select(*keys, "n_ticker_dates", "clusters", "mean_pooled", "mean_cluster", t.alias("t"), "low", "high", F.when(F.col("metric").startswith("primary"), verdict).alias("verdict"))


def within_actor_demean(rows: DataFrame, actor: str, cohort: str, x: str) -> DataFrame:
    """X less the mean of its actor, and of the actor means in its cohort the grand one added back."""
    own = F.avg(x).over(Window.partitionBy(actor))
    out = rows.withColumn("actor_mean", own)
    return out.withColumn("within", F.col(x) - F.col("actor_mean")).withColumn("cohort_mean", F.avg("actor_mean").over(Window.partitionBy(cohort)))


def breadth_by_actor(rows: DataFrame, before: Column) -> DataFrame:
    """Distinct symbols of each actor disclosed before a day."""
    return rows.where(F.col("disclosure_date") < before).groupBy("member").agg(F.count_distinct("ticker").alias("breadth"))


def skill_labels(outcomes: DataFrame, least_n: int = 5, least_mean: float = 3.0) -> DataFrame:
    """Actors with enough matured episodes, and whether their mean excess makes them skilled."""
    per = outcomes.groupBy("member").agg(F.count("alpha").alias("n"), F.avg("alpha").alias("mean")).where(F.col("n") >= least_n)
    return per.withColumn("skilled", F.col("mean") > least_mean)


def skill_table(outcomes: DataFrame) -> DataFrame:
    """Matured excess per actor: number, hits and mean."""
    return outcomes.where("alpha IS NOT NULL").groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("alpha") > 0).alias("hits"), F.avg("alpha").alias("mean_excess"))


def actor_weights(candidates: DataFrame, skills: DataFrame, prior: float = 0.46, strength: float = 20.0) -> DataFrame:
    """The shrunk hit rate of each candidate's actor; an actor without skill rows has the prior."""
    out = candidates.join(skills.select("member", "n", "hits"), "member", "left")
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    return out.withColumn("weight", (hits + prior * strength) / (n + strength)).drop("n", "hits")


def drop_report(rows: DataFrame, keys: list[str], reasons: str) -> DataFrame:
    """Excluded inputs by keys and reason: rows and distinct tickers; a row counts for each of its reasons."""
    each = rows.withColumn("reason", F.explode(F.split(reasons, ","))).where("reason <> ''")
    return each.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"))


def tolerance_sweep(rows: DataFrame, ratio: str, x: str, grid: list[float]) -> DataFrame:
    """Eligible against the rest for each tolerance of a small grid: sizes, means, Welch's t, hit rates."""
    each = rows.withColumn("tolerance", F.explode(F.array(*(F.lit(g) for g in grid)))).withColumn("eligible", (F.col(ratio) <= F.col("tolerance")).cast("int"))
    hit = each.groupBy("tolerance").agg(F.avg(F.when((F.col("eligible") == 1), (F.col(x) > 0).cast("double"))).alias("hit_rate"))
    return welch(each, F.col("eligible"), x, "tolerance").join(hit, "tolerance")


def pooled_error_rate(frame: DataFrame, checked: DataFrame, stratum: str) -> DataFrame:
    """The error rate over strata, each weighted by its share of the population."""
    n = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("population"))
    e = checked.groupBy(stratum).agg(F.count(F.lit(1)).alias("checked"), F.sum("error").alias("errors"))
    return n.join(e, stratum).agg((F.sum(F.col("population") * F.col("errors") / F.col("checked")) / F.sum("population")).alias("rate"), F.sum("checked").alias("checked"))


def sector_leaders(outcomes: DataFrame, sectors: DataFrame, least: int = 3) -> DataFrame:
    """Per sector with enough purchases the member with the best mean alpha."""
    per = outcomes.join(sectors, "ticker").groupBy("sector", "member").agg(F.count(F.lit(1)).alias("n"), F.avg("alpha").alias("mean_alpha"))
    w = Window.partitionBy("sector")
    return per.withColumns({"purchases": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("mean_alpha"), "member"))}).where((F.col("place") == 1) & (F.col("purchases") >= least)).drop("place")


def attach_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """The sector of each row's ticker; unknown ones have none. Catalyst broadcasts the dimension if it is small."""
    return rows.join(sectors.select("ticker", "sector").dropDuplicates(["ticker"]), "ticker", "left")
