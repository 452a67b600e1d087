"""Statistics of scan-level tables (T1-T12). Sums and ranks are Spark's; only small per-group results are solved."""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..tables import stored
from .aggregates import scan_level
from .filters import drop_unusable
from .order import fdr_bh, join_null_safe, placed, with_avg_rank
from .ranking import order_results


def _long(df: DataFrame, cols: Sequence[str], *keep) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols)))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.*")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "spearman", key: str = "scan_name") -> DataFrame:
    """(a, b, r, n) of all ordered column pairs over the rows that have both; constant columns give 0."""
    long = _long(df, cols, key).where("value is not null")
    left, right = long.select(key, F.col("feature").alias("a"), F.col("value").alias("x")), long.select(key, F.col("feature").alias("b"), F.col("value").alias("y"))
    pairs = left.join(right, key)
    if method == "spearman":
        pairs = _ranked(pairs)
    return pairs.groupBy("a", "b").agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(None)), F.lit(0.0)).alias("r"), F.count("*").alias("n"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Of (a, b, x, y): x and y replaced by their mean ranks within each pair of columns."""
    pairs = stored(pairs, "pairs")
    ranked = with_avg_rank(with_avg_rank(pairs, "x", ["a", "b"], "rx"), "y", ["a", "b"], "ry")
    return ranked.select("a", "b", F.col("rx").alias("x"), F.col("ry").alias("y"))


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers of a small matrix, joined by mean distance while it is at most the cut; numbered by first member.

    Nearest-neighbour chains: two that are each other's nearest join, whatever else is left to join. Of equally near ones the
    chain's last, then the first in order, is taken."""
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, group, left, chain = np.ones(n), list(range(n)), set(range(n)), []
    while len(left) > 1:
        chain = chain or [min(left)]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        low, high = sorted((i, j))
        if d[i, j] <= cut:
            group = [group[low] if g == group[high] else g for g in group]
        d[low] = d[:, low] = (size[low] * d[low] + size[high] * d[high]) / (size[low] + size[high])
        d[low, low] = d[high] = d[:, high] = np.inf
        size[low] += size[high]
        left.discard(high)
    order = list(dict.fromkeys(group))
    return [order.index(g) for g in group]


def representatives(df: DataFrame, cols: Sequence[str], threshold: float = 0.7, key: str = "scan_name") -> tuple[list[str], list[str]]:
    """(kept, dropped): of columns that correlate at the threshold (average linkage) the most central one stays, the first on ties (to nine digits)."""
    rows = corr_matrix(df, cols, key=key).collect()
    at = {c: i for i, c in enumerate(cols)}
    rho = np.eye(len(cols))
    for r in rows:
        if r["a"] != r["b"]:
            rho[at[r["a"]], at[r["b"]]] = abs(r["r"])
    kept = []
    group = average_linkage(1 - rho, 1 - threshold)
    for k in sorted(set(group)):
        own = [i for i, g in enumerate(group) if g == k]
        kept.append(max(own, key=lambda i: (round(rho[i, own].mean(), 9), -i)))
    return [c for i, c in enumerate(cols) if i in kept], [c for i, c in enumerate(cols) if i not in kept]


def choose_features(df: DataFrame, whitelist: Sequence[str], threshold: float = 0.7, order: str = "cell_id") -> tuple[list[str], list[str]]:
    """representatives of those whitelisted columns that are numeric, present and usable at scan level."""
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    present = [c for c in whitelist if c in numeric]
    scans = drop_unusable(scan_level(df, present, order=order), present)
    return representatives(scans, [c for c in present if c in scans.columns], threshold)


def _design(df: DataFrame, covariates: Sequence[str], group: str, a: str) -> tuple[DataFrame, list[str]]:
    """Columns of the linear model: intercept, group, numbers as they are, levels of texts but the first."""
    kinds, terms = dict(df.dtypes), {"_one": F.lit(1.0), "_group": (F.col(group) == a).cast("double")}
    for c in covariates:
        if kinds[c] == "string":
            levels = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect())
            terms |= {f"_{c}_{v}": (F.col(c) == v).cast("double") for v in levels[1:]}
        else:
            terms[f"_{c}"] = F.col(c).cast("double")
    names = [f"_x{i}" for i in range(len(terms))]
    return df.withColumns(dict(zip(names, terms.values(), strict=True))), names


def group_contrast(scans: DataFrame, features: Sequence[str], covariates: Sequence[str], a: str, b: str, group: str = "diagnosis_group") -> DataFrame:
    """(feature, coef, se, t_stat, p_value, ci_low, ci_high, n, error, q_value): a against b with covariates.

    Least squares from the sums X'X and X'y of each feature; a singular fit is a row with its reason."""
    rows, x = _design(scans.where(F.col(group).isin(a, b)), covariates, group, a)
    long = _long(rows, features, *x).dropna()
    k = len(x)
    square = [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    cross = [F.sum(F.col(c) * F.col("value")).alias(f"v{i}") for i, c in enumerate(x)]
    sums = long.groupBy("feature").agg(*square, *cross, F.sum(F.col("value") * F.col("value")).alias("yy"), F.count("*").alias("n"), F.sum(x[1]).alias("n_a"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                v, n = np.array([r[f"v{i}"] for i in range(k)]), int(r["n"])
                live = [i for i in range(k) if m[i, i] > 0]
                if n <= len(live) or not 0 < r["n_a"] < n or np.linalg.matrix_rank(m[np.ix_(live, live)]) < len(live):
                    out.append((r["feature"], *[None] * 6, n, "singular" if n > len(live) else "too few rows"))
                    continue
                inverse = np.linalg.inv(m[np.ix_(live, live)])
                beta = inverse @ v[live]
                at = live.index(1)
                rest = max(0.0, float(r["yy"] - beta @ v[live]))
                se = math.sqrt(rest / (n - len(live)) * inverse[at, at])
                t = float(beta[at]) / se if se > 0 else float("nan")
                out.append((r["feature"], float(beta[at]), se, t, special.t_two_sided(t, n - len(live)), float(beta[at]) - 1.96 * se, float(beta[at]) + 1.96 * se, n, None))
            yield pd.DataFrame(out, columns=["feature", "coef", "se", "t_stat", "p_value", "ci_low", "ci_high", "n", "error"])

    fits = sums.mapInPandas(solve, "feature string, coef double, se double, t_stat double, p_value double, ci_low double, ci_high double, n long, error string")
    return order_results(fdr_bh(fits, "p_value"), ("q_value", "asc"), ("p_value", "asc"), ("feature", "asc"))


def zscore(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    return zscore_apply(df, zscore_stats(df, cols, ddof), cols)


def zscore_stats(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """One row of means and deviations (0 becomes 1)."""
    dev = F.stddev_samp if ddof else F.stddev_pop
    one = lambda c: F.when(F.coalesce(dev(c), F.lit(0.0)) == 0, 1.0).otherwise(dev(c))
    return df.agg(*(F.avg(c).alias(f"{c}_mean") for c in cols), *(one(c).alias(f"{c}_std") for c in cols))


def zscore_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A stored scaler (one row) on new rows."""
    names = [f"{c}_{s}" for c in cols for s in ("mean", "std")]
    return df.crossJoin(F.broadcast(stats.select(*names))).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols}).drop(*names)


def permanova(scans: DataFrame, features: Sequence[str], n_perm: int = 999, group: str = "diagnosis_group", key: str = "scan_name", seed: int = 0) -> DataFrame:
    """One row (pseudo_f, r2, p_value, n, n_groups, n_perm) over z-scores.

    Squared distances within a group sum to n times its squared deviations, so a permutation is one grouped
    sum; labels are dealt by ranks of a hash, so group sizes stay."""
    rows = zscore(scans.dropna(subset=[group, *features]), features, 1).select(key, F.col(group).alias("g"), *features)
    labels = rows.select("g", F.row_number().over(Window.orderBy("g", key)).alias("place"))  # scans, some tens
    each = rows.drop("g").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm))).alias("perm"))
    own = F.when(F.col("perm") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.col(key), "perm", F.lit(str(seed)))))
    first = rows.select(key, F.row_number().over(Window.orderBy("g", key)).alias("_o"))
    placed = each.join(first, key).withColumn("place", F.row_number().over(Window.partitionBy("perm").orderBy(own, "_o")))
    dealt = placed.join(labels, "place")
    within = dealt.groupBy("perm", "g").agg(sum((F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*") for c in features[1:]), F.sum(F.col(features[0]) * F.col(features[0])) - F.sum(features[0]) * F.sum(features[0]) / F.count("*")).alias("ss"), F.count("*").alias("n"))
    total = sum((F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*") for c in features[1:]), F.sum(F.col(features[0]) * F.col(features[0])) - F.sum(features[0]) * F.sum(features[0]) / F.count("*"))
    sst = rows.agg(total.alias("sst"))
    per = within.groupBy("perm").agg(F.sum("ss").alias("ssw"), F.sum("n").alias("n"), F.count("*").alias("k")).crossJoin(F.broadcast(sst))
    f = ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    per = per.withColumn("f", f)
    real = F.max(F.when(F.col("perm") == 0, F.col("f"))).over(Window.partitionBy(F.lit(0)))  # a row per permutation
    return per.withColumn("real", real).agg(
        F.max("real").alias("pseudo_f"), F.max(F.when(F.col("perm") == 0, 1 - F.col("ssw") / F.col("sst"))).alias("r2"),
        ((F.count_if((F.col("perm") > 0) & (F.col("f") >= F.col("real") - 1e-12)) + 1) / F.lit(n_perm + 1)).alias("p_value"), F.max("n").alias("n"), F.max("k").alias("n_groups"), F.lit(n_perm).alias("n_perm"),
    )


def _dirichlet_fits(replicates: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, alpha array, n): fits from the mean logs of each group; null alpha where a fit fails."""
    means = replicates.groupBy(*by).agg(*(F.avg(F.log(c)).alias(f"l_{c}") for c in cols), *(F.avg(c).alias(f"m_{c}") for c in cols), F.count("*").alias("n"))
    kinds = dict(replicates.dtypes)

    def fit(batches):
        for pdf in batches:
            alphas = [special.dirichlet_fit([r[f"l_{c}"] for c in cols], [max(1e-3, r[f"m_{c}"] * 10) for c in cols]) for r in pdf.to_dict("records")]
            out = pdf[[*by, "n"]].copy()
            out["alpha"] = alphas
            yield out[[*by, "alpha", "n"]]

    return means.mapInPandas(fit, ", ".join([*(f"{c} {kinds[c]}" for c in by), "alpha array<double>, n long"]))


def dirichlet_groups(props: DataFrame, cols: Sequence[str], group: str = "diagnosis_group", by: Sequence[str] = ()) -> DataFrame:
    """(group, cluster, alpha, mean, variance, concentration, entropy, n) of maximum-likelihood fits."""
    from .filters import normalise_composition

    fits = _dirichlet_fits(normalise_composition(props.dropna(subset=[group, *cols]), cols), cols, [*by, group])
    total = F.aggregate("alpha", F.lit(0.0), lambda s, a: s + a)
    rows = fits.withColumn("concentration", total).select(*by, group, "n", "concentration", "alpha", F.posexplode("alpha").alias("i", "a"))
    mean = F.col("a") / F.col("concentration")
    mean_of = lambda x: x / F.col("concentration")
    entropy = -F.aggregate("alpha", F.lit(0.0), lambda s, x: s + mean_of(x) * F.log(mean_of(x)))
    return rows.select(*by, group, F.array(*map(F.lit, cols))[F.col("i")].alias("cluster"), F.col("a").alias("alpha"), mean.alias("mean"), (mean * (1 - mean) / (F.col("concentration") + 1)).alias("variance"), "concentration", entropy.alias("entropy"), "n")


def dirichlet_compare(props: DataFrame, cols: Sequence[str], a: str, b: str, n_boot: int = 200, group: str = "diagnosis_group", key: str = "scan_name", seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(cluster, diff, boot_mean, ci_low, ci_high, p_direction, n_good): a's mean part less b's, with a bootstrap.

    A replicate draws its scans by hash; all replicates are one grouped job. Fewer good fits than a fifth (or
    100, if there are so many) leave the interval null."""
    from .filters import normalise_composition

    rows = normalise_composition(props.where(F.col(group).isin(a, b)).dropna(subset=list(cols)), cols)
    part = [*by, group]
    numbered = rows.withColumns({"_i": F.row_number().over(Window.partitionBy(*part).orderBy(key)) - 1, "_n": F.count("*").over(Window.partitionBy(*part))})
    draws = numbered.select(*part, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep")).withColumn("_i", F.pmod(F.xxhash64("rep", "_i", *part, F.lit(seed)), F.col("_n")))
    sampled = draws.select(*part, "rep", "_i").join(numbered.select(*part, "_i", *cols), [*part, "_i"]).drop("_i")
    both = sampled.select(*by, group, "rep", *cols).unionByName(rows.select(*by, group, F.lit(0).alias("rep"), *cols))
    fits = _dirichlet_fits(both, cols, [*by, group, "rep"]).where("alpha is not null")
    total = F.aggregate("alpha", F.lit(0.0), lambda s, x: s + x)
    means = fits.select(*by, group, "rep", F.posexplode(F.transform("alpha", lambda x: x / total)).alias("i", "m"))
    one = lambda g: F.max(F.when(F.col(group) == g, F.col("m")))
    diffs = means.groupBy(*by, "rep", "i").agg((one(a) - one(b)).alias("d")).where("d is not null")
    boot = F.when(F.col("rep") > 0, F.col("d"))
    enough = F.count(boot) >= max(min(100, n_boot // 2), n_boot // 5)
    out = diffs.groupBy(*by, "i").agg(
        F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("diff"), F.when(enough, F.avg(boot)).alias("boot_mean"), F.when(enough, F.percentile(boot, F.lit(0.025))).alias("ci_low"),
        F.when(enough, F.percentile(boot, F.lit(0.975))).alias("ci_high"), F.when(enough, F.avg((boot > 0).cast("double"))).alias("p_direction"), F.count(boot).alias("n_good"),
    )
    return out.select(*by, F.array(*map(F.lit, cols))[F.col("i")].alias("cluster"), "diff", "boot_mean", "ci_low", "ci_high", "p_direction", "n_good")


def dirichlet_loo(props: DataFrame, cols: Sequence[str], a: str, b: str, n_boot: int = 100, group: str = "diagnosis_group", key: str = "scan_name", seed: int = 0) -> DataFrame:
    """dirichlet_compare without each scan in turn: the same columns with `dropped` ('' for none). One grouped job."""
    rows = props.where(F.col(group).isin(a, b))
    names = rows.select(F.col(key).alias("dropped")).distinct().unionByName(rows.sparkSession.createDataFrame([("",)], "dropped string"))
    return dirichlet_compare(rows.crossJoin(F.broadcast(names)).where(F.col(key) != F.col("dropped")), cols, a, b, n_boot, group, key, seed, ["dropped"])  # scans x scans, some thousands


def kruskal(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, h, p_value, n, n_groups): rank test with tie correction; null with fewer than two groups."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, F.col(group).alias("g"), F.col(value).alias("v"))
    ranks = placed(rows, "v", by).withColumn("_rank", F.col("_before") + (F.col("_n") + 1) / 2.0)
    ranked = join_null_safe(rows.groupBy(*by, "g", "v").agg(F.count("*").alias("m")), ranks, by, ["v"])
    groups = ranked.groupBy(*by, "g", F.col("_total").alias("n")).agg(F.sum(F.col("_rank") * F.col("m")).alias("s"), F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("_n").cast("double") * F.col("_n") - 1)).alias("t"))
    n = F.max("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.sum(F.col("s") * F.col("s") / F.col("m")) - 3 * (n + 1)) / (1 - F.sum("t") / (n * n * n - n))
    out = groups.groupBy(*by).agg(F.when(F.count("*") > 1, h).alias("h"), F.max("n").alias("n"), F.count("*").alias("n_groups"))
    return _with_p(out, lambda r: special.chi2_upper(r["h"], r["n_groups"] - 1), "h")


def _with_p(df: DataFrame, p, stat: str) -> DataFrame:
    """df with p_value from its rows: one per test."""

    def add(batches):
        for pdf in batches:
            pdf["p_value"] = [None if pd.isna(r[stat]) else float(p(r)) for r in pdf.to_dict("records")]
            yield pdf

    return df.mapInPandas(add, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "p_value double"]))


def spearman_test(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r, n, p_value) of column pairs over complete rows; null with two rows or fewer."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs)))
    rows = df.select(each.alias("p")).select("p.*").dropna()
    out = _ranked(rows).groupBy("a", "b").agg(F.when(F.count("*") > 2, F.nanvl(F.corr("x", "y"), F.lit(None))).alias("r"), F.count("*").alias("n"))
    return _with_p(out, lambda r: 0.0 if abs(r["r"]) >= 1 else special.t_two_sided(r["r"] * math.sqrt((r["n"] - 2) / (1 - r["r"] ** 2)), r["n"] - 2), "r")


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))
