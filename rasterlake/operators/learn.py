"""Class-balanced logistic regression on sample tables: imputing, scaling, fitting, choosing, scoring.

Samples are ``(sample_id, source, label, features...)``; null and non-finite
features are not computable and are imputed.  Ranks, folds and medians come from
``ranks``, so no task holds a whole class or column.  Many models are fitted together: every Newton step
is one scan, and only the small gradient and Hessian of each model come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rasterlake.operators.ranks import medians, running, running_sums
from rasterlake.session import materialize, ship_code

LAMBDAS = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]


def clean_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-finite features become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in cols})


def impute(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Median imputation of null and non-finite features per key (whole table without keys)."""
    df = clean_nan(df, cols)
    med = medians(df, cols, keys)
    j = df.join(F.broadcast(med), keys) if keys else df.crossJoin(F.broadcast(med))  # one row per model key
    return j.withColumns({c: F.coalesce(c, f"med_{c}") for c in cols}).drop(*(f"med_{c}" for c in cols))


def standardize(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Population mean and standard deviation (+1e-9), after imputing."""
    st = df.groupBy(*(keys or [])).agg(*(F.avg(c).alias(f"mu_{c}") for c in cols), *((F.stddev_pop(c) + 1e-9).alias(f"sd_{c}") for c in cols))
    j = df.join(F.broadcast(st), keys) if keys else df.crossJoin(F.broadcast(st))
    return j.withColumns({c: (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") for c in cols}).drop(*(f"{p}_{c}" for c in cols for p in ("mu", "sd")))


def class_weights(df: DataFrame) -> DataFrame:
    """``cw``: half the inverse share of the sample's class."""
    p = df.agg(F.avg("label").alias("p"))
    return df.crossJoin(F.broadcast(p)).withColumn("cw", F.when(F.col("label") == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p")))).drop("p")


def _fold_places(df: DataFrame, repeats: int, k: int) -> DataFrame:
    """``sample_id, label, repeat, fold`` of each sample; rows that repeat a sample have one place."""
    r = df.select("sample_id", "label").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = r.withColumn("h", F.expr("pmod((sample_id + 1) * (7919 + 104729 * repeat), 1000003)"))
    once = r.groupBy("repeat", "label", "sample_id").agg(F.first("h").alias("h"))
    place = running(once, ["h", "sample_id"], keys=["repeat", "label"])
    return place.select("sample_id", "label", "repeat", F.pmod(F.col("upto") - 1, F.lit(k)).cast("int").alias("fold"))


def folds(df: DataFrame, repeats: int = 10, k: int = 5) -> DataFrame:
    """``repeat, fold``: stratified by label, in an order given by a public arithmetic hash of the id."""
    return df.join(_fold_places(df, repeats, k), ["sample_id", "label"])


def probability(cols: list[str], weights: list[float], bias: float):
    """Logistic score with the sum held within 60."""
    s = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in zip(cols, weights)), F.lit(bias))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), s))))


def decide(df: DataFrame, cols: list[str], model: list[dict], bias: float, threshold: float = 0.5) -> DataFrame:
    """``prob, is_handwritten, imputed`` from the model's medians, means, deviations and weights."""
    z = {c: (F.coalesce(F.col(c), F.lit(float(m["median_for_missing"]))) - m["mean"]) / m["std"] for c, m in zip(cols, model)}
    names = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in cols)), lambda v: v.isNotNull())
    s = reduce(lambda a, b: a + b, (z[c] * m["weight"] for c, m in zip(cols, model)), F.lit(float(bias)))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), s))))
    return df.withColumn("prob", p).withColumn("is_handwritten", F.col("prob") >= threshold).withColumn("imputed", names)


def decide_by(df: DataFrame, cols: list[str], record: DataFrame) -> DataFrame:
    """``decide`` by a model record in a table of one row: ``features`` (by ``index``), ``bias`` and, or 0.5, ``decision_threshold``.

    A record with another number of features than ``cols`` is an error.
    """
    threshold = F.coalesce("decision_threshold", F.lit(0.5)) if "decision_threshold" in record.columns else F.lit(0.5)
    fits = F.when(F.size("features") == len(cols), F.expr("array_sort(features, (a, b) -> cast(a.index - b.index as int))")).otherwise(F.raise_error(F.lit(f"the record needs {len(cols)} features")))
    m = record.limit(1).select(F.struct(fits.alias("f"), F.col("bias").cast("double").alias("bias"), threshold.alias("t")).alias("__model"))
    f = F.col("__model.f")
    parts = ((F.coalesce(F.col(c), f[i]["median_for_missing"]) - f[i]["mean"]) / f[i]["std"] * f[i]["weight"] for i, c in enumerate(cols))
    s = reduce(lambda a, b: a + b, parts, F.col("__model.bias"))
    names = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in cols)), lambda v: v.isNotNull())
    out = df.crossJoin(F.broadcast(m)).withColumn("prob", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), s)))))
    return out.withColumn("is_handwritten", F.col("prob") >= F.col("__model.t")).withColumn("imputed", names).drop("__model")


def metrics(df: DataFrame, keys: list[str] | None = None, ranks: bool = True) -> DataFrame:
    """From ``label, prob``: rates, balanced accuracy, log losses, precision, F1, errors, R2 and rank AUC.

    Without ``ranks`` there is no AUC, and no row is sorted or written.
    """
    y, hit = F.col("label") == 1, F.col("prob") >= 0.5
    r = df.select(*(keys or []), "label", "prob")
    r = _mid_ranks(r, keys) if ranks else r
    pos, neg, tp, fp = F.count_if(y), F.count_if(~y), F.count_if(y & hit), F.count_if(~y & hit)
    tpr, tnr = tp / F.greatest(pos, F.lit(1)), (neg - fp) / F.greatest(neg, F.lit(1))
    ll = lambda c, p: F.coalesce(-F.avg(F.when(c, F.ln(F.greatest(p, F.lit(1e-12))))), F.lit(0.0))
    p = F.col("prob")
    auc = [F.when((pos > 0) & (neg > 0), (F.sum(F.when(y, F.col("rk"))) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc")] if ranks else []
    return r.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), tpr.alias("tpr"), tnr.alias("tnr"), ((tpr + tnr) / 2).alias("balanced_accuracy"), (1 - tnr).alias("fp_share"),
        (0.5 * ll(y, p) + 0.5 * ll(~y, 1 - p)).alias("balanced_log_loss"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), (2 * tp / F.greatest(2 * tp + fp + pos - tp, F.lit(1))).alias("f1"),
        F.sqrt(F.avg((p - F.col("label")) * (p - F.col("label")))).alias("rmse"), *auc,
        (-F.avg(F.ln(F.greatest(F.when(y, p).otherwise(1 - p), F.lit(1e-12))))).alias("bce"),
        F.when(F.var_pop("label") > 0, 1 - F.avg((p - F.col("label")) * (p - F.col("label"))) / F.var_pop("label")).alias("r2"),
    )


def _mid_ranks(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``rk``: the mean rank of equal scores, from running counts of the distinct scores."""
    keys = keys or []
    df = materialize(df, "ranks")
    upto = running(df.groupBy(*keys, "prob").agg(F.count("*").alias("c")), ["prob"], "c", keys)
    return df.join(upto.select(*keys, "prob", (F.col("upto") - (F.col("c") - 1) / 2).alias("rk")), [*keys, "prob"])


def penalty(weights: list[float], lam: float) -> float:
    """The L2 part of the loss; the bias has none."""
    return lam * sum(w * w for w in weights)


def _step(m: tuple, tried: np.ndarray, sw: float, loss: float, g: np.ndarray, h: np.ndarray, w: dict, base: dict, move: dict, tol: float) -> None:
    """Takes the weights tried for model ``m`` if they lower its loss, and finds its next Newton step (none when settled); else halves the step.

    ``m`` begins with lambda; ``loss``, ``g`` and ``h`` are sums, ``sw`` that of the sample weights.
    """
    value = loss / sw + penalty(tried[:-1], m[0])
    if m in base and not value <= base[m] + 1e-12:
        move[m] = move[m] / 2
        return
    w[m], base[m] = tried, value
    pull = 2 * m[0] * np.append(np.ones(len(tried) - 1), 0.0)
    step = np.linalg.solve(h / sw + np.diag(pull) + 1e-12 * np.eye(len(tried)), g / sw + pull * tried)
    move[m] = step if float(np.abs(step).max()) >= tol else None


def _settled(w: dict, base: dict, move: dict, rounds: int) -> None:
    open_ = [m for m in w if m not in base or move[m] is not None]
    if open_:
        raise ValueError(f"{len(open_)} of {len(w)} models have not settled after {rounds} rounds")


def fit_grouped(df: DataFrame, cols: list[str], keys: list[str], lams: list[float], rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """``lam, keys, w array<double>`` (bias last) minimising weighted BCE + lam * |w|^2 for each key and lambda.

    ``df`` has ``keys``, ``label``, ``cw`` and standardized ``cols``.  A round is
    one pass: the models of a key are an array beside each row, and the sums of
    all of them are grouped at once.  Newton steps are halved while they do not
    lower the loss; a model that has not settled after ``rounds`` is an error.
    The number of models is the size of the grid, not of the data.
    """
    spark, n = df.sparkSession, len(cols) + 1
    xs = [*cols, "__one"]
    df = materialize(df.withColumn("__one", F.lit(1.0)).select(*keys, "label", "cw", *xs), "fit")
    groups = [tuple(r) for r in df.select(*keys).distinct().collect()]
    w = {(lam, *g): np.zeros(n) for lam in lams for g in groups}
    base, move = {}, {}
    tri = [(i, j) for i in range(n) for j in range(i, n)]
    schema = df.select(*keys).schema.add("lam", DoubleType()).add("w", ArrayType(DoubleType()))
    for _ in range(rounds):
        live = [m for m in w if m not in base or move[m] is not None]
        if not live:
            break
        tried = {m: w[m] - move[m] if m in base else w[m] for m in live}
        now = spark.createDataFrame([(*m[1:], m[0], tried[m].tolist()) for m in live], schema)
        j = df.join(F.broadcast(now), keys)
        j = j.withColumn("s", reduce(lambda a, b: a + b, (F.col(c) * F.col("w")[i] for i, c in enumerate(xs))))
        j = j.withColumn("p", 1 / (1 + F.exp(-F.col("s")))).withColumn("g", F.col("cw") * (F.col("p") - F.col("label"))).withColumn("q", F.col("cw") * F.col("p") * (1 - F.col("p")))
        # log(1 + exp(s)) without overflow
        loss = F.col("cw") * (F.greatest("s", F.lit(0.0)) + F.log1p(F.exp(-F.abs("s"))) - F.col("label") * F.col("s"))
        sums = [F.sum(F.col("g") * F.col(c)).alias(f"g{i}") for i, c in enumerate(xs)] + [F.sum(F.col("q") * F.col(xs[a]) * F.col(xs[b])).alias(f"h{a}_{b}") for a, b in tri]
        for r in j.groupBy("lam", *keys).agg(F.sum("cw").alias("sw"), F.sum(loss).alias("loss"), *sums).collect():
            m = (r["lam"], *(r[c] for c in keys))
            h = np.zeros((n, n))
            for a, b in tri:
                h[a, b] = h[b, a] = r[f"h{a}_{b}"]
            _step(m, tried[m], r["sw"], r["loss"], np.array([r[f"g{i}"] for i in range(n)]), h, w, base, move, tol)
    _settled(w, base, move, rounds)
    return spark.createDataFrame([(m[0], *m[1:], v.tolist()) for m, v in w.items()], "lam double, " + ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", w array<double>")


def fold_table(df: DataFrame, cols: list[str], repeats: int, k: int) -> DataFrame:
    """``label, folds`` and ``cols``: one row a sample, with its fold in each repeat."""
    of = F.transform(F.sort_array(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"])  # as many as repeats
    lists = _fold_places(df, repeats, k).groupBy("sample_id", "label").agg(of.alias("folds"))
    return clean_nan(df, cols).join(lists, ["sample_id", "label"]).select("label", "folds", *cols)


def fold_statistics(table: DataFrame, cols: list[str], repeats: int, k: int) -> dict[tuple[int, int], dict]:
    """Of each (repeat, fold left out): class share, medians, means and deviations of the training part.

    The medians come from one cut of the distinct values into ranges, with running counts of each
    fold; moments after imputing follow from sums of powers about the median.  The
    result has the size of the grid.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in cols)))
    long = table.select("folds", each.alias("e")).select("folds", "e.*").filter("v is not null")
    long = long.select("col", "v", F.posexplode("folds").alias("repeat", "fold"))
    counts = long.groupBy("col", "repeat", "v").agg(*(F.count_if(F.col("fold") == j).alias(f"n{j}") for j in range(k)))
    upto = running_sums(counts, ["v"], {f"u{j}": F.col(f"n{j}") for j in range(k)}, ["col", "repeat"])
    upto = materialize(upto, "folds")
    total = upto.groupBy("col", "repeat").agg(*(F.max(f"u{j}").alias(f"t{j}") for j in range(k)))
    both = upto.join(F.broadcast(total), ["col", "repeat"])  # a row for each column and repeat
    without = lambda p, out: sum((F.col(f"{p}{j}") for j in range(k) if j != out), F.lit(0))
    picks = []
    for out in range(k):
        u, n, t = (without(p, out) for p in "unt")
        for name, i in (("low", 1), ("high", 2)):
            at = F.floor((t + i) / 2)
            picks.append(F.max(F.when((u - n < at) & (at <= u), F.col("v"))).alias(f"{name}{out}"))
    got = both.groupBy("col", "repeat").agg(*picks).collect()
    med = {(r["repeat"], out, r["col"]): 0.0 if r[f"low{out}"] is None else (r[f"low{out}"] + r[f"high{out}"]) / 2 for r in got for out in range(k)}
    stats = {(r, out): {"med": [med.get((r, out, c), 0.0) for c in cols]} for r in range(repeats) for out in range(k)}
    # two passes, as the deviation is about the mean of imputed values
    for what in ("mu", "sd"):
        sums = _summed(table, cols, _Moments(stats, what, len(cols)))
        for key, (n, *v) in sums.items():
            v = np.array(v)
            if what == "mu":
                stats[key] |= {"n": n} | ({"p": v[0] / n, "mu": v[1:] / n} if n else {})
            else:
                stats[key]["sd"] = np.sqrt(v[1:] / n) + 1e-9
        if what == "mu":
            stats = {key: st for key, st in stats.items() if st.get("n")}
    return stats


class _Moments:
    """Sums of the label and of the imputed columns (``mu``), or of their squared deviations (``sd``)."""

    def __init__(self, stats: dict, what: str, width: int) -> None:
        self.stats, self.what, self.width = stats, what, 2 + width

    def keys(self) -> list:
        return list(self.stats)

    def __call__(self, key, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.what == "sd":
            x = (x - self.stats[key]["mu"]) ** 2
        return np.concatenate([[len(y), y.sum()], x.sum(0)])


class _Newton:
    """Loss, gradient and Hessian sums of models (repeat, fold left out, lambda), all lambdas of a key at once."""

    def __init__(self, stats: dict, tried: dict[tuple, dict[float, np.ndarray]], n: int) -> None:
        self.stats, self.tried = stats, tried
        self.tri = np.triu_indices(n)
        self.each = 2 + n + len(self.tri[0])
        self.width = max(len(t) for t in tried.values()) * self.each

    def keys(self) -> list:
        return list(self.tried)

    def __call__(self, key, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        st = self.stats[key]
        z = np.c_[(x - st["mu"]) / st["sd"], np.ones(len(y))]
        cw = np.where(y == 1, 0.5 / st["p"] if st["p"] else 0.0, 0.5 / (1 - st["p"]) if st["p"] < 1 else 0.0)
        w = np.array([v for _, v in sorted(self.tried[key].items())])
        s = z @ w.T
        p = 1 / (1 + np.exp(-np.maximum(s, -700)))
        g = cw[:, None] * (p - y[:, None])
        q = cw[:, None] * p * (1 - p)
        loss = cw[:, None] * (np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s))) - y[:, None] * s)
        h = np.einsum("nl,na,nb->lab", q, z, z, optimize=True)[:, self.tri[0], self.tri[1]]
        out = np.c_[np.full(len(w), cw.sum()), loss.sum(0), g.T @ z, h].ravel()
        return np.pad(out, (0, self.width - len(out)))


def _summed(table: DataFrame, cols: list[str], measure) -> dict[tuple[int, int], list[float]]:
    """Sums of ``measure`` over the training part of each key, in one scan with a row for each key and task."""
    ship_code(table.sparkSession)
    stats, keys, width = measure.stats, measure.keys(), measure.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(keys), width))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            folds_of = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]], 1)
            for i, key in enumerate(keys):
                train = folds_of[:, key[0]] != key[1]
                part = x[train]
                held[i] += measure(key, np.where(np.isnan(part), stats[key]["med"], part), y[train])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int32()), *(pa.array(held[:, j]) for j in range(width))], names=["key", *(f"v{j}" for j in range(width))])

    rows = table.select("label", "folds", *cols).mapInArrow(run, "key int, " + ", ".join(f"v{j} double" for j in range(width)))
    got = rows.groupBy("key").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width))).collect()  # the size of the grid
    return {keys[r["key"]]: [r[f"v{j}"] for j in range(width)] for r in got}


def fit_folds(table: DataFrame, cols: list[str], stats: dict, lams: list[float], rounds: int = 60, tol: float = 1e-9) -> dict[tuple, np.ndarray]:
    """Weights (bias last) by (lambda, repeat, fold left out), of samples with their folds.

    Each round is one scan of the samples, which are not repeated: a task sums the
    parts of all models' gradients and Hessians, and only these sums meet.  Steps are those of
    ``fit_grouped``.
    """
    n = len(cols) + 1
    w = {(lam, *key): np.zeros(n) for lam in lams for key in stats}
    base, move = {}, {}
    for _ in range(rounds):
        live = [m for m in w if m not in base or move[m] is not None]
        if not live:
            break
        tried: dict[tuple, dict[float, np.ndarray]] = {}
        for m in live:
            tried.setdefault(m[1:], {})[m[0]] = w[m] - move[m] if m in base else w[m]
        newton = _Newton(stats, tried, n)
        for key, sums in _summed(table, cols, newton).items():
            for i, lam in enumerate(sorted(tried[key])):
                m, v = (lam, *key), np.array(sums[i * newton.each : (i + 1) * newton.each])
                h = np.zeros((n, n))
                h[newton.tri] = v[2 + n :]
                _step(m, tried[key][lam], v[0], v[1], v[2 : 2 + n], h + np.triu(h, 1).T, w, base, move, tol)
    _settled(w, base, move, rounds)
    return w


def cross_validate(df: DataFrame, cols: list[str], lambdas: list[float] = LAMBDAS, repeats: int = 10, k: int = 5, ranks: bool = True) -> DataFrame:
    """``lam, repeat, out`` and metrics (AUC with ``ranks``): imputing, scaling and weights refitted on each training part."""
    spark = df.sparkSession
    table = materialize(fold_table(df, cols, repeats, k), "folds")
    stats = fold_statistics(table, cols, repeats, k)
    models = fit_folds(table, cols, stats, list(lambdas))
    num = lambda v: [float(x) for x in v]
    rows = [(r, out, lam, num(stats[r, out]["med"]), num(stats[r, out]["mu"]), num(stats[r, out]["sd"]), num(w)) for (lam, r, out), w in models.items()]
    grid = spark.createDataFrame(rows, "repeat int, out int, lam double, med array<double>, mu array<double>, sd array<double>, w array<double>")
    # a sample is held out once in each repeat
    held = table.select("label", *cols, F.posexplode("folds").alias("repeat", "out")).join(F.broadcast(grid), ["repeat", "out"])
    s = reduce(lambda a, b: a + b, ((F.coalesce(F.col(c), F.col("med")[i]) - F.col("mu")[i]) / F.col("sd")[i] * F.col("w")[i] for i, c in enumerate(cols)), F.col("w")[len(cols)])
    return metrics(held.withColumn("prob", 1 / (1 + F.exp(-s))), ["lam", "repeat", "out"], ranks)


def select_lambda(cv: DataFrame) -> tuple[float, DataFrame]:
    """The lambda of least mean balanced log loss, the smallest of equals, and the means."""
    means = cv.groupBy("lam").agg(*(F.avg(c).alias(c) for c in ("tpr", "tnr", "balanced_accuracy", "fp_share", "balanced_log_loss")))
    return means.agg(F.min_by("lam", F.struct("balanced_log_loss", "lam"))).first()[0], means


def enough_samples(df: DataFrame, primary: str, least: int = 10) -> None:
    """Stops when a class of the primary source has fewer than ``least`` samples."""
    r = df.filter(F.col("source") == primary).agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
    if min(r["a"], r["b"]) < least:
        raise ValueError(f"too few samples: {r['a']} positive, {r['b']} negative, {least} needed")


def train_model(df: DataFrame, cols: list[str], lambdas: list[float] = LAMBDAS, repeats: int = 10, k: int = 5) -> DataFrame:
    """One-row model record: counts, lambda, bias, features with medians, means, deviations, weights, metrics."""
    spark = df.sparkSession
    # the choice needs no AUC, and ranks would sort every sample once for each repeat and lambda
    lam, means = select_lambda(cross_validate(df, cols, lambdas, repeats, k, ranks=False))
    df = clean_nan(df, cols)
    row = medians(df, cols).crossJoin(df.agg(F.count("*").alias("n"), F.sum("label").alias("pos"))).first()
    filled = df.withColumns({c: F.coalesce(c, F.lit(row[f"med_{c}"])) for c in cols})
    st = filled.agg(*(F.avg(c).alias(f"mu_{c}") for c in cols), *((F.stddev_pop(c) + 1e-9).alias(f"sd_{c}") for c in cols)).first()
    z = class_weights(standardize(filled, cols)).withColumn("all", F.lit(0))
    w = fit_grouped(z, cols, ["all"], [lam]).first()["w"]
    final = metrics(z.withColumn("prob", probability(cols, w[:-1], w[-1]))).first().asDict() | {"l2_penalty": penalty(w[:-1], lam)}
    cv = means.filter(F.col("lam") == lam).first().asDict()
    feats = [(i + 1, c, c, float(row[f"med_{c}"]), float(st[f"mu_{c}"]), float(st[f"sd_{c}"]), float(w[i])) for i, c in enumerate(cols)]
    sources = {r["source"]: r["count"] for r in df.groupBy("source").count().orderBy("source").collect()} if "source" in df.columns else {}
    schema = "dataset struct<handwritten:bigint,formal:bigint,total:bigint,sources:map<string,bigint>>, model string, loss string, selected_lambda double, selection_rule string, decision_threshold double, bias double, features array<struct<index:int,name:string,key:string,median_for_missing:double,mean:double,std:double,weight:double>>, final_training_metrics map<string,double>, cross_validation_at_selected_lambda map<string,double>"
    num = lambda d: {a: float(b) for a, b in d.items() if b is not None}
    rec = ((int(row["pos"]), int(row["n"] - row["pos"]), int(row["n"]), sources), "logistic regression", "class-balanced BCE + lambda * |w|^2", lam, "least mean balanced log loss", 0.5, float(w[-1]), feats, num(final), num(cv))
    return spark.createDataFrame([rec], schema).withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))


def confusion_pairs(pred: DataFrame, k: int | None = 10) -> DataFrame:
    """Most frequent wrong (true, predicted) pairs."""
    c = pred.filter("label <> predicted").groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "label", "predicted").limit(k) if k else c


def feature_drift(df: DataFrame, cols: list[str], model: DataFrame) -> DataFrame:
    """Measured mean and deviation of each feature beside the model's ``(key, mean, std)``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("v")) for c in cols))).alias("f")).select("f.*")
    m = long.groupBy("key").agg(F.avg("v").alias("measured_mean"), F.stddev_pop("v").alias("measured_std"))
    return m.join(F.broadcast(model.select("key", "mean", "std")), "key")
