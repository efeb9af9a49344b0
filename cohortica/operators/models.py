"""Propensity models on Spark ML and the runners that evaluate them over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import (Bucketizer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortica.functions.features import known_category
from cohortica.functions.hashing import hash_int, hash_uniform
from cohortica.functions.ordered import pct_rank, quantiles
from cohortica.functions.periods import in_recent_window, ordinal_of, ordinal
from cohortica.functions.stored import stored
from cohortica.operators.encoding import bin_edges, category_vocabulary
from cohortica.operators.logistic import MAX_WIDTH, fit_logistic
from cohortica.operators.metrics import auc_table, metric_table, monthly_summary
from cohortica.operators.shared_fits import AT_ONCE, Code, SharedDesign, SharedFit, Space, fit_shared, score_shared
from cohortica.operators.splits import with_donor
from cohortica.session import ensure_checkpoint_dir
from cohortica.spec import DEFAULT, PanelSpec


@dataclass(frozen=True)
class ModelSpec:
    """One declarative configuration."""

    name: str
    kind: str  # gbt | logistic | binned_logistic | crossed_logistic | rules
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    window: int | None = None
    half_life: float | None = None
    seeds: tuple[int, ...] = (42,)


def prepare(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Numbers as doubles, NULL categories named, so one schema serves fit and score."""
    return df.select(
        *[c for c in df.columns if c not in spec.numeric and c not in spec.categorical],
        *[F.col(c).cast("double").alias(c) for c in spec.numeric],
        *[known_category(c).alias(c) for c in spec.categorical])


def _indexed(categorical: Sequence[str]) -> list:
    return [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep")] if categorical else []


def _one_hot(columns: Sequence[str]) -> list:
    return [OneHotEncoder(inputCols=list(columns), outputCols=[f"{c}_oh" for c in columns],
                          handleInvalid="keep", dropLast=False)] if columns else []


def tree_stages(spec: ModelSpec) -> list:
    """Category codes and raw numbers (M1)."""
    inputs = [*spec.numeric, *[f"{c}_ix" for c in spec.categorical]]
    return [*_indexed(spec.categorical), VectorAssembler(inputCols=inputs, outputCol="features")]


def _levels(design: PipelineModel) -> int:
    """Largest vocabulary of the indexed categories."""
    return max((len(words) for s in design.stages if hasattr(s, "labelsArray") for words in s.labelsArray), default=0)


def boosted_trees(spec: ModelSpec, label: str, seed: int, weight: str | None = None,
                  validation: str | None = None, levels: int = 0) -> GBTClassifier:
    """Boosted trees on ``features`` (M1); ``levels`` is the largest vocabulary."""
    p = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 20, "subsamplingRate": 0.8,
         "maxBins": BINS, **spec.params}
    p["maxBins"] = max(p["maxBins"], levels + 2)                  # each level, and the unseen one, needs a bin
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, checkpointInterval=10, **p)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


@contextmanager
def _tree_rows(df: DataFrame, used: Sequence[Column], spec: ModelSpec,
               keep: Sequence[str]) -> Iterator[tuple[DataFrame | None, int]]:
    """``keep`` and ``features`` of the rows that a condition in ``used`` takes, kept for all fits of a runner, and how many
    fits may hold so many rows side by side.

    Categories get their codes once, over all these rows. A level that a fit's training rows lack has no
    bin counts there, so it goes with the unseen levels and the trees are those of the fit's own codes. Only the
    number of bins could differ; None where it would, because a vocabulary needs more bins than asked for.
    """
    inner = replace(spec, numeric=tuple(f"_in_{c}" for c in spec.numeric), categorical=tuple(f"_in_{c}" for c in spec.categorical))
    raw = df.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in used])).select(
        *keep, *[F.col(c).cast("double").alias(f"_in_{c}") for c in spec.numeric],
        *[known_category(c).alias(f"_in_{c}") for c in spec.categorical]).persist()
    rows, at_once = None, 1
    try:
        design = Pipeline(stages=tree_stages(inner)).fit(raw)
        if _levels(design) + 2 <= spec.params.get("maxBins", BINS):
            rows = design.transform(raw).select(*keep, "features").persist()
            n = rows.count()                                      # filled, so that the rows without features can go
            at_once = max(1, min(TREES_AT_ONCE, TREE_ROWS // max(n, 1)))
    finally:
        raw.unpersist()
    try:
        yield rows, at_once
    finally:
        if rows is not None:
            rows.unpersist()


def logistic_stages(spec: ModelSpec) -> list:
    """Standardised numbers and one-hot categories (M2)."""
    ix = [f"{x}_ix" for x in spec.categorical]
    return [VectorAssembler(inputCols=list(spec.numeric), outputCol="_num"),
            StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
            *_indexed(spec.categorical), *_one_hot(ix),
            VectorAssembler(inputCols=["_scaled", *[f"{x}_oh" for x in ix]], outputCol="features")]


def exact_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of every column, NULL left out; one number a column reaches the driver. A column without values gets 0."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    found = {r["column"]: r["quantile"] for r in quantiles(long, ["column"], "value", [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def _inner_splits(train: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    edges = {r["column"]: list(r["edges"]) for r in bin_edges(train, columns, bins).collect()}
    return [[float("-inf"), *(edges[c][1:-1] or [edges[c][0] + 1.0]), float("inf")] for c in columns]


def binned_stages(train: DataFrame, spec: ModelSpec) -> list:
    """Quantile bins of the numbers and categories, all one-hot (M3); ``train`` has no missing numbers."""
    binned, ix = [f"{x}_bin" for x in spec.numeric], [f"{x}_ix" for x in spec.categorical]
    splits = _inner_splits(train, spec.numeric, spec.params.get("bins", 10))
    return [Bucketizer(inputCols=list(spec.numeric), outputCols=binned, splitsArray=splits, handleInvalid="keep"),
            *_indexed(spec.categorical), *_one_hot([*binned, *ix]),
            VectorAssembler(inputCols=[f"{x}_oh" for x in [*binned, *ix]], outputCol="features")]


def crossed_stages(train: DataFrame, spec: ModelSpec) -> list:
    """Bins of every number crossed with the first category, one-hot and sparse.

    A crossed column is the text of category and bin, so a row sets one position a number.
    """
    band, bins = spec.categorical[0], [f"{x}_bin" for x in spec.numeric]
    splits = _inner_splits(train, spec.numeric, spec.params.get("bins", 4))
    crossed = [f"{b}_x" for b in bins]
    text = ", ".join(f"concat_ws('_', {band}, '{b}', cast({b} as int)) AS {c}" for b, c in zip(bins, crossed))
    ix = [f"{c}_ix" for c in [*crossed, *spec.categorical]]
    return [Bucketizer(inputCols=list(spec.numeric), outputCols=bins, splitsArray=splits, handleInvalid="keep"),
            SQLTransformer(statement=f"SELECT *, {text} FROM __THIS__"), *_indexed([*crossed, *spec.categorical]), *_one_hot(ix),
            VectorAssembler(inputCols=[f"{x}_oh" for x in ix], outputCol="features")]


@dataclass(frozen=True)
class LinearModel:
    """Medians, fitted design and fitted coefficients of a logistic model."""

    medians: dict[str, float]
    design: PipelineModel
    linear: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self.design.transform(df.fillna(self.medians) if self.medians else df))


def _fit_linear(data: DataFrame, spec: ModelSpec, label: str, weight: str | None) -> LinearModel:
    """L2 logistic over the design of ``spec.kind``.

    The inverse penalty ``C`` divides a summed loss and the fit averages the loss, so the penalty
    is 1 / (C n). Designs up to `logistic.MAX_WIDTH` are fitted by Newton's method, wider ones
    by the iterative solver; both have the same optimum.
    """
    medians = {}
    if spec.kind != "logistic":
        medians = exact_medians(data, spec.numeric) if spec.kind in ("binned_logistic", "crossed_logistic") else {}
        data = data.fillna(medians) if medians else data
    stages = {"binned_logistic": binned_stages, "crossed_logistic": crossed_stages}.get(
        spec.kind, lambda _, s: logistic_stages(s))(data, spec)
    design = Pipeline(stages=stages).fit(data)
    rows = design.transform(data)
    ridge = 1.0 / (spec.params.get("C", 0.1 if "_" in spec.kind else 1.0) * max(data.count(), 1))
    width = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    if width is not None and width["n"] > MAX_WIDTH:
        lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=ridge, standardization=False,
                                maxIter=spec.params.get("maxIter", 300), tol=1e-9)
        return LinearModel(medians, design, (lr.setWeightCol(weight) if weight else lr).fit(rows))
    return LinearModel(medians, design, fit_logistic(rows, label, ridge, weight))


def fit(train: DataFrame, spec: ModelSpec, seed: int = 42, weight: str | None = None,
        validation: str | None = None, panel: PanelSpec = DEFAULT):
    """Fit one configuration.

    Every pipeline stage reads the training rows again, so the pruned rows are kept
    (spilling to disk) while the stages are fitted.
    """
    data = prepare(train, spec)
    extra = [c for c in (panel.label, weight, validation) if c]
    data = data.select(*extra, *spec.numeric, *spec.categorical).persist()
    try:
        if spec.kind == "gbt":
            design = Pipeline(stages=tree_stages(spec)).fit(data)
            trees = boosted_trees(spec, panel.label, seed, weight, validation, _levels(design)).fit(design.transform(data))
            return PipelineModel([*design.stages, trees])
        if spec.kind in ("logistic", "rules", "binned_logistic", "crossed_logistic"):
            return _fit_linear(data, spec, panel.label, weight)
        raise ValueError(f"unknown model kind {spec.kind}")
    finally:
        data.unpersist()


def score(model, df: DataFrame, spec: ModelSpec, keep: Sequence[str], out: str = "prediccion") -> DataFrame:
    """Probability of the event for every row."""
    return _probability(model.transform(prepare(df, spec)), keep, out)


def _probability(scored: DataFrame, keep: Sequence[str], out: str) -> DataFrame:
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def fit_score(train: DataFrame, valid: DataFrame, spec: ModelSpec, weight: str | None = None,
              panel: PanelSpec = DEFAULT, extra: Sequence[str] = ()) -> DataFrame:
    """Mean probability over the seeds of a configuration (M13, E3), with the key, label and ``extra`` columns."""
    keep = [*panel.keys, panel.label, *extra]
    return _seed_mean([score(fit(train, spec, s, weight, panel=panel), valid, spec, keep, panel.score) for s in spec.seeds],
                      keep, panel)


def _seed_mean(runs: Sequence[DataFrame], keep: Sequence[str], panel: PanelSpec) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return both.groupBy(*keep).agg(F.avg(panel.score).alias(panel.score))


def training_rows(df: DataFrame, through: int, spec: ModelSpec, panel: PanelSpec = DEFAULT) -> DataFrame:
    """Rows up to the cut, window and decay weights applied."""
    condition, weight = training_condition(through, spec, panel)
    rows = df.where(condition)
    return rows if weight is None else rows.withColumn("_weight", weight)


def training_condition(through: int, spec: ModelSpec, panel: PanelSpec = DEFAULT) -> tuple[Column, Column | None]:
    """Condition of the training rows and their decay weight, if any."""
    condition = F.col(panel.period) <= through
    if spec.window is not None:
        condition = condition & in_recent_window(panel.period, through, spec.window)
    if spec.half_life is None:
        return condition, None
    age = F.lit(ordinal_of(through)) - ordinal(panel.period)
    return condition, F.pow(F.lit(0.5), age / F.lit(float(spec.half_life)))


def _in_parallel(spark: SparkSession, tasks: Sequence[Callable], at_once: int) -> list:
    """Run driver-side fit calls a few at a time; each submits its own Spark jobs."""
    wrapped = [inheritable_thread_target(spark)(t) for t in tasks]
    with ThreadPool(max(1, min(at_once, len(wrapped)))) as pool:
        return pool.map(lambda t: t(), wrapped)


@dataclass(frozen=True)
class Job:
    """What to fit and score on the kept rows: training rows, rows to score, columns to add, configuration."""

    train: Column
    valid: Column
    literals: dict
    spec: ModelSpec
    weight: Column | None = None


BINS = 64                     # bins of a number in trees
TREES_AT_ONCE = 4             # tree fits side by side
TREE_ROWS = 40_000_000        # rows that tree fits side by side hold, binned
LINEAR = ("logistic", "rules", "binned_logistic", "crossed_logistic")


def _fit_score_all(df: DataFrame, jobs: Sequence[Job], specs: Sequence[ModelSpec], panel: PanelSpec = DEFAULT,
                   extra: Sequence[str] = (), at_once: int = 3) -> DataFrame:
    """Fit and score all jobs over the same rows.

    The columns of all configurations are kept while the fits run. The predictions are
    checkpointed, so later metrics and bootstraps never score again and do not
    depend on the kept rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if all(j.spec.kind == "gbt" for j in jobs) and len({(j.spec.numeric, j.spec.categorical) for j in jobs}) == 1:
        keep = list(dict.fromkeys([*panel.keys, panel.label, *extra]))
        bins = min(j.spec.params.get("maxBins", BINS) for j in jobs)
        with _tree_rows(df, [c for j in jobs for c in (j.train, j.valid)],
                        replace(jobs[0].spec, params={"maxBins": bins}), keep) as (features, side):
            if features is not None:
                return _fit_score_trees(features, jobs, panel, side, extra)
    columns = dict.fromkeys([*panel.keys, panel.label, *extra, *[c for s in specs for c in (*s.numeric, *s.categorical)]])
    rows = df.select(*columns).persist()

    def run(job):
        train, weight = rows.where(job.train), None
        if job.weight is not None:
            train, weight = train.withColumn("_weight", job.weight), "_weight"
        part = fit_score(train, rows.where(job.valid), job.spec, weight, panel, [c for c in extra if c not in job.literals])
        return part.withColumns({k: F.lit(v) for k, v in job.literals.items()}) if job.literals else part

    try:
        out = _shared(rows, jobs, panel, extra) if all(j.spec.kind in LINEAR for j in jobs) else None
        if out is None:
            parts = _in_parallel(df.sparkSession, [lambda j=j: run(j) for j in jobs], at_once)
            out = reduce(lambda a, b: a.unionByName(b), parts)
        return out.checkpoint()
    finally:
        rows.unpersist()


def _fit_score_trees(features: DataFrame, jobs: Sequence[Job], panel: PanelSpec, at_once: int, extra: Sequence[str] = ()) -> DataFrame:
    """Checkpointed predictions of tree jobs on `_tree_rows`."""
    def run(job):
        keep = [*panel.keys, panel.label, *[c for c in extra if c not in job.literals]]
        train, weight = features.where(job.train), None
        if job.weight is not None:
            train, weight = train.withColumn("_weight", job.weight), "_weight"
        models = [boosted_trees(job.spec, panel.label, s, weight).fit(train) for s in job.spec.seeds]
        part = _seed_mean([_probability(m.transform(features.where(job.valid)), keep, panel.score) for m in models], keep, panel)
        return part.withColumns({k: F.lit(v) for k, v in job.literals.items()}) if job.literals else part

    parts = _in_parallel(features.sparkSession, [lambda j=j: run(j) for j in jobs], at_once)
    return reduce(lambda a, b: a.unionByName(b), parts).checkpoint()


def _shared(rows: DataFrame, jobs: Sequence[Job], panel: PanelSpec, extra: Sequence[str]) -> DataFrame | None:
    """All linear jobs in shared passes (`shared_fits`); None where a design is too wide for them."""
    numeric = tuple(dict.fromkeys(c for j in jobs for c in j.spec.numeric))
    categorical = tuple(dict.fromkeys(c for j in jobs for c in j.spec.categorical))
    numbers = [F.col(c).cast("double") for c in numeric]
    row = rows.agg(F.count(F.lit(1)), *[f(x) for x in numbers for f in (F.avg, F.stddev_pop)],
                   *[F.count_distinct(known_category(c)) for c in categorical]).first()
    n, stats = row[0], row[1:1 + 2 * len(numeric)]
    if sum(row[1 + 2 * len(numeric):]) > MAX_WIDTH:
        return None
    words = {c: [] for c in categorical}
    if categorical:
        for r in category_vocabulary(rows, categorical).orderBy("column", "code").collect():
            words[r["column"]].append(r["value"])
    space = Space(numeric, categorical, np.array([m or 0.0 for m in stats[::2]]), np.array([s or 1.0 for s in stats[1::2]]),
                  tuple(tuple(words[c]) for c in categorical))

    def design(job: Job) -> SharedDesign:
        spec = job.spec
        levels = {c: Code(len(words[c]), categorical.index(c)) for c in spec.categorical}
        if spec.kind in ("logistic", "rules"):
            return SharedDesign(tuple(numeric.index(c) for c in spec.numeric), tuple(levels.values()))
        train = rows.where(job.train).select(*[F.col(c).cast("double").alias(c) for c in spec.numeric])
        medians = exact_medians(train, spec.numeric)
        splits = _inner_splits(train.fillna(medians), spec.numeric, spec.params.get("bins", 10 if spec.kind == "binned_logistic" else 4))
        band = spec.categorical[0] if spec.kind == "crossed_logistic" else None
        codes = [Code((len(s) - 1) * (len(words[band]) if band else 1), categorical.index(band) if band else None,
                      numeric.index(c), tuple(s[1:-1]), medians[c]) for c, s in zip(spec.numeric, splits)]
        return SharedDesign((), (*codes, *levels.values()))

    fits = [SharedFit(j.train, j.valid, j.weight, d, j.spec.params.get("C", 0.1 if "_" in j.spec.kind else 1.0))
            for j, d in zip(jobs, _in_parallel(rows.sparkSession, [lambda j=j: design(j) for j in jobs], 3))]
    if max(f.design.width for f in fits) > MAX_WIDTH + 1:
        return None
    keep = [*panel.keys, panel.label, *[c for c in extra if c not in jobs[0].literals]]
    out = None
    for at in range(0, len(fits), AT_ONCE):
        some = fits[at:at + AT_ONCE]
        betas = fit_shared(rows, some, space, panel.label, panel.keys, n)
        part = score_shared(rows, some, betas, space, keep, panel.score).withColumns({
            k: F.array(*[F.lit(j.literals[k]) for j in jobs[at:at + AT_ONCE]])[F.col("_job")] for k in jobs[0].literals}).drop("_job")
        out = part if out is None else out.unionByName(part)
    return out


def _cut_job(through: int, valid: int, spec: ModelSpec, panel: PanelSpec, **literals) -> Job:
    train, weight = training_condition(through, spec, panel)
    return Job(train, F.col(panel.period) == valid, {"model": spec.name, **literals}, spec, weight)


def rolling_oof(df: DataFrame, cuts: Sequence[tuple[int, int]], *specs: ModelSpec, panel: PanelSpec = DEFAULT) -> DataFrame:
    """Out-of-fold predictions over the cuts, one distributed fit per configuration and cut."""
    return _fit_score_all(df, [_cut_job(t, v, s, panel) for s in specs for t, v in cuts], specs, panel)


def fold_metrics(oof: DataFrame, by: Sequence[str] = ("model",), panel: PanelSpec = DEFAULT) -> DataFrame:
    """Monthly metrics of long out-of-fold predictions."""
    return metric_table(oof, [*by, panel.period], panel.score, panel.label, probability=True)


def _inner_fold(through: int, valid: int, panel: PanelSpec) -> tuple[Column, Column]:
    """Conditions of a fold's rows and of its validation rows."""
    ends = F.col(panel.period) == valid
    return (F.col(panel.period) <= through) | ends, ends


def _median_rounds(df: DataFrame, features: DataFrame | None, cuts: Sequence[tuple[int, int]], spec: ModelSpec, panel: PanelSpec,
                   at_once: int) -> int:
    def rounds(through: int, valid: int) -> int:
        chosen, ends = _inner_fold(through, valid, panel)
        rows = (df if features is None else features).where(chosen).withColumn("_valid", ends)
        if features is None:
            return fit(rows, spec, spec.seeds[0], validation="_valid", panel=panel).stages[-1].getNumTrees
        return boosted_trees(spec, panel.label, spec.seeds[0], validation="_valid").fit(rows).getNumTrees

    ordered = sorted(_in_parallel(df.sparkSession, [lambda t=t, v=v: rounds(t, v) for t, v in cuts], at_once))
    mid = len(ordered) // 2
    return ordered[mid] if len(ordered) % 2 else (ordered[mid - 1] + ordered[mid]) // 2


def select_iterations(df: DataFrame, cuts: Sequence[tuple[int, int]], spec: ModelSpec,
                      panel: PanelSpec = DEFAULT) -> int:
    """Median of the early-stopped rounds over the inner folds."""
    with _tree_rows(df, [_inner_fold(t, v, panel)[0] for t, v in cuts], spec, [panel.period, panel.label]) as (features, at_once):
        return _median_rounds(df, features, cuts, spec, panel, at_once)


def selected_rounds_oof(df: DataFrame, inner: Sequence[tuple[int, int]], cuts: Sequence[tuple[int, int]], spec: ModelSpec,
                        name: str, panel: PanelSpec = DEFAULT) -> tuple[DataFrame, int]:
    """Out-of-fold predictions over ``cuts`` at the length chosen by `select_iterations` over ``inner``, and that length.

    All fits share the kept rows, so the panel is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    jobs = [_cut_job(t, v, spec, panel) for t, v in cuts]
    used = [*[_inner_fold(t, v, panel)[0] for t, v in inner], *[c for j in jobs for c in (j.train, j.valid)]]
    with _tree_rows(df, used, spec, [*panel.keys, panel.label]) as (features, at_once):
        rounds = _median_rounds(df, features, inner, spec, panel, at_once)
        chosen = replace(spec, name=name, params={**spec.params, "maxIter": rounds})
        if features is not None:
            return _fit_score_trees(features, [_cut_job(t, v, chosen, panel) for t, v in cuts], panel, at_once), rounds
    return rolling_oof(df, cuts, chosen, panel=panel), rounds


def parameter_grid(options: dict[str, Sequence]) -> list[dict]:
    """Every combination of the options, in order."""
    return [dict(zip(options, values)) for values in product(*options.values())]


def grid_search(df: DataFrame, cuts: Sequence[tuple[int, int]], base: ModelSpec, grid: Sequence[dict],
                panel: PanelSpec = DEFAULT) -> DataFrame:
    """Mean inner-fold Gini and average precision per configuration, best first."""
    specs = [replace(base, name=f"config_{i}", params={**base.params, **params}) for i, params in enumerate(grid)]
    out = rolling_oof(df, cuts, *specs, panel=panel)
    return fold_metrics(out, ["model"], panel).groupBy("model").agg(
        F.avg("gini").alias("mean_gini"), F.avg("ap").alias("mean_ap")).orderBy(
        F.desc(F.round("mean_gini", 12)), F.desc(F.round("mean_ap", 12)), "model")


def naive_bayes(train: DataFrame, score_rows: DataFrame, columns: Sequence[str], by: str | None = None,
                alpha: float = 1.0, clip_unseen: bool = False, panel: PanelSpec = DEFAULT) -> DataFrame:
    """Categorical naive Bayes by counting, global or per band (M5).

    ``(N_vc + alpha) / (N_c + alpha n_v)`` per feature. The number of values n_v is
    taken over all training rows. An unseen value counts zero, or is treated as the
    first sorted value with ``clip_unseen``. A row of an unseen band gets the rate of all
    training rows, a band with one class the certainty of that class.
    """
    group = [F.col(by).alias("_g")] if by else [F.lit("all").alias("_g")]
    cats = [known_category(c).alias(c) for c in columns]
    y = F.col(panel.label)
    base = train.select(*group, y.alias("_y"), *cats)
    classes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_n1"))
    long = base.unpivot(["_g", "_y"], list(columns), "_c", "_v")
    values = stored(category_vocabulary(train, columns), "vocabulary")
    of = lambda c: F.col("column") == c
    known = values.agg(*[F.count(F.when(of(c), 1)).alias(f"_k_{c}") for c in columns],
                       *[F.max(F.when(of(c) & (F.col("code") == 0), F.col("value"))).alias(f"_first_{c}") for c in columns])
    counts = stored(long.groupBy("_g", "_c", "_v").agg(F.count(F.lit(1)).alias("_m"), F.sum("_y").alias("_m1")), "counts")
    everyone = classes.agg(F.sum("_n").alias("_all"), F.sum("_n1").alias("_all1"))
    rows = score_rows.select(*panel.keys, *group, *cats).crossJoin(F.broadcast(known.crossJoin(everyone)))      # one row
    rows = rows.join(classes, "_g", "left")
    seen = F.col("_n").isNotNull()
    n1 = F.coalesce("_n1", "_all1")
    n0 = F.coalesce(F.col("_n") - F.col("_n1"), F.col("_all") - F.col("_all1"))
    terms = []
    for c in columns:                                               # wide rows meet one small table a column
        value = F.col(c)
        if clip_unseen:
            words = values.where(of(c)).select(F.col("value").alias(f"_known_{c}"))
            rows = rows.join(words, F.col(c) == F.col(f"_known_{c}"), "left")
            value = F.coalesce(F.col(f"_known_{c}"), F.col(f"_first_{c}"))
        table = counts.where(F.col("_c") == c).select(
            F.col("_g").alias(f"_g_{c}"), F.col("_v").alias(f"_v_{c}"), F.col("_m").alias(f"_m_{c}"), F.col("_m1").alias(f"_m1_{c}"))
        rows = rows.join(table, F.col("_g").eqNullSafe(F.col(f"_g_{c}")) & (value == F.col(f"_v_{c}")), "left")
        m1 = F.coalesce(f"_m1_{c}", F.lit(0))
        m0 = F.coalesce(F.col(f"_m_{c}") - F.col(f"_m1_{c}"), F.lit(0))
        size = alpha * F.col(f"_k_{c}")
        terms.append(F.ln((m1 + alpha) / (n1 + size)) - F.ln((m0 + alpha) / (n0 + size)))
    total = rows.select(*panel.keys, F.when(seen, reduce(lambda x, y: x + y, terms)).otherwise(F.lit(0.0)).alias("_llr"),
                        n1.alias("_c1"), n0.alias("_c0"))
    z = F.col("_llr") + F.ln(F.col("_c1") / F.col("_c0"))
    p = (F.when(F.col("_c1") == 0, 0.0).when(F.col("_c0") == 0, 1.0)
         .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
    return total.select(*panel.keys, p.alias(panel.score))


def tree_leaves(df: DataFrame, numeric: Sequence[str], label: str, depth: int = 3,
                min_leaf: int = 1500) -> DataFrame:
    """Leaf sizes and rates of a shallow tree (M9)."""
    rows = df.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in numeric])
    tree = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth,
                                  minInstancesPerNode=min_leaf, leafCol="leaf", seed=0)
    assembled = VectorAssembler(inputCols=list(numeric), outputCol="features").transform(rows)
    scored = tree.fit(assembled).transform(assembled)
    return scored.groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("rate"))


def permutation_importance(model, df: DataFrame, spec: ModelSpec, columns: Sequence[str], seed: int,
                           panel: PanelSpec = DEFAULT) -> DataFrame:
    """Drop of the monthly Gini when a column is shuffled inside its month.

    One donor row of the same month is drawn for every row and serves all columns, so the
    rows are ordered twice in all, not twice a column.
    """
    keep = [*panel.keys, panel.label]
    donor = with_donor(df, list(columns), seed, panel).persist()
    try:
        runs = score(model, donor, spec, keep, panel.score).withColumn("feature", F.lit(""))
        for c in columns:
            swapped = donor.withColumn(c, F.col(f"_donor.{c}"))
            runs = runs.unionByName(score(model, swapped, spec, keep, panel.score).withColumn("feature", F.lit(c)))
        ensure_checkpoint_dir(df.sparkSession)
        table = auc_table(runs, ["feature", panel.period], panel.score, panel.label).checkpoint()
    finally:
        donor.unpersist()
    base = F.max(F.when(F.col("feature") == "", F.col("gini"))).over(Window.partitionBy(panel.period))
    drops = table.withColumn("drop", base - F.col("gini")).where(F.col("feature") != "")
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_samp("drop").alias("std_drop"))


def gain_importance(models: Sequence, spec: ModelSpec, spark) -> DataFrame:
    """Impurity importance summed over models and normalised (M16). One row per feature."""
    names = [*spec.numeric, *spec.categorical]
    total = [sum(float(m.stages[-1].featureImportances[i]) for m in models) for i in range(len(names))]
    whole = sum(total) or 1.0
    return spark.createDataFrame([(n, t / whole) for n, t in zip(names, total)], "feature string, importance double")


def learning_curve(df: DataFrame, cuts: Sequence[tuple[int, int]], spec: ModelSpec, fractions: Sequence[float],
                   seeds: Sequence[int], panel: PanelSpec = DEFAULT) -> DataFrame:
    """Gini of each validation month by share of training entities, one repetition a seed.

    The whole share has one repetition.
    """
    def job(through: int, valid: int, fraction: float, seed: int) -> Job:
        part = F.col(panel.period) <= through
        return Job(part & (hash_uniform(seed, panel.entity) < fraction), F.col(panel.period) == valid,
                   {"fraction": float(fraction), "seed": seed}, spec)

    jobs = [job(t, v, f, s) for t, v in cuts for f in fractions for s in (seeds if f < 1 else seeds[:1])]
    return auc_table(_fit_score_all(df, jobs, [spec], panel), ["fraction", "seed", panel.period], panel.score, panel.label,
                     probability=True)


def compare_windows(df: DataFrame, cuts: Sequence[tuple[int, int]], spec: ModelSpec, months: int = 3,
                    panel: PanelSpec = DEFAULT) -> DataFrame:
    """Monthly metrics with all history against the last months only."""
    arms = [replace(spec, name="expanding", window=None), replace(spec, name="sliding", window=months)]
    return fold_metrics(rolling_oof(df, cuts, *arms, panel=panel), ["model"], panel)


def cross_validate(df: DataFrame, arms: dict[str, tuple[str, ModelSpec]], folds: int, panel: PanelSpec = DEFAULT) -> DataFrame:
    """Gini per arm and fold: the leakage comparison of random folds.

    An arm is a fold column and a configuration: folds of entities, of rows, of rows with the entity as a feature.
    """
    def job(arm: str, column: str, spec: ModelSpec, k: int) -> Job:
        return Job(F.col(column) != k, F.col(column) == k, {"arm": arm, "fold": k}, spec)

    jobs = [job(arm, column, spec, k) for arm, (column, spec) in arms.items() for k in range(folds)]
    extra = dict.fromkeys(column for column, _ in arms.values())
    scored = _fit_score_all(df, jobs, [s for _, s in arms.values()], panel, list(extra))
    return auc_table(scored, ["arm", "fold"], panel.score, panel.label, probability=True)


def ablation(df: DataFrame, cuts: Sequence[tuple[int, int]], specs: Sequence[ModelSpec], frozen: bool = False,
             panel: PanelSpec = DEFAULT) -> DataFrame:
    """Mean, spread and pooled Gini of several configurations.

    With ``frozen`` every configuration also scores all validation months with the fit of the
    first cut; ``evaluation`` tells the two apart.
    """
    jobs = [_cut_job(t, v, s, panel, evaluation="rolling") for s in specs for t, v in cuts]
    if frozen:
        def job(s: ModelSpec) -> Job:
            months = [v for _, v in cuts]
            train, weight = training_condition(cuts[0][0], s, panel)
            return Job(train, F.col(panel.period).isin(months), {"model": s.name, "evaluation": "frozen"}, s, weight)
        jobs += [job(s) for s in specs]
    out = _fit_score_all(df, jobs, specs, panel)
    by = ["model", "evaluation"]
    monthly = monthly_summary(fold_metrics(out, by, panel), by)
    pooled = auc_table(out, by, panel.score, panel.label, probability=True).select(*by, F.col("gini").alias("pooled_gini"))
    return monthly.join(pooled, by)


def drift_ablation(df: DataFrame, cuts: Sequence[tuple[int, int]], column: str, original: str, base: ModelSpec, draws: int,
                   highest: int, seed: int, panel: PanelSpec = DEFAULT) -> DataFrame:
    """A drifting column raw, ranked inside the month, or dropped, on three kinds of validation rows.

    Each variant is fitted once a cut. It scores the month as it is (slice ``all``, and ``non_copy``
    where ``column`` differs from ``original``) and ``draws`` futures in which the column is
    redrawn between 1 and ``highest`` and ranked anew; their Ginis are averaged (``simulated``).
    """
    months = [v for _, v in cuts]
    real = df.withColumn("draw", F.lit(-1)).withColumn("copied", F.col(column) == F.col(original))
    future = df.where(F.col(panel.period).isin(months)).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("copied", F.lit(False))
    redrawn = F.lit(1) + F.pmod(hash_int(seed, "draw", *panel.keys), F.lit(highest))
    rows = real.unionByName(future.withColumn(column, redrawn.cast(df.schema[column].dataType)))
    rows = pct_rank(rows, ["draw", panel.period], column, f"{column}_rank")
    others = tuple(c for c in base.numeric if c != column)
    specs = [replace(base, name="RAW", numeric=others + (column,)), replace(base, name="RANK", numeric=others + (f"{column}_rank",)),
             replace(base, name="DROP", numeric=others)]

    def job(s: ModelSpec, through: int, valid: int) -> Job:
        train, weight = training_condition(through, s, panel)
        return Job((F.col("draw") < 0) & train, F.col(panel.period) == valid, {"model": s.name}, s, weight)

    scored = _fit_score_all(rows, [job(s, t, v) for s in specs for t, v in cuts], specs, panel, ["draw", "copied"])
    slices = F.when(F.col("draw") >= 0, F.array(F.lit("simulated"))).when(
        F.col("copied"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("non_copy")))
    table = auc_table(scored.withColumn("slice", F.explode(slices)), ["model", "slice", "draw", panel.period],
                      panel.score, panel.label, probability=True)
    return table.groupBy("model", "slice", panel.period).agg(
        F.avg("gini").alias("gini"), F.max("n_rows").alias("n_rows"), F.count("gini").alias("draws"))
