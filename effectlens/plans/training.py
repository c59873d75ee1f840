"""Train, predict and infer: the three entry points, from a table and a configuration to result tables.

Everything relational is a plan; fits and attributions are grouped tasks.  A run's folder holds the
contract between the three: the resolved configuration, roles, levels, classes, scales, folds and models.
"""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.functions.columns import stratum
from effectlens.operators import boosting as B
from effectlens.operators import effects as X
from effectlens.operators import encoding as E
from effectlens.operators import metrics as M
from effectlens.operators import resampling as R
from effectlens.operators import splines as S
from effectlens.operators.selection import FeatureSelector
from effectlens.plans import config as C
from effectlens.sources.files import load_json, read_table, save_config, save_json, write_csv, write_parquet
from effectlens.sources.scratch import stored

ROW, PROFILE = "row_id", "_profile"


@dataclass
class Contract:
    """What later runs must know of a training."""

    config: dict
    task: str
    outcomes: list[str]
    roles: dict[str, str]
    levels: dict[str, list] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    scales: dict[str, list[float]] = field(default_factory=dict)
    id_col: str | None = None

    @property
    def features(self) -> list[str]:
        return sorted(self.roles)

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.features if self.roles[c] == "nominal"]

    @property
    def targets(self) -> list[str]:
        if self.task == "multiclass_classification":
            return [f"_y{k}" for k in range(len(self.classes))]
        return [f"_y{k}" for k in range(len(self.outcomes))]

    def params(self, trial: dict | None = None) -> B.Params:
        model = self.config["modeling"]
        known = B.Params.__dataclass_fields__
        extra = {k: v for k, v in (trial or {}).items() if k in known}
        return B.Params(**{"loss": model["loss_function"], "seed": self.config["execution"]["random_seed"]} | extra)


def with_row_id(df: DataFrame, id_col: str | None) -> DataFrame:
    """df with an id of its rows, fixed by writing it down once."""
    if id_col:
        return df.withColumn(ROW, F.col(id_col).cast("string"))
    return stored(df.withColumn(ROW, F.monotonically_increasing_id().cast("string")), "rows")


def with_targets(df: DataFrame, c: Contract) -> DataFrame:
    """df with one number per output: scaled values, 0/1, or one column per class."""
    if c.task == "multiclass_classification":
        y = F.col(c.outcomes[0]).cast("string")
        return df.withColumns({t: F.when(y.isNotNull(), (y == k).cast("double")) for t, k in zip(c.targets, c.classes, strict=True)})
    if c.task == "binary_classification":
        y = F.col(c.outcomes[0]).cast("string")
        return df.withColumn("_y0", F.when(y.isNotNull(), (y == c.classes[-1]).cast("double")))
    scale = lambda o: c.scales.get(o, [0.0, 1.0])
    return df.withColumns({t: (F.col(o).cast("double") - scale(o)[0]) / scale(o)[1] for t, o in zip(c.targets, c.outcomes, strict=True)})


def as_written(raw: DataFrame, features: list[str]) -> DataFrame:
    """(row id, features) as text, as they stand in the data once blanks are missing."""
    return raw.select(ROW, *[F.col(f).cast("string").alias(f) for f in features])


def prepare(spark: SparkSession, path: str, config: dict) -> tuple[DataFrame, Contract, DataFrame, DataFrame]:
    """Read, clean, select, resolve and encode: (rows, contract, missingness, the features as written)."""
    model = config["modeling"]
    outcomes = model["outcome"] if isinstance(model["outcome"], list) else [model["outcome"]]
    id_col = (config.get("data") or {}).get("id") or model.get("id")
    read = read_table(spark, path)
    id_col = id_col or ("id" if "id" in read.columns and "id" not in outcomes else None)
    raw = E.drop_missing_outcome(E.clean_strings(read), outcomes)
    raw = with_row_id(raw, id_col)
    if not (n := raw.count()):
        raise ValueError("no row has all outcomes")
    selector = FeatureSelector(config["features"]).fit([c for c in raw.columns if c != ROW], outcomes, [id_col] if id_col else [])
    resolved, _ = C.resolve(config, n)
    missing = stored(E.missingness(raw, [*selector.roles, outcomes[0]]), "missingness")
    for r in missing.filter("missing_rate > 0.1").collect():
        warnings.warn(f"{r.feature}: {r.missing_rate:.0%} missing")
    roles = {f: r for f, r in selector.roles.items() if f not in E.all_missing(raw, list(selector.roles))}
    task = resolved["modeling"]["task_type"]
    for f, r in roles.items():
        if r == "ordinal":
            E.check_levels(raw, f, selector.levels[f], all(isinstance(x, int | float) for x in selector.levels[f]))
    c = Contract(resolved, task, outcomes, roles, {f: selector.levels[f] for f in roles if roles[f] == "ordinal"}, id_col=id_col)
    folds = resolved["modeling"]["cv_folds"]
    if task in C.CLASSIFICATION:
        counts = E.class_counts(raw, outcomes[0], folds).orderBy(outcomes[0]).collect()
        if small := [str(r[0]) for r in counts if not r.enough]:
            raise ValueError(f"fewer rows than folds in class {', '.join(small)}")
        c.classes = [str(r[0]) for r in counts]
    if task == "multi_regression":
        c.scales = {r.target: [r["mean"], r.scale] for r in E.zscore(raw, outcomes).collect()}
    rows = with_targets(E.encode(raw, roles, c.levels, keep=[ROW, *outcomes]), c)
    rows = R.folds_for(rows, ROW, outcomes[0], folds, resolved["execution"]["random_seed"], task in C.CLASSIFICATION) if task in C.CLASSIFICATION else R.kfold(rows, ROW, folds, resolved["execution"]["random_seed"])
    return stored(rows, "encoded"), c, missing, as_written(raw, c.features)


def tune(rows: DataFrame, c: Contract) -> dict[int, dict]:
    """Of each outer fold the best of the trials, by the mean over inner folds of the score that the configuration names.

    All outer folds are searched side by side: a round's fits, of every outer fold, trial and inner fold, are one job.
    """
    if c.config["modeling"]["tuning"]["scoring"] not in M.NAMES:
        raise ValueError(f"unknown score {c.config['modeling']['tuning']['scoring']!r}; known: {', '.join(sorted(M.NAMES))}")
    tuning, seed = c.config["modeling"]["tuning"], c.config["execution"]["random_seed"]
    outer = range(c.config["modeling"]["cv_folds"])
    both = rows
    for k in outer:
        inside = rows.filter(F.col("fold") != k).select(ROW, c.outcomes[0])
        inner = R.folds_for(inside, ROW, c.outcomes[0], tuning["inner_cv_folds"], seed + k + 1, c.task in C.CLASSIFICATION)
        both = both.join(inner.select(ROW, F.col("fold").alias(f"_inner{k}")), ROW, "left")
    params = c.params({"early_stopping_rounds": tuning["early_stopping_rounds"]})
    fitted = B.trial_judge(stored(both, "inner"), {k: f"_inner{k}" for k in outer}, c.features, c.categorical, c.targets, params, tuning["scoring"])
    iterations: dict[int, list[float]] = {k: [] for k in outer}

    def judge(trials: dict[int, list[dict]]) -> dict[int, list[float]]:
        found = fitted(trials)
        for k, listed in found.items():
            iterations[k] += [n for _, n in listed]
        return {k: [score for score, _ in listed] for k, listed in found.items()}

    best = C.search(tuning["search_space"], tuning["n_iter"], {k: seed + k + 1 for k in outer}, judge)
    return {k: top | {"iterations": int(iterations[k][place]) + 1} for k, (top, place) in best.items()}


def fit_all(rows: DataFrame, c: Contract, trials: dict[int, dict], features: list[str], categorical: list[str], stretch: int = 1, stop: int = 0) -> DataFrame:
    """(fold, model): of each outer fold with its own parameters."""
    listed = [t | {"iterations": t["iterations"] * stretch} for _, t in sorted(trials.items())]
    return B.fit_folds(rows, "fold", features, categorical, c.targets, c.params({"early_stopping_rounds": stop}), listed, own_trial=True).select("fold", "model")


def with_shadows(rows: DataFrame, c: Contract, salt: int = 0) -> DataFrame:
    """rows with each feature's values permuted within every fold beside it."""
    return R.with_shadow_by_fold(rows, ROW, c.features, "fold", c.config["execution"]["random_seed"] + salt)


def train(spark: SparkSession, path: str, config: dict, out: str) -> Contract:
    rows, c, missing, written = prepare(spark, path, config)
    write_csv(missing.orderBy(F.desc("missing_rate"), "feature"), f"{out}/missingness_report")
    write_parquet(rows, f"{out}/train_matrix")
    write_parquet(written, f"{out}/raw_matrix")
    trials = tune(rows, c)
    models = stored(fit_all(rows, c, trials, c.features, c.categorical), "models")
    write_parquet(models, f"{out}/models")
    doubled = stored(with_shadows(rows, c), "shadowed")  # fits measure it before they read it
    names = [*c.features, *[f"shadow_{f}" for f in c.features]]
    stop = c.config["modeling"]["tuning"]["early_stopping_rounds"]
    write_parquet(fit_all(doubled, c, trials, names, [*c.categorical, *[f"shadow_{f}" for f in c.categorical]], stretch=2, stop=stop), f"{out}/shadow_models")
    oof = B.predict_folds(rows, models, "fold", ROW, c.categorical)
    write_csv(prediction_frame(rows, oof, c), f"{out}/full_oof_predictions")
    write_csv(fold_metrics(rows, stored(oof, "oof"), c), f"{out}/metrics_oof")
    save_json(spark, asdict(c), f"{out}/contract.json")
    save_config(spark, c.config, f"{out}/config_resolved.yaml")
    return c


def unscaled(pred, c: Contract, k: int):
    mean, scale = c.scales.get(c.outcomes[k] if k < len(c.outcomes) else "", [0.0, 1.0])
    return F.get(pred, k) * scale + mean


def prediction_frame(rows: DataFrame, preds: DataFrame, c: Contract) -> DataFrame:
    """Outcomes and predictions as shown: values, the class's probability, or one column per class or target."""
    both = rows.select(ROW, *c.outcomes).join(preds.select(ROW, "pred"), ROW)
    p = F.col("pred")
    if c.task == "multiclass_classification":
        return both.select(F.col(ROW).alias("id"), F.col(c.outcomes[0]).alias("y_true"), *[F.get(p, k).alias(f"prob_{name}") for k, name in enumerate(c.classes)])
    if c.task == "multi_regression":
        return both.select(F.col(ROW).alias("id"), *[x for k, o in enumerate(c.outcomes) for x in (F.col(o).alias(f"y_true_{o}"), unscaled(p, c, k).alias(f"y_pred_{o}"))])
    return both.select(F.col(ROW).alias("id"), F.col(c.outcomes[0]).alias("y_true"), unscaled(p, c, 0).alias("y_pred"))


def pairs(rows: DataFrame, preds: DataFrame, c: Contract) -> dict[str, DataFrame]:
    """(row, y, p) for each target; of classes p is the predicted label or probability."""
    both = rows.select(ROW, *c.outcomes, *c.targets).join(preds.select(ROW, "pred"), ROW)
    if c.task == "multiclass_classification":
        return {c.outcomes[0]: both.select(ROW, F.array_position(F.array(*c.targets), F.lit(1.0)).cast("int").alias("y"), (M.argmax("pred") + 1).alias("p"), "pred")}
    if c.task == "binary_classification":
        return {c.outcomes[0]: both.select(ROW, F.col("_y0").cast("int").alias("y"), F.get("pred", 0).alias("p"))}
    return {o: both.select(ROW, F.col(o).cast("double").alias("y"), unscaled(F.col("pred"), c, k).alias("p")) for k, o in enumerate(c.outcomes)}


def fold_metrics(rows: DataFrame, preds: DataFrame, c: Contract) -> DataFrame:
    """(fold, metric, score): every reported metric, as shown, of each model's predictions (fold), then its mean and std over them."""
    out = None
    for target, df in pairs(rows, preds, c).items():
        both = df.join(preds.select(F.col(ROW).alias("_row"), "fold"), F.col(ROW) == F.col("_row")).drop("_row") if "fold" not in df.columns else df
        for label, metric, judged in metrics_for(both, c):
            name, score, _, _ = M.displayed(label, "value", "value", "value")
            one = metric(judged, ["fold"]).toDF("fold", "value").select("fold", F.lit(f"{name}_{target}" if len(c.outcomes) > 1 else name).alias("metric"), score.alias("score"))
            out = one if out is None else out.unionByName(one)
    if c.task == "multi_regression":
        mean = out.filter(F.col("metric").isin([f"RMSE_{o}" for o in c.outcomes])).groupBy("fold").agg(F.avg("score").alias("score"))
        out = out.unionByName(mean.select("fold", F.lit("RMSE_mean").alias("metric"), "score"))
    return M.with_mean_and_std(out, "fold", "metric", "score")


def performance(rows: DataFrame, preds: DataFrame, c: Contract, n_perm: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target, metric, score, ci_low, ci_high), (target, metric, observed, null_mean, null_std, p_value), and the nulls (target, metric, b, null) as shown."""
    boot, seed = c.config["shap"]["bootstrapping"], c.config["execution"]["random_seed"]
    parts: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    for target, df in pairs(rows, preds, c).items():
        df = stored(df, "pairs")
        for label, metric, judged in metrics_for(df, c):
            name, score, low, high = M.displayed(label)
            s = R.bootstrap_ci_of_table(judged, ROW, metric, boot["n_boot"], seed, boot["alpha"])
            null = stored(R.permutation_null(judged, ROW, metric, n_perm, seed), "nulls")
            t = R.held_against(metric(judged).toDF("observed"), null, name)
            if label.startswith("neg_"):
                t, null = t.withColumns({x: -F.col(x) for x in ("observed", "null_mean")}), null.withColumn("null", -F.col("null"))
            named = [F.lit(target).alias("target"), F.lit(name).alias("metric")]
            parts.append((s.select(*named, score.alias("score"), low.alias("ci_low"), high.alias("ci_high")), t.withColumn("target", F.lit(target)), null.select(*named, "b", "null")))
    scores, tests, nulls = parts[0]
    for s, t, n in parts[1:]:
        scores, tests, nulls = scores.unionByName(s), tests.unionByName(t), nulls.unionByName(n)
    return scores, tests, nulls


def metrics_for(df: DataFrame, c: Contract) -> list[tuple[str, object, DataFrame]]:
    """(name, metric of a table, the table that it judges) of each reported metric."""
    if c.task == "multiclass_classification":
        ranked = df.withColumn("y", F.col("y") - 1).drop("p")
        ovr = lambda t, by=(), times=None: M.auc_ovr(t, probs="pred", classes=len(c.classes), by=by, times=times)
        plain = lambda f: lambda t, by=(), times=None: f(t, by=by, times=times)
        return [("balanced_accuracy", plain(M.balanced_accuracy), df.drop("pred")), ("f1_weighted", plain(M.f1_weighted), df.drop("pred")), ("roc_auc_ovr", ovr, ranked)]
    if c.task == "binary_classification":
        labels = df.withColumn("p", (F.col("p") > 0.5).cast("int"))
        area = lambda t, by=(), times=None: M.auc(t, by=by, times=times)
        return [("roc_auc", area, df), ("accuracy", R.by_aggregate(M.scorer("accuracy")), labels)]
    return [(n, R.by_aggregate(M.scorer(n)), df) for n in ("neg_rmse", "neg_mae", "r2")]


def profiled(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """((row id, profile) of rows, (profile, fold, *names)): a fold's rows that are alike in all features share a profile, and with it all effects."""
    own = stored(rows.select(ROW, "fold", *names), "shadowed")
    profiles = stored(own.select("fold", *names).distinct().withColumn(PROFILE, F.monotonically_increasing_id()), "profiles")
    same, met = F.lit(True), profiles.withColumnsRenamed({x: f"_of_{x}" for x in ("fold", *names)})
    for x in ("fold", *names):
        same = same & F.col(x).eqNullSafe(F.col(f"_of_{x}"))
    return stored(own.join(met, same).select(ROW, PROFILE), "profiles-of-rows"), profiles


def drawn_profiles(of_rows: DataFrame, n_boot: int, seed: int, unit: Column | None = None) -> DataFrame:
    """(b, profile, times): how many of the rows that a resample draws have each profile.

    unit, of a row's name, tells what is drawn: rows of one unit come along together.  Draws are dealt out once, by place.
    """
    rows = of_rows.select(F.col(ROW).alias("row"), PROFILE)
    units = rows.withColumnRenamed("row", "unit") if unit is None else rows.groupBy(unit.alias("unit")).agg(F.collect_list(PROFILE).alias(PROFILE))
    part = R.hash_range(F.col("_h"), of_rows.count())
    placed = stored(R.dense_index(units.withColumn("_h", F.md5("unit")), [F.col("_h"), F.col("unit")], "k", part=part).select("k", PROFILE), "places")
    drawn = R.with_drawn(R.bootstrap_indices(of_rows.sparkSession, placed.count(), n_boot, seed), placed)
    return drawn.select("b", PROFILE if unit is None else F.explode(PROFILE).alias(PROFILE)).groupBy("b", PROFILE).agg(F.count("*").alias("times"))


def resampled_effects(effects: DataFrame, values: DataFrame, drawn: DataFrame, roles: dict[str, str], n_knots: int, degree: int, threshold: int) -> DataFrame:
    """(b, slice, eff, stratum, m, v, gii) of effects (row, slice, eff, i, j, phi), values (row, feature, x) and draws (b, row, times), a row standing for all of its profile.

    Rows, not effects, are drawn: all effects of a resample, real or shadow, see the same rows.
    Effects of discrete features take the two-step aggregation; the others, if any, go to the spline kernel,
    a (resample, effect) to a task.  Rows where an effect is absent count as 0.
    """
    spark = effects.sparkSession
    kinds = spark.createDataFrame(sorted(roles.items()), "feature string, role string")
    nature = values.groupBy("feature").agg(F.count_distinct("x").alias("n")).join(kinds, "feature").select("feature", (F.col("role") == "nominal").alias("nominal"), "role", (X.nature(F.col("n"), F.col("role"), threshold) == "discrete").alias("discrete"))
    side = lambda k: nature.select(F.col("feature").alias(k), F.col("nominal").alias(f"nominal_{k}"), F.col("role").alias(f"role_{k}"), F.col("discrete").alias(f"discrete_{k}"))
    listed = effects.select("slice", "eff", "i", "j").distinct().join(side("i"), "i").join(side("j"), "j", "left")
    listed = listed.withColumn("stratum", stratum(F.col("role_i"), F.when(F.col("j").isNotNull(), F.coalesce("role_j", F.lit("continuous")))))
    listed = stored(listed.withColumn("plain", F.col("discrete_i") & F.coalesce("discrete_j", F.lit(True))), "effects")
    grid = listed.join(values.select("row", F.col("feature").alias("i"), F.col("x").alias("x1")), "i")
    grid = grid.join(values.select("row", F.col("feature").alias("j"), F.col("x").alias("x2")), ["row", "j"], "left")
    full = grid.join(effects.select("row", "slice", "eff", "phi"), ["row", "slice", "eff"], "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    full = stored(full.select("row", "slice", "eff", "stratum", "plain", "x1", "x2", F.col("nominal_i").alias("nominal1"), F.coalesce("nominal_j", F.lit(False)).alias("nominal2"), F.col("j").isNotNull().alias("paired"), "phi"), "effect-rows")
    by = ["b", "slice", "eff", "stratum"]
    sampled = drawn.join(full, "row")
    plain = sampled.filter("plain AND (NOT paired OR (x1 IS NOT NULL AND x2 IS NOT NULL))")
    smooth = sampled.filter("NOT plain").select(*by, "x1", "x2", "nominal1", "nominal2", "paired", "phi", "times")
    found = X.variability(plain, by, ["x1", "x2"], times="times")
    return found.unionByName(S.variability_by(smooth, by, n_knots, degree, threshold)) if listed.filter("NOT plain").take(1) else found


def numeric_values(rows: DataFrame, c: Contract, names: list[str]) -> DataFrame:
    """(row, feature, x): every feature as a number, nominal levels as codes; null where missing."""
    out = None
    for f in names:
        if c.roles[f.removeprefix("shadow_")] == "nominal":
            one = rows.join(E.level_codes(rows, f), f).select(F.col(ROW).alias("row"), F.lit(f).alias("feature"), F.col("code").cast("double").alias("x"))
        else:
            one = rows.select(F.col(ROW).alias("row"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


def shown_values(rows: DataFrame, written: DataFrame, c: Contract) -> DataFrame:
    """(row, feature, value, code, raw, type): each value as the model saw it (a nominal level by its name), as a number, as it stands in the data, and its feature's type."""
    text = written.unpivot(ROW, c.features, "feature", "raw").withColumnRenamed(ROW, "row")
    nominal = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("label")) for f in c.features])).alias("e")
    seen = rows.select(F.col(ROW).alias("row"), nominal).select("row", "e.*")
    kind = F.create_map(*[F.lit(x) for f in c.features for x in (f, c.roles[f])])[F.col("feature")]
    codes = numeric_values(rows, c, c.features).withColumnRenamed("x", "code")
    return seen.join(codes, ["row", "feature"], "left").join(text, ["row", "feature"], "left").select("row", "feature", F.col("label").alias("value"), "code", "raw", kind.alias("type"))


def every_fold(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows once for each model, their names marked with its fold."""
    folds = models.select("fold").distinct()
    return rows.drop("fold").crossJoin(F.broadcast(folds)).withColumn(ROW, F.concat_ws("|", ROW, F.col("fold").cast("string")))


def without_fold(row: str = "row") -> Column:
    return F.regexp_replace(row, r"\|\d+$", "")


def importance(rows: DataFrame, models: DataFrame, c: Contract, unit: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stats, real effects, their resamples) from models of features and shadows; every fold's shadows are drawn anew.

    Attributions follow from a row's profile, so they are made, and met with the draws, once a profile.
    """
    names = [*c.features, *[f"shadow_{f}" for f in c.features]]
    of_rows, profiles = profiled(with_shadows(rows.select(ROW, "fold", *c.features), c, salt=1000), names)
    found = B.effects_by_fold(profiles, models, "fold", PROFILE, [f for f in names if c.roles[f.removeprefix("shadow_")] == "nominal"])
    is_shadow = F.col("i").startswith("shadow_") & F.coalesce(F.col("j").startswith("shadow_"), F.lit(True))
    is_real = ~F.col("i").startswith("shadow_") & ~F.coalesce(F.col("j").startswith("shadow_"), F.lit(False))
    boot, spline, seed = c.config["shap"]["bootstrapping"], c.config["shap"]["splines"], c.config["execution"]["random_seed"]
    roles = {f: c.roles[f.removeprefix("shadow_")] for f in names}
    values = stored(numeric_values(profiles.withColumnRenamed(PROFILE, ROW), c, names), "values")
    drawn = stored(drawn_profiles(of_rows, boot["n_boot"], seed, unit).withColumnRenamed(PROFILE, "row"), "drawn")
    all_boots = stored(resampled_effects(found.filter(is_real | is_shadow), values, drawn, roles, spline["n_knots"], spline["degree"], spline["discrete_threshold"]), "boots")
    shadow_eff = F.col("eff").startswith("shadow_")
    out = None
    for s in [r[0] for r in all_boots.select("slice").distinct().orderBy("slice").collect()]:
        part = all_boots.filter(F.col("slice") == s).drop("slice")
        one = X.statistics(part.filter(~shadow_eff), part.filter(shadow_eff), boot["n_boot"], boot["alpha"], boot["stab_thresh"], boot["fdr_correct"]).withColumn("slice", F.lit(s))
        out = one if out is None else out.unionByName(one)
    real = found.filter(is_real).withColumnRenamed("row", PROFILE).join(of_rows.withColumnRenamed(ROW, "row"), PROFILE)
    return out, real.select(*found.columns), all_boots.filter(~shadow_eff)


def slice_names(c: Contract) -> list[str | None]:
    """Of each slice of the effects the class or target that it is of; a single output has no name."""
    names = c.classes if c.task == "multiclass_classification" else c.outcomes
    return [*names] if len(names) > 1 and c.task != "binary_classification" else [None]


def named_slices(df: DataFrame, c: Contract) -> DataFrame:
    """df with slice_name, the class or target of its slice."""
    names = slice_names(c)
    return df.withColumn("slice_name", F.get(F.array(*[F.lit(n).cast("string") for n in names]), F.col("slice").cast("int")))


def save_importance(stats: DataFrame, boots: DataFrame, c: Contract, out: str) -> DataFrame:
    """Write the final table and the resamples of what is kept; returns (slice, eff) of the effects whose microdata are kept.

    Every class or target has its own choice.  Magnitude and index go by the index's significance, variability by its own.
    """
    stats = stored(stats, "stats")
    for r in stats.filter("v_failure_rate > 0.05").select("slice", "eff", "v_failure_rate").collect():  # one row an effect
        warnings.warn(f"{r.eff}: no variability in {r.v_failure_rate:.0%} of the resamples")
    write_csv(named_slices(stats, c).orderBy("slice", *X.final_order()), f"{out}/shap_stats_global")
    shap = c.config["shap"]
    slices = range(len(slice_names(c)))

    def chosen(n: int, sig: str) -> DataFrame:
        each = [X.save_set(stats.filter(F.col("slice") == s), n, f"{sig}_sig", f"{sig}_q").select("slice", "eff") for s in slices]
        return reduce(DataFrame.unionByName, each)

    for statistic, sig in (("m", "gii"), ("v", "v"), ("gii", "gii")):
        kept = boots.join(chosen(shap["bootstrapping"]["output_boots_n"], sig), ["slice", "eff"])
        write_parquet(named_slices(kept.select("slice", "eff", "b", F.col(statistic).alias("value")), c), f"{out}/bootstraps_{statistic}")
    return chosen(shap["output_microdata_n"], "gii")


def load(spark: SparkSession, run: str) -> tuple[Contract, DataFrame, DataFrame]:
    return Contract(**load_json(spark, f"{run}/contract.json")), spark.read.parquet(f"{run}/models"), spark.read.parquet(f"{run}/shadow_models")


def predict(spark: SparkSession, run: str) -> None:
    """Out-of-fold performance and importance of a trained run, on the rows it was trained on."""
    c, models, shadow_models = load(spark, run)
    rows = spark.read.parquet(f"{run}/train_matrix")
    if rows.agg(F.count_distinct("fold")).first()[0] != models.count():
        raise ValueError("folds and models differ in number")
    preds = stored(B.predict_folds(rows, models, "fold", ROW, c.categorical), "predictions")
    if missing := rows.join(preds, ROW, "left_anti").count():
        raise ValueError(f"{missing} rows have no out-of-fold prediction")
    if again := preds.count() - rows.count():
        warnings.warn(f"{again} out-of-fold predictions more than rows")
    write_csv(prediction_frame(rows, preds, c), f"{run}/predictions_oof")
    save_performance(rows, preds, c, max(c.config["shap"]["bootstrapping"]["n_boot"], 1000), run)
    stats, real, boots = importance(rows, shadow_models, c)
    keep = save_importance(stats, boots, c, run)
    values = shown_values(rows, spark.read.parquet(f"{run}/raw_matrix"), c)
    write_parquet(named_slices(X.microdata(real.join(keep, ["slice", "eff"]), values), c), f"{run}/microdata")


def save_performance(rows: DataFrame, preds: DataFrame, c: Contract, n_perm: int, out: str) -> None:
    scores, tests, nulls = performance(rows, preds, c, n_perm)
    write_csv(scores, f"{out}/performance")
    write_csv(tests, f"{out}/permutation_test")
    write_parquet(nulls, f"{out}/permutation_null_distributions")


def infer(spark: SparkSession, run: str, path: str, out: str) -> None:
    """Ensemble predictions for new rows; scores where their outcomes are known."""
    c, models, shadow_models = load(spark, run)
    raw = E.clean_strings(read_table(spark, path))
    if missing := [f for f in c.features if f not in raw.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    known = [o for o in c.outcomes if o in raw.columns]
    raw = with_row_id(raw.withColumns({o: F.lit(None).cast("double") for o in c.outcomes if o not in known}), c.id_col if c.id_col in raw.columns else None)
    for r in E.missingness(raw, c.features).filter("missing_rate > 0.5").collect():
        warnings.warn(f"{r.feature}: {r.missing_rate:.0%} missing in the new data")
    rows = stored(E.supervised(with_targets(E.encode(raw, c.roles, c.levels, keep=[ROW, *c.outcomes]), c), c.outcomes), "new-rows")
    each = stored(B.predict_folds(rows, models, "fold", ROW, c.categorical, every=True), "each-model")
    size = len(c.targets)
    mean = each.groupBy(ROW).agg(F.array(*[F.avg(F.get("pred", k)) for k in range(size)]).alias("pred"))
    write_csv(prediction_frame(rows, mean, c), f"{out}/predictions")
    judged = rows.filter("supervised")
    if judged.take(1):
        save_performance(judged, mean, c, c.config["shap"]["bootstrapping"]["n_boot"], out)
        write_csv(fold_metrics(judged, each, c), f"{out}/performance_per_model")
    expanded = stored(every_fold(rows, shadow_models), "rows-by-model")
    R.require_equal_clusters(expanded.select(without_fold(ROW).alias("unit")), "unit")
    stats, real, boots = importance(expanded, shadow_models, c, without_fold())
    keep = save_importance(stats, boots, c, out)
    folds = models.count()
    each_slice = [X.fold_average(real.filter(F.col("slice") == s).withColumn("row", without_fold()), folds, zero_filled=True).withColumn("slice", F.lit(s)) for s in range(len(slice_names(c)))]
    averaged = stored(reduce(DataFrame.unionByName, each_slice), "averaged")
    write_parquet(named_slices(averaged, c), f"{out}/effects")
    sides = real.select("eff", "i", "j").distinct()
    values = shown_values(rows, as_written(raw, c.features), c)
    write_parquet(named_slices(X.microdata(averaged.join(keep, ["slice", "eff"]).join(sides, "eff"), values), c), f"{out}/microdata")
    save_json(spark, {"run": run, "data": path, "supervised": bool(known)}, f"{out}/inference_metadata.json")
