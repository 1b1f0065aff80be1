"""Feature alignment, preparation, training, scoring and evaluation with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import (CountVectorizerModel, IndexToString, SQLTransformer, StringIndexer, StringIndexerModel,
                                VarianceThresholdSelector, VectorAssembler, VectorSizeHint)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefp.operators.quantiles import grouped_quantiles
from tracefp.schema import TRIAL_KEY
from tracefp.session import materialize

TABLES = ["temporal", "http", "tls", "behavioural", "combined"]
CATEGORICAL = ["sf_site_mode", "ua_family_mode", "ua_os_mode"]
ABSENT_IS_ZERO = ["priority_correct_rate", "priority_urgency_mode"]
NAME_LIST = "nonstandard_names"
NAME_PREFIX = "ns_hdr"
MAX_NAMES = 1 << 18
FIT_ROWS = 25_000


# ---- alignment and preparation ---------------------------------------------


def align_feature_sets(temporal: DataFrame, http: DataFrame, tls: DataFrame,
                       behavioural: DataFrame, keys=TRIAL_KEY) -> dict[str, DataFrame]:
    """Tables over the trials all request sets share; the last two also need behaviour.

    Names already taken in the combined table get the suffix of their set.
    """
    keys = list(keys)
    base = (temporal.select(*keys).join(http.select(*keys), keys, "left_semi")
            .join(tls.select(*keys), keys, "left_semi"))

    def aligned(df: DataFrame, to: DataFrame) -> DataFrame:
        return df.join(to, keys, "left_semi")

    combined, taken = temporal, set(temporal.columns)
    for suffix, part in (("http", http), ("tls", tls), ("beh", behavioural)):
        named = part.select(*[F.col(c).alias(f"{c}_{suffix}" if c in taken and c not in keys else c)
                              for c in part.columns])
        combined = combined.join(named, keys)
        taken |= set(named.columns)
    return {"temporal": aligned(temporal, base), "http": aligned(http, base), "tls": aligned(tls, base),
            "behavioural": aligned(behavioural, base), "combined": combined}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = TRIAL_KEY) -> list[str]:
    return [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint")
            and c not in exclude]


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of exact medians; all columns share one pass in long form."""
    rows = grouped_quantiles(_long(df, columns), ["feature"], "value", {"median": 0.5})
    return rows.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])


def impute_median(df: DataFrame, columns: Sequence[str] | None = None,
                  medians: DataFrame | None = None) -> DataFrame:
    """Missing numbers replaced by the column median (of `medians` when given)."""
    columns = list(columns or numeric_columns(df))
    medians = medians if medians is not None else column_medians(df, columns)
    row = medians.select(F.struct(*columns).alias("m"))
    out = df.withColumn("_m", row.scalar())
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")).alias(c) if c in columns
                        else F.col(c) for c in df.columns])


def name_vocabulary(df: DataFrame, column: str = NAME_LIST, limit: int = MAX_NAMES) -> list[str]:
    """Distinct names of a pipe-joined or array column, sorted.

    They become table columns, so a vocabulary beyond the limit is an error,
    never silently cut.
    """
    parts = F.col(column) if dict(df.dtypes)[column].startswith("array") else F.split(column, r"\|")
    names = df.select(F.explode(parts).alias("name")).where(F.col("name") != "").distinct().limit(limit + 1).orderBy("name")
    out = [r["name"] for r in names.collect()]
    if len(out) > limit:
        raise ValueError(f"{column} holds more than {limit} names; give a vocabulary")
    return out


def multi_hot(df: DataFrame, column: str = NAME_LIST, prefix: str = NAME_PREFIX,
              vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Pipe-joined names to one 0/1 column per name."""
    vocabulary = name_vocabulary(df, column) if vocabulary is None else vocabulary
    parts = F.split(F.coalesce(column, F.lit("")), r"\|")
    return df.select(*[c for c in df.columns if c != column],
                     *[F.array_contains(parts, v).cast("int").alias(f"{prefix}_{v}") for v in vocabulary])


def encode_categories(df: DataFrame, columns: Sequence[str] = tuple(CATEGORICAL)) -> DataFrame:
    """Codes in alphabetical order of the labels; a missing value is "unknown"."""
    filled = df.select(*[F.coalesce(c, F.lit("unknown")).alias(c) if c in columns else F.col(c)
                         for c in df.columns])
    model = StringIndexer(inputCols=list(columns), outputCols=[f"_{c}" for c in columns],
                          stringOrderType="alphabetAsc", handleInvalid="keep").fit(filled)
    out = model.transform(filled)
    return out.select(*[F.col(f"_{c}").cast("int").alias(c) if c in columns else F.col(c)
                        for c in df.columns])


def structural_zero(df: DataFrame, columns: Sequence[str] = tuple(ABSENT_IS_ZERO)) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in columns
                       else F.col(c) for c in df.columns])


def varying_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose values differ: one aggregation, one row to the driver."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or row[c] != 0.0]


def drop_zero_variance(df: DataFrame) -> DataFrame:
    numeric = numeric_columns(df)
    kept = set(varying_columns(df, numeric))
    return df.select(*[c for c in df.columns if c not in numeric or c in kept])


def fold_of(df: DataFrame, trial: str = "trial") -> DataFrame:
    """The trial number as fold; both separators name the same fold."""
    return df.withColumn("fold", F.regexp_replace(F.regexp_replace(trial, "trial-", ""), "trial_", ""))


# ---- pipelines ---------------------------------------------------------------


def prepare(df: DataFrame) -> DataFrame:
    """Row-wise steps that need no fitting: unknown categories, absent priorities, name arrays."""
    cols = []
    for c in df.columns:
        if c in CATEGORICAL:
            cols.append(F.coalesce(c, F.lit("unknown")).alias(c))
        elif c in ABSENT_IS_ZERO:
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        elif c == NAME_LIST:
            cols.append(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda v: v != "").alias(c))
        elif c == "ua_version_mode":
            cols.append(F.col(c).try_cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


NOT_FEATURES = ("agent", "trial", "fold", "n_req", "label")


def feature_stages(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list:
    """Encoders, imputation by exact medians, assembly and removal of constant features.

    They are stages of the model, so a fold's encoders and medians are fitted
    on its training rows only, and live rows get the training-time codes.
    """
    types = dict(df.dtypes)
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float") and c not in exclude]
    category = [c for c in CATEGORICAL if types.get(c) == "string"]
    vectors = [c for c, t in df.dtypes if t == "vector"]
    stages: list = []
    for v in vectors:
        size = df.select(F.size(vector_to_array(v))).first()[0]
        stages.append(VectorSizeHint(inputCol=v, size=size, handleInvalid="error"))
    parts = list(vectors)
    if category:
        stages.append(StringIndexer(inputCols=category, outputCols=[f"{c}_code" for c in category],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        parts += [f"{c}_code" for c in category]
    if types.get(NAME_LIST) == "array<string>" and (names := name_vocabulary(df)):
        stages.append(CountVectorizerModel.from_vocabulary(names, inputCol=NAME_LIST, outputCol="_names", binary=True))
        parts.append("_names")
    if numeric:
        stages.append(median_stage(df, numeric))
        parts += [f"{c}_full" for c in numeric]
    stages.append(VectorAssembler(inputCols=parts, outputCol="_raw", handleInvalid="keep"))
    stages.append(VarianceThresholdSelector(featuresCol="_raw", outputCol="features", varianceThreshold=0.0))
    return stages


def median_stage(df: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """<column>_full for each column: missing numbers become the exact median of df's rows,
    which is kept in the stage, so live rows get the training rows' medians."""
    known = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    return filled_stage(column_medians(known, columns).first().asDict())


def filled_stage(row: Mapping[str, float]) -> SQLTransformer:
    columns = list(row)
    full = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), CAST('{row[c]!r}' AS DOUBLE)) AS `{c}_full`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {full} FROM __THIS__")


def forest(trees: int = 200, depth: int = 12, seed: int = 42):
    """A forest; a row keeps the node it stands at, so a level does not walk the trees again."""
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, cacheNodeIds=True)


def class_names(df: DataFrame, column: str = "agent") -> list[str]:
    """Sorted class names; the target codes are their positions."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def with_label(df: DataFrame, labels: Sequence[str], column: str = "agent") -> DataFrame:
    codes = F.create_map(*[F.lit(x) for i, n in enumerate(labels) for x in (n, float(i))])
    return df.withColumn("label", F.try_element_at(codes, F.col(column)))


def model_tables(feature_sets: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """The five tables with integer target, target codes fitted once on the base trials."""
    labels = class_names(feature_sets["temporal"])
    return {n: with_label(prepare(df), labels) for n, df in feature_sets.items()}, labels


def usable(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    """Imputation needs a value in every column; all-null columns are left out."""
    numeric = numeric_columns(df, exclude)
    if not numeric:
        return df
    row = df.agg(*[F.count(c).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if row[c] == 0])


def train_classifier(table: DataFrame, labels: Sequence[str], classifier=None,
                     keys: Sequence[str] = TRIAL_KEY) -> PipelineModel:
    """One pipeline from raw feature columns to a class name, fitted on all rows."""
    exclude = {*NOT_FEATURES, *keys}
    table = usable(table.where(F.col("label").isNotNull()), exclude)
    stages = feature_stages(table, exclude)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(labels))
    return Pipeline(stages=[*stages, classifier or forest(), names]).fit(table)


def save_model(model: PipelineModel, path: str) -> None:
    """Encoders, feature order, classifier and class names in one directory."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def cross_validate(table: DataFrame, labels: Sequence[str], classifier=None, keys: Sequence[str] = TRIAL_KEY,
                   parallel: int = 4) -> DataFrame:
    """Predictions of every row by a model that never saw its fold.

    Folds are trained one job each from a small driver thread pool; training
    itself is distributed.
    """
    folds = [r[0] for r in table.select("fold").distinct().orderBy("fold").collect()]

    def one(fold) -> DataFrame:
        model = train_classifier(table.where(F.col("fold") != fold), labels, classifier, keys)
        held = model.transform(table.where(F.col("fold") == fold))
        return held.select(*keys, "fold", F.col("agent").alias("y"), F.col("predicted").alias("yhat"))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def fold_encoders(table: DataFrame, folds: Sequence[int], exclude: Sequence[str] = NOT_FEATURES) -> dict[int, list]:
    """The feature stages of every fold's model, from one pass over the table.

    Values are counted once with their fold; what a fold's training rows hold is the
    whole table's counts less the fold's own, so medians, category codes and header
    names are exact for each fold without reading the table again for it.
    """
    types = dict(table.dtypes)
    numeric = [c for c in numeric_columns(table, exclude)]
    category = [c for c in CATEGORICAL if types.get(c) == "string"]
    vectors = [c for c, t in table.dtypes if t == "vector"]
    sizes = [VectorSizeHint(inputCol=v, size=table.select(F.size(vector_to_array(v))).first()[0], handleInvalid="error") for v in vectors]
    held = F.explode(F.array(*[F.lit(f) for f in folds])).alias("held")
    value = F.nanvl("value", F.lit(None).cast("double"))
    by_fold = (_long(table, numeric, ["fold"]).select("feature", "fold", value.alias("value")).where("value IS NOT NULL")
               .groupBy("feature", "value").pivot("fold", list(folds)).agg(F.count(F.lit(1))))
    every = reduce(lambda a, b: a + b, [F.coalesce(F.col(str(f)), F.lit(0)) for f in folds])
    own = F.create_map(*[x for f in folds for x in (F.lit(f), F.coalesce(F.col(str(f)), F.lit(0)))])
    rest = (by_fold.select("feature", "value", every.alias("all"), own.alias("own"), held)
            .select("feature", "value", "held", (F.col("all") - F.col("own")[F.col("held")]).alias("n")).where("n > 0"))
    medians: dict[int, dict[str, float]] = {f: {} for f in folds}
    for r in grouped_quantiles(rest, ["feature", "held"], "value", {"median": 0.5}, weight="n").collect():
        medians[r["held"]][r["feature"]] = r["median"]

    def seen(column: str, values: DataFrame) -> dict[int, list[str]]:
        """Values that occur outside each fold, sorted; beyond MAX_NAMES is an error."""
        rows = values.where(F.col("v") != "").groupBy("v").agg(F.collect_set("fold").alias("folds")).limit(MAX_NAMES + 1).collect()
        if len(rows) > MAX_NAMES:
            raise ValueError(f"{column} holds more than {MAX_NAMES} values")
        return {f: sorted(r["v"] for r in rows if set(r["folds"]) - {f}) for f in folds}

    labels = {c: seen(c, table.select(F.col(c).alias("v"), "fold").distinct()) for c in category}
    has_names = types.get(NAME_LIST) == "array<string>"
    names = seen(NAME_LIST, table.select(F.explode(NAME_LIST).alias("v"), "fold").distinct()) if has_names else {f: [] for f in folds}
    out = {}
    for f in folds:
        # one indexer a column: a shared one fills shorter label lists with nulls, which no file takes
        stages: list = sizes + [StringIndexerModel.from_labels(labels[c][f], inputCol=c, outputCol=f"{c}_code", handleInvalid="keep") for c in category]
        if names[f]:
            stages.append(CountVectorizerModel.from_vocabulary(names[f], inputCol=NAME_LIST, outputCol="_names", binary=True))
        full = {c: medians[f][c] for c in numeric if c in medians[f]}
        if full:
            stages.append(filled_stage(full))
        parts = vectors + [f"{c}_code" for c in category] + ["_names"] * bool(names[f]) + [f"{c}_full" for c in full]
        stages += [VectorAssembler(inputCols=parts, outputCol="_raw", handleInvalid="keep"),
                   VarianceThresholdSelector(featuresCol="_raw", outputCol="features", varianceThreshold=0.0)]
        out[f] = stages
    return out


def fit_encoded(table: DataFrame, stages: Sequence, held, classifier=None, keys: Sequence[str] = TRIAL_KEY) -> tuple[PipelineModel, object, DataFrame]:
    """(encoders, classifier, encoded rows): both fitted on the rows outside the fold `held`.

    The fitted stages read their rows many times, so those are written once, as vector
    and label.  A forest's tasks each send the counts of all open nodes, so they are as
    few as FIT_ROWS allows, not one a file.
    """
    *ready, selector = stages
    rows = PipelineModel(stages=ready).transform(table.where(F.col("label").isNotNull()))
    rows = materialize(rows.select(*dict.fromkeys([*keys, "fold", "agent", "label", "_raw"])), "encoded")
    seen = rows.where(F.col("fold") != held)
    seen = seen.coalesce(-(-seen.count() // FIT_ROWS) or 1)
    selector = selector.fit(seen)
    return PipelineModel(stages=[*ready, selector]), (classifier or forest()).fit(selector.transform(seen).select("label", "features")), selector.transform(rows)


def at_once(df: DataFrame, jobs: Sequence, parallel: int | None = None) -> ThreadPoolExecutor:
    """Driver threads for jobs that are mostly small: as many as the session has task slots."""
    return ThreadPoolExecutor(max_workers=max(1, min(len(jobs), parallel or df.sparkSession.sparkContext.defaultParallelism)))


def fold_jobs(tables: Mapping[str, DataFrame], folds: Sequence | None, keys: Sequence[str] = TRIAL_KEY, parallel: int | None = None) -> list[tuple]:
    """(table, fold, feature stages of its model) for every table and fold."""
    exclude = {*NOT_FEATURES, *keys}

    def one(name: str) -> list[tuple]:
        df = tables[name]
        held = folds if folds is not None else [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]
        return [(name, f, stages) for f, stages in fold_encoders(df, held, exclude).items()]

    with at_once(next(iter(tables.values())), tables, parallel) as pool:
        return [job for jobs in pool.map(one, tables) for job in jobs]


def cross_validate_tables(tables: Mapping[str, DataFrame], labels: Sequence[str], classifier=None, keys: Sequence[str] = TRIAL_KEY,
                          parallel: int | None = None) -> DataFrame:
    """(table, keys, fold, y, yhat): every row of every table by the model that did not see its fold.

    The tables carry `fold` and share it, so a trial is held out of all of them at
    once.  Each is read for its encoders once; a (table, fold) fit reads its own encoded
    rows.
    """
    names = IndexToString(inputCol="prediction", outputCol="yhat", labels=list(labels))

    def one(job) -> DataFrame:
        name, f, stages = job
        _, fitted, rows = fit_encoded(tables[name], stages, f, classifier, keys)
        out = names.transform(fitted.transform(rows.where(F.col("fold") == f)))
        return out.select(F.lit(name).alias("table"), *keys, "fold", F.col("agent").alias("y"), "yhat")

    jobs = fold_jobs(tables, None, keys, parallel)
    with at_once(next(iter(tables.values())), jobs, parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, jobs))


# ---- scoring -------------------------------------------------------------------


def score_table(model: PipelineModel, features: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Predicted class per row, with the true one when it is there."""
    out = model.transform(features)
    return out.select(*keys, "predicted")


def score_with_confidence(model: PipelineModel, features: DataFrame,
                          keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Class, its probability, and the whole distribution as a map and as JSON."""
    names = F.array(*[F.lit(n) for n in model_labels(model)])
    probs = vector_to_array("probability")
    spread = F.map_from_arrays(names, F.transform(probs, lambda p: F.round(p, 4)))
    return model.transform(features).select(
        *keys, "predicted", F.round(F.array_max(probs), 3).alias("confidence"),
        spread.alias("distribution"), F.to_json(spread).alias("distribution_json"))


def top2_classes(model: PipelineModel, features: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """The two most probable classes; equal probabilities in name order."""
    names = F.array(*[F.lit(n) for n in model_labels(model)])
    pairs = F.zip_with(vector_to_array("probability"), names,
                       lambda p, n: F.struct((-p).alias("neg"), n.alias("name")))
    best = F.slice(F.array_sort(pairs), 1, 2)
    return model.transform(features).select(
        *keys, F.posexplode(best).alias("_rank", "_c")).select(
        *keys, (F.col("_rank") + 1).alias("rank"), F.col("_c.name").alias("class"),
        F.round(-F.col("_c.neg"), 3).alias("probability"))


def consensus_vote(votes: DataFrame, keys: Sequence[str], column: str = "yhat") -> DataFrame:
    """Majority class per checkpoint with its votes and all votes; ties go to the first name."""
    counts = votes.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col(column).alias("v"))).alias("b"),
        F.sum("n").alias("n_models")).select(
        *keys, F.col("b.v").alias("consensus"), (-F.col("b.neg")).alias("votes"), "n_models")


# ---- evaluation ----------------------------------------------------------------


def class_counts(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per class: true positives, support and predicted count.

    Pairs are counted first; each count then feeds its true and its predicted
    class, so one small table serves every metric.
    """
    cells = (pred.where(F.col(yhat).isNotNull()).groupBy(*keys, y, yhat).agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(y).alias("class"), F.when(F.col(y) == F.col(yhat), F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col(yhat).alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
    return (cells.select(*keys, F.inline(sides)).groupBy(*keys, "class")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))


def class_report(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives zero."""
    c = class_counts(pred, keys, y, yhat)

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return c.select(*keys, "class", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                    ratio(F.col("tp"), F.col("support")).alias("recall"),
                    ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp")


def fold_metrics(pred: DataFrame, keys: Sequence[str] = ("fold",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy and macro precision, recall and F1 per fold."""
    return class_report(pred, keys, y, yhat).groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("n"))


def fold_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation over folds."""
    aggs = []
    for m in ("accuracy", "precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return metrics.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_folds"))


def class_f1_by_table(pred: DataFrame, tables: Sequence[str], by: str = "table") -> DataFrame:
    """F1 per class with one column per feature table; null where the class is absent."""
    report = class_report(pred, [by])
    return report.groupBy("class").agg(*[
        F.max(F.when(F.col(by) == t, F.col("f1"))).alias(f"f1_{t}") for t in tables])


def metrics_over_requests(pred: DataFrame, tables: Sequence[str], by: str = "table", n: str = "n_req") -> DataFrame:
    """Accuracy and macro F1 per prefix length, one column pair per feature table.

    Rows without a prediction (a table the client lacks) are left out.
    """
    m = fold_metrics(pred, [n, by])
    cols = []
    for t in tables:
        here = F.col(by) == t
        cols += [F.round(F.max(F.when(here, F.col("accuracy"))), 4).alias(f"accuracy_{t}"),
                 F.round(F.max(F.when(here, F.col("f1"))), 4).alias(f"f1_macro_{t}")]
    return m.groupBy(n).agg(F.max("n").alias("n_trials"), *cols)


def class_f1_over_requests(pred: DataFrame, n: str = "n_req") -> DataFrame:
    return class_report(pred, [n]).select(n, "class", F.round("f1", 4).alias("f1"))


def compare_models(table: DataFrame, labels: Sequence[str], trees: int = 200, depth: int = 8,
                   keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Class report of four learners, each over the same held-out folds."""
    learners = {
        "random_forest": forest(trees, depth),
        "decision_tree": DecisionTreeClassifier(labelCol="label", maxDepth=depth, seed=42, maxBins=64),
        "boosted_trees": OneVsRest(labelCol="label", parallelism=4, classifier=GBTClassifier(
            labelCol="label", maxIter=max(2, trees // 10), maxDepth=3, seed=42, maxBins=64)),
        "logistic": LogisticRegression(labelCol="label", maxIter=50),
    }
    reports = [class_report(cross_validate(table, labels, c, keys)).select(F.lit(n).alias("model"), "*")
               for n, c in learners.items()]
    return reduce(DataFrame.unionByName, reports)


def train_tables(tables: Mapping[str, DataFrame], labels: Sequence[str], folds: Sequence[int],
                 classifier=None, parallel: int | None = None) -> dict[tuple[str, int], PipelineModel]:
    """One model per feature table and held-out fold, keyed (table, fold)."""
    tables = {n: df.where(F.col("label").isNotNull()) for n, df in tables.items()}
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(labels))

    def one(job) -> tuple[tuple[str, int], PipelineModel]:
        name, held, stages = job
        encoders, fitted, _ = fit_encoded(tables[name], stages, held, classifier)
        return (name, held), PipelineModel(stages=[*encoders.stages, fitted, names])

    jobs = fold_jobs(tables, folds, parallel=parallel)
    with at_once(next(iter(tables.values())), jobs, parallel) as pool:
        return dict(pool.map(one, jobs))
