"""Folds, cross-validation, model families and search."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.common import ORDER_FEATURES_SQL, OPTIONS, class_items, order_features, r, regression_items, rounded
from tabloom.operators import boosting, folds, knn, metrics
from tabloom.operators.prep import FEATURES, FULL
from tabloom.plans import benchmark, tuning
from tabloom.plans.families import HOLDOUT, LABEL, registry
from tabloom.plans.training import (
    context_for,
    encode_labels,
    equal_rows,
    fit_preps,
    label_values,
    predict,
    prepared,
    scoring_pipeline,
    train_all,
    training_table,
)
from tabloom.session import write_table
from tabloom.sources.tables import load

HASH_ORDER = "md5(concat_ws('|', '42', o_orderkey::VARCHAR)), o_orderkey"


def _one_feature(spark, sf):
    return order_features(spark, sf).select("o_orderkey", "amount", "y")


def _cv_linear(spark, sf):
    table = training_table(_one_feature(spark, sf), "y", "regression", 5, ["o_orderkey"])
    return train_all(table, registry("regression", ["LinearRegression"]), OPTIONS)


def cv_scores_linear(spark, sf):
    """Imputation and model are refitted for every fold."""
    scores = _cv_linear(spark, sf).fold_scores
    return scores.select(F.col("fold").cast("bigint").alias("fold"), r("score", 3).alias("score"))


CV_LINEAR = f"""WITH f AS (SELECT *, (row_number() OVER (ORDER BY {HASH_ORDER}) - 1) % 5 AS fold FROM {ORDER_FEATURES_SQL}),
  held AS (SELECT DISTINCT fold AS h FROM f),
  fill AS (SELECT h, quantile_cont(amount, 0.5::DOUBLE) AS m FROM held JOIN f ON fold <> h GROUP BY h),
  fit AS (SELECT h, any_value(m) AS m, regr_slope(y, coalesce(amount, m)) AS b, regr_intercept(y, coalesce(amount, m)) AS a
    FROM fill JOIN f ON fold <> h GROUP BY h)
  SELECT fold, round(sqrt(avg(power(y - (a + b * coalesce(amount, m)), 2))), 3) + 0.0 AS score
  FROM f JOIN fit ON fold = h GROUP BY fold"""


def cv_scores_bayes(spark, sf):
    """Accuracy of Gaussian naive Bayes per held-out fold."""
    source = order_features(spark, sf).select("o_orderkey", "amount", "o_custkey", "o_orderstatus")
    table = training_table(source, "o_orderstatus", "classification", 3, ["o_orderkey"])
    scores = train_all(table, registry("classification", ["NaiveBayes"]), OPTIONS).fold_scores
    return scores.select(F.col("fold").cast("bigint").alias("fold"), r("score", 6).alias("score"))


_BAYES_LOSS = " + ".join(f"ln(2 * pi() * v{i}) + power({x} - m{i}, 2) / v{i}" for i, x in enumerate(("x", "o_custkey")))
CV_BAYES = f"""WITH f AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH_ORDER}) - 1) % 3 AS fold
    FROM {ORDER_FEATURES_SQL}),
  held AS (SELECT DISTINCT fold AS h FROM f),
  fill AS (SELECT h, quantile_cont(amount, 0.5::DOUBLE) AS m, count(*) AS n FROM held JOIN f ON fold <> h GROUP BY h),
  stats AS MATERIALIZED (SELECT h, any_value(m) AS m, o_orderstatus AS c, ln(count(*) / any_value(n)::DOUBLE) AS prior,
      avg(coalesce(amount, m)) AS m0, var_pop(coalesce(amount, m)) AS v0, avg(o_custkey) AS m1, var_pop(o_custkey) AS v1
    FROM fill JOIN f ON fold <> h GROUP BY h, o_orderstatus),
  scored AS (SELECT fold, o_orderkey, o_orderstatus, c, prior - 0.5 * ({_BAYES_LOSS}) AS score
    FROM (SELECT *, coalesce(amount, m) AS x FROM f JOIN stats ON fold = h)),
  guessed AS (SELECT fold, o_orderkey, any_value(o_orderstatus) AS actual, arg_max(c, score) AS guess FROM scored GROUP BY 1, 2)
  SELECT fold, round(avg((actual = guess)::INT::DOUBLE), 6) + 0.0 AS score FROM guessed GROUP BY fold"""


def cv_summary(spark, sf):
    scores = (
        load(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.expr("l_partkey % 5").alias("fold"))
        .agg(F.avg("l_discount").alias("score"))
    )
    return rounded(metrics.cv_summary(scores, ["l_suppkey"]), 8, "mean_score", "std_score")


CV_SUMMARY = """SELECT l_suppkey, round(avg(score), 8) + 0.0 AS mean_score, round(stddev_pop(score), 8) + 0.0 AS std_score
  FROM (SELECT l_suppkey, l_partkey % 5 AS fold, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1"""


def train_all_classifiers(spark, sf):
    table = training_table(class_items(spark, sf), "size_class", "classification", 2)
    return train_all(table, registry("classification"), OPTIONS).results.drop("run_id")


def train_all_regressors(spark, sf):
    table = training_table(regression_items(spark, sf), "y", "regression", 2)
    return train_all(table, registry("regression"), OPTIONS).results.drop("run_id")


def _fit(df: DataFrame, target: str, problem: str, family) -> DataFrame:
    """One family fitted on the whole table, beside the rule that looks at no feature.

    The rule's score is the share of the largest class, or the error of the mean.
    """
    table = training_table(df, target, problem, 2)
    prep = fit_preps(table)[FULL]
    data = prepared(table, prep).persist()
    model = family(data, context_for(table, FULL, len(prep.feature_names), OPTIONS))
    predicted = model.transform(equal_rows(data))
    label, guess, n = F.col(LABEL), F.col("prediction"), F.col("n")
    if problem == "classification":
        rule = data.groupBy(LABEL).agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
        better = metrics.counted_score(problem, label, guess, n) > rule
    else:
        rule = data.agg(F.stddev_pop(LABEL)).first()[0]
        better = metrics.counted_score(problem, label, guess, n) < rule
    known = F.sum(F.when(guess.isNotNull() & ~F.isnan(guess), n).otherwise(0))
    found = predicted.agg(F.sum("n").alias("row_count"), known.alias("predicted_rows"), better.alias("better_than_rule"))
    return found.select(F.lit(family.name).alias("model"), "*", r(F.lit(rule), 6).alias("rule_score"))


_CLASS_RULE = """SELECT '{}' AS model, sum(n)::BIGINT AS row_count, sum(n)::BIGINT AS predicted_rows, true AS better_than_rule,
    round(max(n) / sum(n)::DOUBLE, 6) + 0.0 AS rule_score
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY {})"""
_TWO_CLASSES = "l_quantity * (1 - l_discount) > 24"
_THREE_CLASSES = "CASE WHEN l_quantity < 17 THEN 'small' WHEN l_quantity < 34 THEN 'middle' ELSE 'large' END"
_MEAN_RULE = """SELECT '{}' AS model, count(*) AS row_count, count(*) AS predicted_rows, true AS better_than_rule,
    round(stddev_pop(l_quantity * 100 * (1 - l_discount) + 50 * l_tax), 6) + 0.0 AS rule_score FROM lineitem"""


def _classifier(name):
    def query(spark, sf):
        return _fit(class_items(spark, sf), "size_class", "classification", registry("classification", [name])[name])

    return query


def _regressor(name):
    def query(spark, sf):
        return _fit(regression_items(spark, sf), "y", "regression", registry("regression", [name])[name])

    return query


def model_gbt_multiclass(spark, sf):
    """Three classes: boosted trees one against the rest."""
    source = class_items(spark, sf).withColumn(
        "size_class", F.expr("CASE WHEN l_quantity < 17 THEN 'small' WHEN l_quantity < 34 THEN 'middle' ELSE 'large' END")
    )
    family = registry("classification", ["BoostedTreesClassifier"])["BoostedTreesClassifier"]
    return _fit(source, "size_class", "classification", family)


FIRST_SPLIT = ("l_quantity", "l_discount", "l_tax")


def boost_first_split(spark, sf):
    """The split of the first boosted tree: feature, cut, gain and the values of both sides."""
    source = regression_items(spark, sf).select(*FIRST_SPLIT, F.col("y").alias(LABEL))
    data = VectorAssembler(inputCols=list(FIRST_SPLIT), outputCol=FEATURES).transform(source)
    _, rounds, cuts = boosting.boost({FULL: data}, LABEL, 0, boosting.Settings(rounds=1, depth=1))[FULL]
    tree = rounds[0][0]
    feature = tree.feature[0]
    row = (FIRST_SPLIT[feature], float(cuts[feature][tree.bin[0]]), tree.gain[0], tree.value[tree.left[0]], tree.value[tree.right[0]])
    found = spark.createDataFrame([row], "feature string, cut double, gain double, left_value double, right_value double")
    return found.select("feature", r("cut", 6).alias("cut"), r(F.col("gain") / 1e6, 3).alias("gain"), r("left_value", 3).alias("left_value"), r("right_value", 3).alias("right_value"))


_Y = "l_quantity * 100 * (1 - l_discount) + 50 * l_tax"
_SPLITS = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, (x + lead(x) OVER (ORDER BY x)) / 2 AS cut, sum(g) OVER w AS gl, sum(n) OVER w AS nl,
      sum(g) OVER () AS g, sum(n) OVER () AS n
    FROM (SELECT {f} AS x, sum(m - y) AS g, count(*) AS n FROM rows GROUP BY 1) WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)"""
    for f in FIRST_SPLIT
)
BOOST_FIRST_SPLIT = f"""WITH rows AS MATERIALIZED (SELECT *, {_Y} AS y, avg({_Y}) OVER () AS m FROM lineitem),
  splits AS ({_SPLITS}),
  gains AS (SELECT *, gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1) AS gain FROM splits WHERE cut IS NOT NULL)
  SELECT feature, round(cut, 6) + 0.0 AS cut, round(gain / 1e6, 3) + 0.0 AS gain, round(-gl / (nl + 1), 3) + 0.0 AS left_value,
    round((gl - g) / (n - nl + 1), 3) + 0.0 AS right_value
  FROM gains ORDER BY gains.gain DESC LIMIT 1"""


def logistic_gradient(spark, sf):
    """Rows and the largest entry of the gradient at the fitted weights: zero where the fit is the optimum."""
    table = training_table(class_items(spark, sf), "size_class", "classification", 2)
    prep = fit_preps(table)[FULL]
    data = prepared(table, prep).persist()
    model = registry("classification")["LogisticRegression"](data, context_for(table, FULL, len(prep.feature_names), OPTIONS))
    miss = vector_to_array("probability")[1] - F.col(LABEL)
    scored = model.transform(data).select(miss.alias("miss"), F.posexplode(vector_to_array(F.col(FEATURES))).alias("i", "x"))
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
    sums = scored.groupBy("i").agg(F.sum(F.col("miss") * F.col("x")).alias("g"), F.sum("miss").alias("intercept"), F.count("*").alias("n"))
    # the penalty of the fit is half the squared norm of the weights
    entry = F.greatest(F.abs(F.col("g") + F.get(weights, F.col("i"))), F.abs("intercept")) / F.col("n")
    return sums.agg(F.max("n").alias("row_count"), r(F.max(entry), 4).alias("largest_gradient"))


LOGISTIC_GRADIENT = "SELECT count(*) AS row_count, 0.0::DOUBLE AS largest_gradient FROM lineitem"


def _predictions(spark, sf, family):
    table = training_table(_one_feature(spark, sf), "y", "regression", 2, ["o_orderkey"])
    prep = fit_preps(table)[FULL]
    model = family(prepared(table, prep), context_for(table, FULL, len(prep.feature_names), OPTIONS))
    found = predict(table, scoring_pipeline(table, prep, model))
    return found.select("o_orderkey", r("predicted", 3).alias("predicted"))


def model_linear(spark, sf):
    return _predictions(spark, sf, registry("regression")["LinearRegression"])


def model_ridge(spark, sf):
    return _predictions(spark, sf, HOLDOUT["regression"][0])


_FILLED = f"""(SELECT o_orderkey, y, coalesce(amount, (SELECT quantile_cont(amount, 0.5::DOUBLE) FROM {ORDER_FEATURES_SQL})) AS x
  FROM {ORDER_FEATURES_SQL})"""
LINEAR = f"""SELECT o_orderkey, round(a + b * x, 3) + 0.0 AS predicted FROM {_FILLED},
  (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {_FILLED})"""
RIDGE = f"""SELECT o_orderkey, round(my + w * (x - mx) / sx, 3) + 0.0 AS predicted FROM {_FILLED},
  (SELECT avg(y) AS my, avg(x) AS mx, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) * count(*) / (count(*) + 1) AS w
   FROM {_FILLED})"""


def _knn(spark, sf, value: str, output, **settings) -> DataFrame:
    """Every vector is predicted from the folds it is not in."""
    rows = load(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )
    rows = write_table(folds.stratified_folds(rows, ["label"], 3, ["vec_id"]), "folds")
    parts = []
    for fold in range(3):
        references = rows.where(F.col("fold") != fold).select(F.col("vec_id").alias("ref"), "vector", F.col(value).alias("value"))
        found = knn.nearest(rows.where(F.col("fold") == fold), references, 5, **settings)
        parts.append(found.select("vec_id", "fold", output(F.col("neighbours")).alias("predicted")))
    return reduce(DataFrame.unionByName, parts)


def knn_classify(spark, sf):
    return _knn(spark, sf, "label", knn.majority).withColumn("predicted", F.col("predicted").cast("bigint"))


def knn_blocks(spark, sf):
    """The same through the tree of pivots and blocks, as for references that are too large to broadcast."""
    found = _knn(spark, sf, "label", knn.majority, broadcast_cells=0, leaves=16, block_rows=100)
    return found.withColumn("predicted", F.col("predicted").cast("bigint"))


def knn_regress(spark, sf):
    return rounded(_knn(spark, sf, "label", knn.mean_value), 6, "predicted")


_NEAR = """(SELECT q.vec_id, q.fold, r.label, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY round(list_distance(q.v, r.v), 9), r.vec_id) AS place
  FROM e AS q JOIN e AS r ON q.fold <> r.fold)"""
_VECTORS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, (row_number() OVER (PARTITION BY label
    ORDER BY md5(concat_ws('|', '42', vec_id::VARCHAR)), vec_id) - 1) % 3 AS fold FROM embeddings)"""
KNN_CLASS = f"""WITH {_VECTORS}, votes AS (SELECT vec_id, fold, label, count(*) AS n FROM {_NEAR} WHERE place <= 5 GROUP BY 1, 2, 3)
  SELECT vec_id, fold, arg_min(label, (-n, label))::BIGINT AS predicted FROM votes GROUP BY 1, 2"""
KNN_MEAN = f"""WITH {_VECTORS} SELECT vec_id, fold, round(avg(label::DOUBLE), 6) + 0.0 AS predicted
  FROM {_NEAR} WHERE place <= 5 GROUP BY 1, 2"""

BAYES_FEATURES = ("l_quantity", "l_discount", "l_tax")


def gaussian_nb(spark, sf):
    source = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *BAYES_FEATURES,
        "CASE WHEN l_quantity * (1 - l_discount) > 24 THEN 'high' WHEN l_tax > 0.05 THEN 'taxed' ELSE 'low' END AS size_class",
    )
    labels = label_values(source, "size_class")
    data = encode_labels(source, "size_class", labels)
    data = VectorAssembler(inputCols=list(BAYES_FEATURES), outputCol=FEATURES).transform(data)
    model = registry("classification")["NaiveBayes"].fit(data, None, {})
    name = F.array(*[F.lit(v) for v in labels])[F.col("prediction").cast("int")]
    return model.transform(data).select("l_orderkey", "l_linenumber", *BAYES_FEATURES, name.alias("predicted"))


_CLASSED = """(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_quantity * (1 - l_discount) > 24
  THEN 'high' WHEN l_tax > 0.05 THEN 'taxed' ELSE 'low' END AS size_class, row_number() OVER () AS id FROM lineitem)"""
_STATS = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + eps AS v_{c}" for c in BAYES_FEATURES)
_DENSITY = " + ".join(f"ln(2 * pi() * v_{c}) + power({c} - m_{c}, 2) / v_{c}" for c in BAYES_FEATURES)
BAYES = f"""WITH rows AS MATERIALIZED {_CLASSED},
  noise AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in BAYES_FEATURES)}) AS eps FROM rows),
  classes AS (SELECT size_class AS c, ln(count(*) / (SELECT count(*) FROM rows)::DOUBLE) AS prior, {_STATS}
    FROM rows, noise GROUP BY size_class, eps),
  scored AS (SELECT id, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, c, prior - 0.5 * ({_DENSITY}) AS score
    FROM rows, classes)
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, predicted FROM (
    SELECT id, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, any_value(l_quantity) AS l_quantity,
      any_value(l_discount) AS l_discount, any_value(l_tax) AS l_tax, arg_max(c, score) AS predicted FROM scored GROUP BY id)"""


def tune_rf(spark, sf):
    table = training_table(regression_items(spark, sf), "y", "regression", 2)
    return tuning.tune(table, "RandomForestRegressor", options=OPTIONS).trials.drop("study_id")


def tune_gbt(spark, sf):
    table = training_table(class_items(spark, sf), "size_class", "classification", 2)
    return tuning.tune(table, "BoostedTreesClassifier", options=OPTIONS).trials.drop("study_id")


def _ledger(spark, sf):
    """Search ledgers of many studies: twelve trials of five steps each."""
    scores = (
        load(spark, sf, "lineitem")
        .groupBy(
            F.expr("concat('study_', l_suppkey)").alias("study_id"),
            F.expr("l_partkey % 12").alias("trial"),
            F.expr("l_orderkey % 5").alias("step"),
        )
        .agg(F.avg(F.col("l_extendedprice") / F.lit(123457.0)).alias("score"))
    )
    return scores.selectExpr(
        "study_id", "trial", "step",
        "avg(score) OVER (PARTITION BY study_id, trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS running_mean",
    )


_LEDGER = """ledger AS MATERIALIZED (SELECT study_id, trial, step,
    avg(score) OVER (PARTITION BY study_id, trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS running_mean
  FROM (SELECT concat('study_', l_suppkey) AS study_id, l_partkey % 12 AS trial, l_orderkey % 5 AS step,
    avg(l_extendedprice / 123457::DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3))"""


def median_prune(spark, sf):
    found = tuning.median_prune(_ledger(spark, sf), lower_is_better=True)
    return rounded(found, 8, "running_mean", "best_so_far", "median_before")


MEDIAN_PRUNE = f"""WITH {_LEDGER}, marked AS (SELECT *,
    min(running_mean) OVER (PARTITION BY study_id, trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far,
    max(step) OVER (PARTITION BY study_id, trial) = max(step) OVER (PARTITION BY study_id) AS done FROM ledger),
  earlier AS (SELECT study_id, trial, step, running_mean, best_so_far,
    count(CASE WHEN done THEN running_mean END) OVER w AS finished_before,
    quantile_cont(CASE WHEN done THEN running_mean END, 0.5::DOUBLE) OVER w AS median_before FROM marked
    WINDOW w AS (PARTITION BY study_id, step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT study_id, trial, step, round(running_mean, 8) + 0.0 AS running_mean, round(best_so_far, 8) + 0.0 AS best_so_far,
    finished_before, round(median_before, 8) + 0.0 AS median_before,
    coalesce(step >= 1 AND finished_before >= 5 AND best_so_far > median_before, false) AS pruned FROM earlier"""


def best_trial(spark, sf):
    return rounded(tuning.best_trial(_ledger(spark, sf), lower_is_better=False), 8, "best_score")


BEST_TRIAL = f"""WITH {_LEDGER}, trials AS (SELECT study_id, trial, arg_max(running_mean, step) AS value, max(step) AS steps
    FROM ledger GROUP BY 1, 2)
  SELECT study_id, arg_max(trial, (value, -trial)) AS best_trial, round(max(value), 8) + 0.0 AS best_score FROM trials AS t
  WHERE steps = (SELECT max(steps) FROM trials AS o WHERE o.study_id = t.study_id) GROUP BY 1"""


def _guessed(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_partkey % 5 AS fold", "l_suppkey", "l_quantity AS actual", "l_extendedprice / 2000D AS predicted",
        "l_returnflag AS flag", "CASE WHEN l_quantity > 45 THEN 'Z' WHEN l_tax > 0.04 THEN l_returnflag ELSE 'N' END AS guess",
    )


_GUESSED = """(SELECT l_partkey % 5 AS fold, l_suppkey, l_quantity AS actual, l_extendedprice / 2000::DOUBLE AS predicted,
  l_returnflag AS flag, CASE WHEN l_quantity > 45 THEN 'Z' WHEN l_tax > 0.04 THEN l_returnflag ELSE 'N' END AS guess FROM lineitem)"""


def fold_scores(spark, sf):
    return rounded(metrics.fold_scores(_guessed(spark, sf), "regression", "actual", "predicted"), 6, "score")


FOLD_SCORES = f"SELECT fold, round(sqrt(avg(power(actual - predicted, 2))), 6) + 0.0 AS score FROM {_GUESSED} GROUP BY 1"


def eval_classification(spark, sf):
    return rounded(metrics.evaluate(_guessed(spark, sf), "classification", "flag", "guess"), 6, "accuracy")


EVAL_CLASS = f"SELECT round(avg((flag = guess)::INT::DOUBLE), 6) + 0.0 AS accuracy FROM {_GUESSED}"


def eval_regression(spark, sf):
    found = metrics.evaluate(_guessed(spark, sf), "regression", "actual", "predicted", ["l_suppkey"])
    return rounded(found, 6, "r2", "mae", "rmse")


EVAL_REG = f"""SELECT l_suppkey, round(1 - sum(power(actual - predicted, 2)) / sum(power(actual - mean, 2)), 6) + 0.0 AS r2,
  round(avg(abs(actual - predicted)), 6) + 0.0 AS mae, round(sqrt(avg(power(actual - predicted, 2))), 6) + 0.0 AS rmse
  FROM (SELECT *, avg(actual) OVER (PARTITION BY l_suppkey) AS mean FROM {_GUESSED}) GROUP BY 1"""


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_guessed(spark, sf), "flag", "guess")


CONFUSION = f"""SELECT a.flag AS actual, b.flag AS predicted, (SELECT count(*) FROM {_GUESSED} AS g
    WHERE g.flag = a.flag AND g.guess = b.flag) AS n
  FROM (SELECT DISTINCT flag FROM {_GUESSED}) AS a, (SELECT DISTINCT flag FROM {_GUESSED}) AS b"""


def residuals(spark, sf):
    return rounded(metrics.residuals(_guessed(spark, sf), "actual", "predicted"), 6, "predicted", "residual")


RESIDUALS = f"""SELECT actual, round(predicted, 6) + 0.0 AS predicted, round(actual - predicted, 6) + 0.0 AS residual FROM {_GUESSED}"""


def residual_bins(spark, sf):
    found = metrics.residual_bins(_guessed(spark, sf), "actual", "predicted", 20)
    return rounded(found, 6, "predicted", "mean_residual", "min_residual", "max_residual")


RESIDUAL_BINS = f"""SELECT bin, count(*) AS n, round(avg(predicted), 6) + 0.0 AS predicted,
    round(avg(actual - predicted), 6) + 0.0 AS mean_residual, round(min(actual - predicted), 6) + 0.0 AS min_residual,
    round(max(actual - predicted), 6) + 0.0 AS max_residual
  FROM (SELECT *, least(floor((predicted - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin FROM {_GUESSED},
    (SELECT min(predicted) AS lo, max(predicted) AS hi FROM {_GUESSED})) GROUP BY bin"""


def holdout_compare(spark, sf):
    source = order_features(spark, sf).selectExpr("o_orderkey", "amount", "o_custkey", "y")
    return benchmark.holdout_compare(source, "y", ["o_orderkey"], options=OPTIONS)


def holdout_ridge(spark, sf):
    """The comparison for one of its models, which SQL can follow."""
    found = benchmark.holdout_compare(_one_feature(spark, sf), "y", ["o_orderkey"], folds=5, options=OPTIONS, names=["Ridge"])
    return found.select("model", "cv_score", "test_score", "best")


_HELD_OUT = "(y - my - w * (coalesce(amount, m) - mx) / sx)"
HOLDOUT_RIDGE = f"""WITH f AS MATERIALIZED (SELECT o_orderkey, amount, y,
    ('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 8))::BIGINT < {int(0.2 * 2**32)} AS is_test FROM {ORDER_FEATURES_SQL}),
  tr AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY {HASH_ORDER}) - 1) % 5 AS fold FROM f WHERE NOT is_test),
  held AS (SELECT DISTINCT fold AS h FROM tr UNION ALL SELECT -1),
  fill AS (SELECT h, avg(amount) AS m FROM held JOIN tr ON fold <> h GROUP BY h),
  fit AS MATERIALIZED (SELECT h, any_value(m) AS m, avg(y) AS my, avg(coalesce(amount, m)) AS mx, stddev_pop(coalesce(amount, m)) AS sx,
    covar_pop(coalesce(amount, m), y) / stddev_pop(coalesce(amount, m)) * count(*) / (count(*) + 1) AS w FROM fill JOIN tr ON fold <> h GROUP BY h),
  cv AS (SELECT fold, 1 - sum(power({_HELD_OUT}, 2)) / (var_pop(y) * count(*)) AS r2 FROM tr JOIN fit ON fold = h GROUP BY fold),
  test AS (SELECT 1 - sum(power({_HELD_OUT}, 2)) / (var_pop(y) * count(*)) AS r2 FROM f, fit WHERE is_test AND h = -1)
  SELECT 'Ridge' AS model, round((SELECT avg(r2) FROM cv), 4) AS cv_score, round((SELECT r2 FROM test), 4) AS test_score,
    'This is the best fit model' AS best"""


QUERIES = {
    f.__name__: f
    for f in (
        cv_scores_linear, cv_scores_bayes, cv_summary, train_all_classifiers, train_all_regressors, model_gbt_multiclass, model_linear,
        model_ridge, knn_classify, knn_blocks, knn_regress, gaussian_nb, tune_rf, tune_gbt, median_prune, best_trial, fold_scores,
        eval_classification, eval_regression, confusion_matrix, residuals, residual_bins, holdout_compare, holdout_ridge, boost_first_split, logistic_gradient,
    )
} | {
    "model_logistic": _classifier("LogisticRegression"),
    "model_rf_cls": _classifier("RandomForestClassifier"),
    "model_gbt_cls": _classifier("BoostedTreesClassifier"),
    "model_gbt_leafy_cls": _classifier("LeafyBoostedTreesClassifier"),
    "model_svc_rff": _classifier("KernelSVC"),
    "model_rf_reg": _regressor("RandomForestRegressor"),
    "model_gbt_reg": _regressor("BoostedTreesRegressor"),
    "model_gbt_leafy_reg": _regressor("LeafyBoostedTreesRegressor"),
    "model_kernel_huber": _regressor("KernelHuber"),
}
ORACLES = {
    "cv_scores_linear": CV_LINEAR,
    "cv_scores_bayes": CV_BAYES,
    "cv_summary": CV_SUMMARY,
    "model_linear": LINEAR,
    "model_ridge": RIDGE,
    "knn_classify": KNN_CLASS,
    "knn_blocks": KNN_CLASS,
    "knn_regress": KNN_MEAN,
    "gaussian_nb": BAYES,
    "median_prune": MEDIAN_PRUNE,
    "best_trial": BEST_TRIAL,
    "fold_scores": FOLD_SCORES,
    "eval_classification": EVAL_CLASS,
    "eval_regression": EVAL_REG,
    "confusion_matrix": CONFUSION,
    "residuals": RESIDUALS,
    "residual_bins": RESIDUAL_BINS,
    "holdout_ridge": HOLDOUT_RIDGE,
    "boost_first_split": BOOST_FIRST_SPLIT,
    "logistic_gradient": LOGISTIC_GRADIENT,
}
# fitted models: every row predicted, and better than the rule that looks at no feature
ORACLES |= {
    query: _CLASS_RULE.format(family, _TWO_CLASSES)
    for query, family in {
        "model_logistic": "LogisticRegression",
        "model_rf_cls": "RandomForestClassifier",
        "model_gbt_cls": "BoostedTreesClassifier",
        "model_gbt_leafy_cls": "LeafyBoostedTreesClassifier",
        "model_svc_rff": "KernelSVC",
    }.items()
}
ORACLES |= {
    query: _MEAN_RULE.format(family)
    for query, family in {
        "model_rf_reg": "RandomForestRegressor",
        "model_gbt_reg": "BoostedTreesRegressor",
        "model_gbt_leafy_reg": "LeafyBoostedTreesRegressor",
        "model_kernel_huber": "KernelHuber",
    }.items()
}
ORACLES["model_gbt_multiclass"] = _CLASS_RULE.format("BoostedTreesClassifier", _THREE_CLASSES)
