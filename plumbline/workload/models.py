"""Model, experiment log and ship gate queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import abtest, drift, metrics, model, tracking
from plumbline.operators.contracts import summarize
from plumbline.plans.durable import scratch_path
from plumbline.workload.abtests import labelled
from plumbline.workload.contracts import all_results, summary_sql
from plumbline.workload.drift import ROLLUP_SQL, order_sides
from plumbline.workload.profiles import LINES, lines_with_nulls
from plumbline.workload.registry import query, rounded, sql_union

LABELLED = "(SELECT * FROM documents JOIN labels USING (doc_id))"


@query(
    "model_prepare",
    f"SELECT l_quantity, l_returnflag, l_discount FROM {LINES} WHERE l_discount IS NOT NULL",
)
def prepare(read):
    rows, _ = model.prepare(lines_with_nulls(read), "l_discount", ["l_quantity", "L_DISCOUNT", "l_returnflag", "gone"])
    return rows


TARGETS = [("lineitem", "l_discount", True), ("part", "p_retailprice", True), ("part", "p_size", True),
           ("orders", "o_orderstatus", False), ("events", "event_type", False)]


@query(
    "model_task",
    sql_union(
        f"""SELECT '{c}' AS target, n, "distinct", CASE WHEN {numeric} AND "distinct" > greatest(2, least(20,
 floor(n * 0.05::DOUBLE))) THEN 'regression' ELSE 'classification' END AS task
 FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS "distinct" FROM {t})"""
        for t, c, numeric in TARGETS
    ),
)
def task(read):
    result = None
    for table, target, _ in TARGETS:
        one = model.detect_task(read(table), target).select(F.lit(target).alias("target"), "n", "distinct", "task")
        result = one if result is None else result.unionAll(one)
    return result


LEAKY_PARTS = """(SELECT *, 2 * p_retailprice + p_size / 1000.0 AS copy, nullif(p_size, 7) AS size_gap, 'x' AS same,
 -p_retailprice AS opposite FROM part)"""


def _leaky_parts(read):
    price = F.col("p_retailprice")
    return read("part").withColumns(
        {
            "copy": 2 * price + F.col("p_size") / 1000.0,
            "size_gap": F.nullif("p_size", F.lit(7)),
            "same": F.lit("x"),
            "opposite": -price,
        }
    )


LEAK_NUMBERS = ["p_partkey", "p_size", "copy", "size_gap", "opposite"]


@query(
    "model_leakage",
    sql_union(
        ["SELECT 'P_RETAILPRICE' AS feature, 'is the target itself' AS reason"]
        + [
            f"SELECT '{c}' AS feature, 'has one value only' AS reason FROM {LEAKY_PARTS} HAVING count(DISTINCT {c}) <= 1"
            for c in [*LEAK_NUMBERS, "p_name", "same"]
        ]
        + [
            f"SELECT '{c}', 'tells nearly every row apart' FROM {LEAKY_PARTS}"
            f" HAVING count(*) > 20 AND count(DISTINCT {c}) >= 0.95 * count(*)"
            for c in [*LEAK_NUMBERS, "p_name", "same"]
        ]
        + [
            f"SELECT '{c}', printf('correlation %.3f with the target', r) FROM (SELECT corr(coalesce({c}::DOUBLE, m), p_retailprice)"
            f" AS r FROM {LEAKY_PARTS}, (SELECT median({c}::DOUBLE) AS m FROM {LEAKY_PARTS})) WHERE abs(r) > 0.98"
            for c in LEAK_NUMBERS
        ]
    ),
)
def leakage(read):
    return model.leakage(_leaky_parts(read), "p_retailprice", [*LEAK_NUMBERS, "p_name", "same", "P_RETAILPRICE"])


ENCODED = "(SELECT * REPLACE (nullif(n_chars, 380) AS n_chars, nullif(source, 'src1') AS source) FROM documents)"


def _documents_with_nulls(read):
    return read("documents").withColumns(
        {"n_chars": F.nullif("n_chars", F.lit(380)), "source": F.nullif("source", F.lit("src1"))}
    )


@query(
    "model_encode",
    f"""SELECT 'n_chars' AS slot, sum(coalesce(n_chars, m))::DOUBLE AS total, count(*) AS filled
 FROM {ENCODED}, (SELECT median(n_chars) AS m FROM {ENCODED})
 UNION ALL SELECT 'lang_' || lang, count(*), count(*) FROM documents GROUP BY lang
 UNION ALL SELECT 'source_' || coalesce(source, '__null__'), count(*), count(*) FROM {ENCODED} GROUP BY 1""",
)
def encode(read):
    """Column sums of the encoded feature matrix, slot by slot."""
    rows = _documents_with_nulls(read).select("n_chars", "lang", "source")
    encoder = model.fit_encoder(rows, ["n_chars", "lang", "source"])
    cells = encoder.encode(rows).select(F.posexplode(vector_to_array("features")).alias("i", "v"))
    sums = cells.groupBy("i").agg(F.sum("v").alias("total"), F.count_if(F.col("v") != 0).alias("filled"))
    return sums.join(encoder.slot_table(), F.col("i") == F.col("slot")).select(F.col("feature").alias("slot"), "total", "filled")


WIDE_ROWS = "(SELECT o_custkey::VARCHAR AS customer, CASE WHEN o_orderkey % 3 = 0 THEN 'one' ELSE o_orderkey::VARCHAR END AS code, o_totalprice FROM orders)"


@query(
    "model_encode_wide",
    f"""SELECT 'o_totalprice' AS slot, 0::BIGINT AS place, count(*) AS filled FROM {WIDE_ROWS}
 UNION ALL SELECT 'customer_' || customer, row_number() OVER (ORDER BY customer), count(*) FROM {WIDE_ROWS} GROUP BY customer
 UNION ALL SELECT 'code_' || code, (SELECT count(DISTINCT customer) FROM {WIDE_ROWS}) + row_number() OVER (ORDER BY code), count(*)
 FROM {WIDE_ROWS} GROUP BY code""",
)
def encode_wide(read):
    """Levels nearly as many as rows, and one that a third of the rows share: slots are counted, not collected."""
    code = F.when(F.col("o_orderkey") % 3 == 0, "one").otherwise(F.col("o_orderkey").cast("string")).alias("code")
    rows = read("orders").select(F.col("o_custkey").cast("string").alias("customer"), code, "o_totalprice")
    encoder = model.fit_encoder(rows, ["o_totalprice", "customer", "code"])
    cells = encoder.parts(rows, []).select(F.explode("features.indices").alias("place"))
    counts = cells.groupBy("place").agg(F.count(F.lit(1)).alias("filled"))
    named = counts.join(encoder.slot_table(), F.col("place") == F.col("slot"))
    return named.select(F.col("feature").alias("slot"), F.col("place").cast("bigint").alias("place"), "filled")


@query("model_labels", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS label FROM part")
def labels(read):
    """Classes numbered in a table of their own and met by a join."""
    parts = read("part").select("p_partkey", "p_type")
    classes, n = model.class_table(parts, "p_type")
    return model.with_label(parts, "p_type", classes, n, "label").select("p_partkey", "label")


def bucket_sql(key: str) -> str:
    return f"(('0x' || substr(md5('42|' || {key}::VARCHAR), 1, 8))::BIGINT % 100 < 25)"


@query("model_split", f"SELECT event_id, {bucket_sql('event_id')} AS is_test FROM events")
def split(read):
    return model.with_test_flag(read("events").select("event_id"), 42)


RARE = """(SELECT event_id, CASE WHEN event_id < 300 THEN 'rare' || (event_id // 3)::VARCHAR ELSE event_type END AS kind
 FROM events)"""


@query(
    "model_split_stratified",
    f"""WITH rows AS (SELECT event_id, kind, {bucket_sql('event_id')} AS t, md5('42|' || event_id::VARCHAR) AS m FROM {RARE}),
 sides AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE t) AS tests, min(m) AS lowest FROM rows GROUP BY kind)
 SELECT event_id, kind, t <> (n > 1 AND (tests = 0 OR tests = n) AND m = lowest) AS is_test FROM rows JOIN sides USING (kind)""",
)
def split_stratified(read):
    few = F.concat(F.lit("rare"), F.floor(F.col("event_id") / 3).cast("string"))
    kind = F.when(F.col("event_id") < 300, few).otherwise(F.col("event_type"))
    return model.with_test_flag(read("events").select("event_id", kind.alias("kind")), 42, ["event_id"], "kind")


# Rules of thumb that stand in for a fitted model, so that scores can be checked.
GUESS = "CASE WHEN length(source) > 4 THEN 'de' WHEN n_chars > 1000 THEN 'en' WHEN n_chars > 400 THEN 'fr' ELSE 'xx' END"


def _guesses(read):
    return read("documents").select(F.col("lang").alias("label"), F.expr(GUESS).alias("prediction"))


CLASSES = f"""(SELECT c, count(*) FILTER (WHERE lang = c) AS s, count(*) FILTER (WHERE g = c) AS p,
 count(*) FILTER (WHERE lang = c AND g = c) AS h FROM (SELECT lang, {GUESS} AS g FROM documents),
 (SELECT DISTINCT lang AS c FROM documents UNION SELECT DISTINCT {GUESS} FROM documents) GROUP BY c)"""


@query(
    "classification_metrics",
    f"""SELECT metric, round(value, 6) AS value FROM (
 SELECT 'accuracy' AS metric, sum(h) / sum(s) AS value FROM {CLASSES}
 UNION ALL SELECT 'precision', sum(s * coalesce(h / nullif(p, 0), 0)) / sum(s) FROM {CLASSES}
 UNION ALL SELECT 'recall', sum(s * coalesce(h / nullif(s, 0), 0)) / sum(s) FROM {CLASSES}
 UNION ALL SELECT 'f1', sum(s * coalesce(2 * h / nullif(p + s, 0), 0)) / sum(s) FROM {CLASSES})""",
)
def classification(read):
    return rounded(metrics.classification_metrics(_guesses(read)), 6, "value")


@query(
    "confusion_matrix",
    f"""SELECT lang AS actual, {GUESS} AS predicted, count(*) AS "count" FROM documents GROUP BY 1, 2""",
)
def confusion_matrix(read):
    return metrics.confusion(_guesses(read))


PRICE_GUESS = "900 + p_partkey / 20.0 + 3 * p_size"


@query(
    "regression_metrics",
    f"""SELECT metric, round(value, 4) AS value FROM (SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM (SELECT p_retailprice AS y, p_retailprice - ({PRICE_GUESS}) AS e
 FROM part)) UNPIVOT (value FOR metric IN (mae, rmse, r2))""",
)
def regression(read):
    rows = read("part").select(
        F.col("p_retailprice").alias("label"), F.expr(PRICE_GUESS).cast("double").alias("prediction")
    )
    return rounded(metrics.regression_metrics(rows), 4, "value")


@query(
    "model_baseline",
    f"""WITH c AS (SELECT event_type AS label, {bucket_sql('event_id')} AS t FROM events),
 r AS (SELECT p_retailprice AS label, {bucket_sql('p_partkey')} AS t FROM part),
 guess AS (SELECT label AS g FROM c WHERE NOT t GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
 mean AS (SELECT avg(label) AS g FROM r WHERE NOT t)
 SELECT 'classification' AS task, g AS guess, 'accuracy' AS metric,
 round(count(*) FILTER (WHERE label = g) / count(*), 6) AS value FROM c, guess WHERE t GROUP BY g
 UNION ALL SELECT 'regression', 'mean', 'mae', round(avg(abs(label - g)), 4) FROM r, mean WHERE t
 UNION ALL SELECT 'regression', 'mean', 'r2',
 round(1 - sum((label - g) ** 2) / (var_pop(label) * count(*)), 6) FROM r, mean WHERE t""",
)
def baseline(read):
    events = read("events").select("event_id", F.col("event_type").alias("label"))
    train, test = model.split(events, 42, ["event_id"])
    guess = model.baseline_prediction(train, model.CLASSIFICATION)
    hits = test.agg(F.round(F.avg((F.col("label") == F.lit(guess)).cast("double")), 6).alias("value"))
    parts = read("part").select("p_partkey", F.col("p_retailprice").alias("label"))
    train, test = model.split(parts, 42, ["p_partkey"])
    mean = model.baseline_prediction(train, model.REGRESSION)
    scores = metrics.regression_metrics(test.select("label", F.lit(mean).alias("prediction")))
    digits = F.when(F.col("metric") == "r2", F.round("value", 6)).otherwise(F.round("value", 4))
    return hits.select(
        F.lit("classification").alias("task"), F.lit(guess).alias("guess"), F.lit("accuracy").alias("metric"), "value"
    ).unionAll(
        scores.where("metric <> 'rmse'").select(F.lit("regression"), F.lit("mean"), "metric", digits)
    )


# -- fitting -------------------------------------------------------------------


def _ols_sql(features: str) -> str:
    """Least squares on the training parts in closed form, scored on the others.

    One row: coefficients, r2, mae and rmse of the fit and of the mean, sizes.
    """
    if features == "p_size":
        slopes = "regr_slope(y, p_size) AS b1, 0.0 AS b2"
    else:
        det = "(var_samp(p_size) * var_samp(p_partkey) - covar_samp(p_size, p_partkey) ** 2)"
        slopes = f"""(covar_samp(p_size, y) * var_samp(p_partkey) - covar_samp(p_partkey, y) * covar_samp(p_size, p_partkey))
 / {det} AS b1, (covar_samp(p_partkey, y) * var_samp(p_size) - covar_samp(p_size, y) * covar_samp(p_size, p_partkey))
 / {det} AS b2"""
    source = f"""(SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice AS y,
 {bucket_sql("p_partkey")} AS t FROM part)"""
    return f"""(WITH fit AS (SELECT {slopes}, avg(p_size) AS m1, avg(p_partkey) AS m2, avg(y) AS my, count(*) AS n_train
 FROM {source} WHERE NOT t)
 SELECT any_value(b1) AS b1, any_value(b2) AS b2, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae,
 sqrt(avg(e * e)) AS rmse, 1 - sum((y - my) ** 2) / (var_pop(y) * count(*)) AS baseline_r2, avg(abs(y - my)) AS baseline_mae,
 any_value(n_train)::DOUBLE AS n_train, count(*)::DOUBLE AS n_test, {2 - (features == "p_size")}.0 AS n_features
 FROM (SELECT *, y - (my + b1 * (p_size - m1) + b2 * (p_partkey - m2)) AS e FROM {source}, fit WHERE t))"""


def _price_model(read, features: list[str], algo: str = "linear") -> dict:
    return model.train(read("part"), "p_retailprice", features, algo, max_depth=5, split_keys=["p_partkey"])


@query(
    "model_train_regress",
    f"""SELECT metric, round(value, 4) AS value FROM (SELECT r2, mae, rmse, baseline_r2, baseline_mae, n_train, n_test,
 n_features::DOUBLE AS n_features, (r2 > baseline_r2 + 1e-9)::INTEGER::DOUBLE AS beats_baseline
 FROM {_ols_sql("p_size, p_partkey")}) UNPIVOT (value FOR metric IN (r2, mae, rmse, baseline_r2, baseline_mae,
 n_train, n_test, n_features, beats_baseline))""",
)
def train_regress(read):
    return rounded(model.model_table(_price_model(read, ["p_size", "p_partkey"])), 4, "value")


@query(
    "model_importances",
    f"""SELECT 'p_size' AS feature, round(abs(b1), 6) AS value FROM {_ols_sql("p_size, p_partkey")}
 UNION ALL SELECT 'p_partkey', round(abs(b2), 6) FROM {_ols_sql("p_size, p_partkey")}""",
)
def model_importances(read):
    return rounded(_price_model(read, ["p_size", "p_partkey"])["importances"], 6, "value")


# A tree deep enough to separate every (event_type, big) cell predicts the most
# frequent class of the cell.
CELLS = f"""(SELECT event_type, value > 60 AS big, CASE WHEN value > 50 + user_id % 9 THEN 'high' WHEN value > 25
 THEN 'mid' ELSE 'low' END AS y, {bucket_sql("event_id")} AS t FROM events)"""
TREE_PREDICTIONS = f"""(SELECT y, g FROM {CELLS} JOIN (SELECT event_type, big, y AS g FROM (SELECT event_type, big, y,
 row_number() OVER (PARTITION BY event_type, big ORDER BY count(*) DESC, y) AS r FROM {CELLS} WHERE NOT t
 GROUP BY event_type, big, y) WHERE r = 1) USING (event_type, big) WHERE t)"""
TREE_CLASSES = f"""(SELECT c, count(*) FILTER (WHERE y = c) AS s, count(*) FILTER (WHERE g = c) AS p,
 count(*) FILTER (WHERE y = c AND g = c) AS h FROM {TREE_PREDICTIONS}, (SELECT DISTINCT y AS c FROM {CELLS})
 GROUP BY c)"""
HITS = f"""(SELECT avg((y = common)::INTEGER) AS share FROM {CELLS},
 (SELECT y AS common FROM {CELLS} WHERE NOT t GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) WHERE t)"""


def _event_model(read, algo: str = "tree") -> dict:
    level = F.when(F.col("value") > 50 + F.col("user_id") % 9, "high").when(F.col("value") > 25, "mid").otherwise("low")
    events = read("events").select("event_id", "event_type", (F.col("value") > 60).alias("big"), level.alias("level"))
    return model.train(events, "level", ["event_type", "big"], algo, max_depth=10, split_keys=["event_id"])


@query(
    "model_train_classify",
    f"""SELECT metric, round(value, 6) AS value FROM (
 SELECT 'accuracy' AS metric, sum(h) / sum(s) AS value FROM {TREE_CLASSES}
 UNION ALL SELECT 'precision', sum(s * coalesce(h / nullif(p, 0), 0)) / sum(s) FROM {TREE_CLASSES}
 UNION ALL SELECT 'recall', sum(s * coalesce(h / nullif(s, 0), 0)) / sum(s) FROM {TREE_CLASSES}
 UNION ALL SELECT 'f1', sum(s * coalesce(2 * h / nullif(p + s, 0), 0)) / sum(s) FROM {TREE_CLASSES}
 UNION ALL SELECT 'baseline_accuracy', share FROM {HITS}
 UNION ALL SELECT 'n_train', count(*) FROM {CELLS} WHERE NOT t
 UNION ALL SELECT 'n_test', count(*) FROM {CELLS} WHERE t
 UNION ALL SELECT 'n_features', count(DISTINCT event_type) + 2 FROM events
 UNION ALL SELECT 'beats_baseline', (sum(h) / sum(s) > 1e-9 + any_value(share))::INTEGER FROM {TREE_CLASSES}, {HITS})""",
)
def train_classify(read):
    return rounded(model.model_table(_event_model(read)), 6, "value")


# With these cells as the only inputs, a forest of full trees and a logistic
# model with interactions spread over the cells agree with the majority of each.
@query("model_forest", f"SELECT round(avg((y = g)::INTEGER), 6) AS accuracy, count(*) AS n_test FROM {TREE_PREDICTIONS}")
def model_forest(read):
    found = _event_model(read, "forest")
    return read.spark.createDataFrame([(round(found["metrics"]["accuracy"], 6), found["n_test"])], "accuracy double, n_test bigint")


CELL_WORDS = f"""(SELECT event_type || big::VARCHAR AS cell, y, t FROM {CELLS})"""
CELL_GUESSES = f"""(SELECT y, g FROM {CELL_WORDS} JOIN (SELECT cell, y AS g FROM (SELECT cell, y,
 row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, y) AS r FROM {CELL_WORDS} WHERE NOT t
 GROUP BY cell, y) WHERE r = 1) USING (cell) WHERE t)"""


@query("model_logistic", f"SELECT round(avg((y = g)::INTEGER), 6) AS accuracy, count(*) AS n_test FROM {CELL_GUESSES}")
def model_logistic(read):
    """One slot per cell: the fitted classes of a saturated logistic model are the cells' majorities."""
    level = F.when(F.col("value") > 50 + F.col("user_id") % 9, "high").when(F.col("value") > 25, "mid").otherwise("low")
    cell = F.concat("event_type", (F.col("value") > 60).cast("string")).alias("cell")
    found = model.train(read("events").select("event_id", cell, level.alias("level")), "level", ["cell"], "linear", split_keys=["event_id"])
    return read.spark.createDataFrame([(round(found["metrics"]["accuracy"], 6), found["n_test"])], "accuracy double, n_test bigint")


def _draw(what: str, slot: int) -> str:
    """The uniform draw of ``perturb`` for a test row and slot."""
    return f"((('0x' || substr(md5(concat_ws('|', '42', '{what}', i::VARCHAR, '{slot}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _stress_sql() -> str:
    """Perturbed inputs of the closed-form price model; rows are numbered in the order of their columns."""
    slots = {"p_size": 0, "p_partkey": 1}
    score = "1 - sum(e * e) / (var_pop(y) * count(*))"
    error = "y - (my + b1 * ({p_size} - m1) + b2 * ({p_partkey} - m2)) AS e"
    noise = {
        n: f"{n} + sqrt(-2 * ln({_draw('radius', k)})) * cos(2 * pi() * {_draw('angle', k)}) * 0.1 * s{k}" for n, k in slots.items()
    }
    zeroed = {n: f"CASE WHEN {_draw('zero', k)} < 0.1 THEN 0 ELSE {n} END" for n, k in slots.items()}
    ols = _ols_sql("p_size, p_partkey")
    rows = f"""(SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice AS y,
 row_number() OVER (ORDER BY p_size, p_partkey, p_retailprice) - 1 AS i, stddev_samp(p_size) OVER () AS s0,
 stddev_samp(p_partkey) OVER () AS s1 FROM part WHERE {bucket_sql("p_partkey")})"""
    means = f"""(SELECT avg(p_size) AS m1, avg(p_partkey) AS m2, avg(p_retailprice) AS my FROM part
 WHERE NOT {bucket_sql("p_partkey")})"""
    base = f"{rows} r, {means} m, (SELECT b1, b2, r2, abs(b1) >= abs(b2) AS size_first FROM {ols}) o"
    shuffled = f"""(SELECT r.*, CASE WHEN size_first THEN n.p_size ELSE r.p_size END AS q_size,
 CASE WHEN size_first THEN r.p_partkey ELSE n.p_partkey END AS q_partkey
 FROM (SELECT *, row_number() OVER (ORDER BY {_draw('shuffle', 0)}, i) - 1 AS place FROM {rows}) n
 JOIN {rows} r ON r.i = n.place, (SELECT abs(b1) >= abs(b2) AS size_first FROM {ols}) f)"""
    moved = {"p_size": "q_size", "p_partkey": "q_partkey"}
    return f"""WITH out AS (
 SELECT 'noise' AS kind, y, {error.format(**noise)} FROM {base}
 UNION ALL SELECT 'zeroed', y, {error.format(**zeroed)} FROM {base}
 UNION ALL SELECT 'shuffled', y, {error.format(**moved)} FROM {shuffled} r, {means} m, (SELECT b1, b2 FROM {ols}) o)
 SELECT kind, round({score}, 4) AS metric, round(any_value(r2), 4) AS clean FROM out, (SELECT r2 FROM {ols}) GROUP BY kind"""


@query("model_stress", _stress_sql())
def model_stress(read):
    """Scores under perturbation of a model that SQL can fit; draws are digests of seed, row and slot."""
    found = _price_model(read, ["p_size", "p_partkey"])["stress"]
    kind = F.when(F.col("name").contains("noise"), "noise").when(F.col("name").contains("zeroed"), "zeroed").otherwise("shuffled")
    return rounded(found.select(kind.alias("kind"), "metric", "clean"), 4, "metric", "clean")


@query(
    "experiment_log",
    f"""SELECT id, algo, n_features, n_train::BIGINT AS n_train, n_test::BIGINT AS n_test, round(r2, 6) AS primary_model,
 round(baseline_r2, 6) AS primary_baseline, round(r2 - baseline_r2, 6) AS lift, r2 > baseline_r2 + 1e-9 AS beats_baseline,
 row_number() OVER (ORDER BY r2 DESC, id) = 1 AS is_best FROM (
 SELECT 'size' AS id, 'linear' AS algo, 1 AS n_features, r2, baseline_r2, n_train, n_test FROM {_ols_sql("p_size")}
 UNION ALL SELECT 'size_key', 'linear', 2, r2, baseline_r2, n_train, n_test FROM {_ols_sql("p_size, p_partkey")})""",
)
def experiment_log(read):
    spark = read.spark
    path = scratch_path(spark, "experiments")
    for day, (name, features) in enumerate({"size": ["p_size"], "size_key": ["p_size", "p_partkey"]}.items(), 1):
        tracking.log_run(_price_model(read, features), path, "part", run_id=name, ts=f"2024-01-0{day}")
    runs = tracking.best_runs(tracking.read_runs(spark, path))
    shown = ["id", "algo", "n_features", "n_train", "n_test", "primary_model", "primary_baseline", "lift"]
    return rounded(runs.select(*shown, "beats_baseline", "is_best"), 6, "primary_model", "primary_baseline", "lift")


# One run per month, priority and status: a log that grows with the orders.
RUNS = """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') || o_orderpriority || o_orderstatus AS id,
 strftime(date_trunc('month', o_orderdate), '%Y-%m') AS ts, o_orderpriority AS "table", o_orderstatus AS target,
 floor(avg(o_totalprice) / 5000) / 20 AS primary_model, floor(min(o_totalprice) / 5000) / 20 AS primary_baseline,
 (count(*) % 7 - 5) / 20.0 AS worst_stress_delta FROM orders GROUP BY ALL"""


@query(
    "experiment_best",
    f"""SELECT id, ts, "table", target, round(primary_model - primary_baseline, 6) AS lift,
 row_number() OVER (PARTITION BY "table", target ORDER BY primary_model DESC, ts, id) = 1 AS is_best,
 coalesce(worst_stress_delta < -0.05 * greatest(0.0001, abs(primary_model)), false) AS fragile
 FROM (SELECT id, ts, "table", target, primary_model::DOUBLE AS primary_model, primary_baseline::DOUBLE
 AS primary_baseline, worst_stress_delta::DOUBLE AS worst_stress_delta FROM ({RUNS}))""",
)
def experiment_best(read):
    month = F.date_format("o_orderdate", "yyyy-MM")
    runs = (
        read("orders")
        .groupBy(month.alias("ts"), F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("target"))
        .agg(
            (F.floor(F.avg("o_totalprice") / 5000) / 20).alias("primary_model"),
            (F.floor(F.min("o_totalprice") / 5000) / 20).alias("primary_baseline"),
            ((F.count(F.lit(1)) % 7 - 5) / 20).alias("worst_stress_delta"),
        )
        .withColumn("id", F.concat("ts", "table", "target"))
    )
    best = tracking.best_runs(runs)
    return rounded(best.select("id", "ts", "table", "target", "lift", "is_best", "fragile"), 6, "lift")


AB_SRM_SQL = """(SELECT sum((n - e) ** 2 / e) > 16.266236 AS mismatch FROM
 (SELECT count(*) AS n, sum(count(*)) OVER () / count(*) OVER () AS e FROM documents JOIN labels USING (doc_id)
 GROUP BY lang))"""


@query(
    "ship_gate",
    f"""SELECT issues, unchecked, true AS has_checks, CASE WHEN issues = 1 THEN '1 issue' WHEN issues > 1
 THEN issues::VARCHAR || ' issues' WHEN unchecked > 0 THEN 'Checking…' ELSE 'Ship-ready' END AS label FROM (
 SELECT ((SELECT sum(failed + errored) FROM ({summary_sql()}))
 + (SELECT count(*) FILTER (WHERE mismatch) FROM {AB_SRM_SQL})
 + (SELECT count(*) FILTER (WHERE overall = 'drift') FROM ({ROLLUP_SQL}))
 + (SELECT count(*) FILTER (WHERE NOT better) FROM (SELECT avg((lang = {GUESS})::INTEGER) > max(share) AS better
 FROM documents, (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM documents GROUP BY lang)))))::BIGINT
 AS issues, 1::BIGINT AS unchecked)""",
)
def ship_gate(read):
    contracts = summarize(all_results(read)).select("failed", "errored")
    unchecked = read.spark.range(1).select(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    ab = abtest.ab_srm(abtest.ab_variants(labelled(read), "lang", "quality", "en"))
    base, cur = order_sides(read)
    rolled = drift.drift_verdict(base, cur)
    guesses = _guesses(read)
    common = guesses.groupBy("label").count().orderBy(F.col("count").desc(), "label").first().label
    scores = guesses.agg(
        (F.avg((F.col("label") == F.col("prediction")).cast("double"))
         > F.avg((F.col("label") == F.lit(common)).cast("double"))).alias("beats_baseline")
    )
    return tracking.ship_gate(contracts.unionAll(unchecked), scores, ab, rolled)


@query(
    "ship_gate_trained",
    f"""SELECT issues, unchecked, true AS has_checks, CASE WHEN issues = 1 THEN '1 issue' WHEN issues > 1
 THEN issues::VARCHAR || ' issues' WHEN unchecked > 0 THEN 'Checking…' ELSE 'Ship-ready' END AS label FROM (
 SELECT ((SELECT sum(failed + errored) FROM ({summary_sql()}) WHERE "table" = 'nation')
 + (SELECT count(*) FILTER (WHERE NOT r2 > baseline_r2 + 1e-9) FROM {_ols_sql("p_size, p_partkey")}))::BIGINT AS issues,
 1::BIGINT AS unchecked)""",
)
def ship_gate_trained(read):
    """A contract that was checked, one that was not yet, and a model trained here."""
    checked = summarize(all_results(read).where(F.col("table") == "nation"))
    states = tracking.contract_states(["nation", "part"], checked, read.spark)
    found = _price_model(read, ["p_size", "p_partkey"])
    models = read.spark.createDataFrame([(found["beats_baseline"],)], "beats_baseline boolean")
    return tracking.ship_gate(states, models)
