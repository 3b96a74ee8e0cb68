"""Train a model, grade it against a trivial baseline, and shake its inputs.

Screening, encoding and splitting are column expressions; fitting uses
``pyspark.ml``.  The held-out rows are given a dense index once, which makes
every perturbation a function of (seed, row, slot): repeatable whatever the
partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    DATETIME,
    NUMERIC,
    as_double,
    as_text,
    col,
    kind_of,
    split_bucket,
    unit_hash,
)
from plumbline.operators.indexing import dense_index, free_name
from plumbline.operators.metrics import (
    as_dict,
    classification_metrics,
    confusion,
    regression_columns,
    regression_metrics,
)
from plumbline.operators.profile import guarded_correlation
from plumbline.plans.aggregates import count_distinct, long_text, melt, one_row, text_length
from plumbline.plans.durable import materialise, scratch_path
from plumbline.plans.quantiles import quantiles
from plumbline.plans.ranking import top_by_count

CLASSIFICATION, REGRESSION = "classification", "regression"

# Share held out, trees per forest, iterations, thresholds.
TEST_PERCENT = 25
TREES = 120
LINEAR_ITERATIONS = 1000
MIN_ROWS = 10
LEAKY_CORRELATION = 0.98
ID_LIKE_SHARE = 0.95
NOISE_SHARE = 0.1
ZEROED_SHARE = 0.10
TOP_IMPORTANCES = 8
GATE_MARGIN = 1e-9

# Levels of a column, or classes, whose table is broadcast; more meet their rows in a shuffle.
BROADCAST_LEVELS = 100_000
# Classes that a model may tell apart: what it keeps per node or slot grows with them.
MAX_CLASSES = 10_000

NULL_LEVEL, OTHER_LEVEL = "__null__", "__other__"
LABEL, FEATURES, INDEX = "label", "features", "row_index"


def prepare(
    df: DataFrame, target: str, features: list[str] | None = None, keep: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Rows with a target, and the usable feature names.

    ``keep`` names columns to carry along that are not features.
    """
    if target not in df.columns:
        raise ValueError(f"target column not found: {target}")
    same = target.lower()
    if features:
        kept = [f for f in features if f in df.columns and f.lower() != same]
    else:
        kept = [c for c in df.columns if c.lower() != same]
    if not kept:
        raise ValueError("no feature columns selected")
    carried = [c for c in keep or [] if c not in kept and c != target]
    rows = df.where(col(target).isNotNull()).select(*[col(c) for c in [*kept, target, *carried]])
    if len(rows.limit(MIN_ROWS).collect()) < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} non-null target rows to train")
    return rows, kept


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """(n, distinct, task): regression only for numeric targets of many values."""
    counts = df.where(col(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(col(target)).alias("distinct")
    )
    numeric = kind_of(df.schema[target].dataType) == NUMERIC
    cap = F.greatest(F.lit(2), F.least(F.lit(20), F.floor(F.col("n") * F.lit(0.05)).cast("int")))
    many = F.lit(numeric) & (F.col("distinct") > cap)
    return counts.withColumn("task", F.when(many, REGRESSION).otherwise(CLASSIFICATION))


def _numeric_form(df: DataFrame, name: str) -> Column | None:
    """The column as a double, if it is a number or a point in time."""
    kind = kind_of(df.schema[name].dataType)
    if kind == NUMERIC:
        return as_double(name)
    if kind == DATETIME and df.schema[name].dataType.typeName() != "time":
        return F.unix_micros(col(name).cast("timestamp")).cast("double") / F.lit(1e6)
    return None


def leakage(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """(feature, reason) for features that give the target away or say nothing."""
    requested = features or [c for c in df.columns if c != target]
    reasons = [(f, "is the target itself") for f in requested if f != target and f.lower() == target.lower()]
    rows = df.where(col(target).isNotNull())
    names = [f for f in requested if f in df.columns and f.lower() != target.lower()]
    numeric = [f for f in names if kind_of(df.schema[f].dataType) == NUMERIC]
    target_numeric = kind_of(df.schema[target].dataType) == NUMERIC
    correlated = numeric if target_numeric else []
    lengths = {k: e for f in names for k, e in text_length(df, f).items()}
    seen = one_row(rows, {"n": F.count(F.lit(1))} | lengths)
    distinct = count_distinct(rows, names, long_text=long_text(seen))
    median = {f: v[0] for f, v in quantiles(rows, correlated, [0.5], {f: distinct[f] for f in correlated}).items()}
    r = one_row(
        rows,
        {
            f: guarded_correlation(F.coalesce(as_double(f), F.lit(median[f])), as_double(target))
            for f in correlated
            if median[f] is not None
        },
    )
    for f in names:
        if distinct[f] <= 1:
            reasons.append((f, "has one value only"))
        if abs(r.get(f, 0.0)) > LEAKY_CORRELATION:
            reasons.append((f, f"correlation {r[f]:.3f} with the target"))
        if seen["n"] > 20 and distinct[f] >= ID_LIKE_SHARE * seen["n"]:
            reasons.append((f, "tells nearly every row apart"))
    return df.sparkSession.createDataFrame(reasons, "feature string, reason string")


@dataclass
class Encoder:
    """Column recipe fitted on a table: medians, and a table of category levels with their slots.

    Slots are numbered densely: numbers and times first, then the levels of each text column
    in order of their value, then its slot for all others if it has one.  The driver knows
    how many levels a column has, not which.
    """

    spark: SparkSession
    medians: dict[str, float]
    categories: list[str]
    table: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)
    has_other: set[str] = field(default_factory=set)

    @property
    def n_slots(self) -> int:
        return len(self.medians) + sum(self.counts.values())

    def _first_slot(self, name: str) -> int:
        before = self.categories[: self.categories.index(name)]
        return len(self.medians) + sum(self.counts[c] for c in before)

    def slot_names(self, slots: list[int]) -> dict[int, str]:
        """The names of a few slots."""
        names = dict(enumerate(self.medians))
        wanted = sorted({s for s in slots if s not in names})
        if wanted:
            for row in self.table.where(F.col("slot").isin(wanted)).collect():
                names[row.slot] = f"{self.categories[row.column_id]}_{row.value}"
        return {s: names[s] for s in slots}

    def slot_table(self) -> DataFrame:
        """(slot, feature) of every slot."""
        numbers = self.spark.createDataFrame(list(enumerate(self.medians)), "slot bigint, feature string")
        if self.table is None:
            return numbers
        column = F.element_at(F.array(*[F.lit(c) for c in self.categories]), F.col("column_id") + 1)
        return numbers.unionByName(self.table.select("slot", F.concat(column, F.lit("_"), "value").alias("feature")))

    @property
    def slots(self) -> list[str]:
        """All names in order, collected: for encoders of few levels."""
        return [r.feature for r in self.slot_table().orderBy("slot").collect()]

    @property
    def levels(self) -> dict[str, list[str]]:
        """All levels, collected: for encoders of few levels."""
        found: dict[str, list[str]] = {c: [] for c in self.categories}
        if self.table is not None:
            for row in self.table.where("NOT other").orderBy("slot").collect():
                found[self.categories[row.column_id]].append(row.value)
        return found

    def encode(self, df: DataFrame, kept: list[Column] | None = None) -> DataFrame:
        """The ``features`` vector: filled numbers, then a one in the slot of each level.

        It stands next to ``kept`` (all columns but one called so by default).  The result is
        written once: models read it many times, and what is stored as the parts of a
        sparse vector is read back as one.
        """
        parts = self.parts(df, kept)
        path = scratch_path(df.sparkSession, "encoded")
        parts.write.parquet(path)
        named = [T.StructField(f.name, f.dataType, True, f.metadata) for f in parts.schema.fields[:-1]]
        schema = T.StructType([*named, T.StructField(FEATURES, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)

    def parts(self, df: DataFrame, kept: list[Column] | None = None) -> DataFrame:
        """As ``encode``, with the type, size, indices and values of each vector.

        Rows meet the levels of each text column in a join, which is broadcast where that
        column has few.
        """
        kept = [col(c) for c in df.columns if c.lower() != FEATURES] if kept is None else kept
        numbers = [F.coalesce(_numeric_form(df, n), F.lit(m), F.lit(0.0)) for n, m in self.medians.items()]
        texts = [F.coalesce(as_text(df, name), F.lit(NULL_LEVEL)) for name in self.categories]
        wide = df.select(
            F.struct(*kept).alias("kept") if kept else F.lit(None).alias("kept"),
            F.array(*numbers).cast("array<double>").alias("numbers"),
            *[v.alias(f"text{i}") for i, v in enumerate(texts)],
        )
        for i, name in enumerate(self.categories):
            levels = self.table.where((F.col("column_id") == i) & ~F.col("other"))
            levels = levels.select(F.col("value").alias(f"value{i}"), F.col("slot").cast("int").alias(f"slot{i}"))
            if self.counts[name] <= BROADCAST_LEVELS:
                levels = F.broadcast(levels)
            rest = F.lit(self._first_slot(name) + self.counts[name] - 1)
            if name not in self.has_other:
                rest = F.raise_error(F.concat(F.lit(f"{name} has a level that the encoder has not seen: "), F.col(f"text{i}"))).cast("int")
            wide = wide.join(levels, F.col(f"text{i}") == F.col(f"value{i}"), "left")
            wide = wide.withColumn(f"slot{i}", F.coalesce(f"slot{i}", rest)).drop(f"text{i}", f"value{i}")
        n, null = len(self.medians), F.lit(None)
        if self.categories:
            own = F.array(*[F.lit(i) for i in range(n)], *[F.col(f"slot{i}") for i in range(len(self.categories))])
            values = F.concat("numbers", F.array(*[F.lit(1.0) for _ in self.categories]))
            kind, size, indices = 0, F.lit(self.n_slots), own.cast("array<int>")
        else:
            kind, size, indices, values = 1, null.cast("int"), null.cast("array<int>"), F.col("numbers")
        vector = F.struct(F.lit(kind).cast("tinyint").alias("type"), size.alias("size"), indices.alias("indices"), values.alias("values"))
        named = df.select(*kept).schema.fields if kept else []
        return wide.select(
            *[F.col("kept").getField(f.name).alias(f.name, metadata=f.metadata) for f in named], vector.alias(FEATURES)
        )


def fit_encoder(df: DataFrame, features: list[str], max_levels: int | None = None) -> Encoder:
    """Medians of numbers and times; all levels of the rest, one slot each.

    Only on request levels beyond the ``max_levels`` most frequent share a slot.
    """
    numeric = [f for f in features if _numeric_form(df, f) is not None]
    other = [f for f in features if f not in numeric]
    numbers = df.select(*[_numeric_form(df, f).alias(f) for f in numeric])
    medians = {f: v[0] if v[0] is not None else 0.0 for f, v in quantiles(numbers, numeric, [0.5]).items()}
    if not other:
        return Encoder(df.sparkSession, medians, other)
    cells = melt(df, {f: F.coalesce(as_text(df, f), F.lit(NULL_LEVEL)) for f in other})
    if max_levels is None:
        levels = cells.select("column_id", F.lit(False).alias("other"), "value").distinct()
    else:
        counts = cells.groupBy(F.col("column_id").alias("column"), "value").agg(F.count(F.lit(1)).alias("count"))
        ranked, beyond = top_by_count(counts, max_levels + 1), F.col("rank") > max_levels
        value = F.when(beyond, OTHER_LEVEL).otherwise(F.col("value"))
        levels = ranked.select(F.col("column").alias("column_id"), beyond.alias("other"), value.alias("value"))
    indexed = dense_index(levels, ["column_id", "other", "value"], "place")
    table = materialise(indexed.select("column_id", "other", "value", (F.col("place") + len(medians)).alias("slot")), "levels")
    found = table.groupBy("column_id").agg(F.count(F.lit(1)).alias("n"), F.max("other").alias("other")).collect()
    counted = dict.fromkeys(other, 0) | {other[r.column_id]: r.n for r in found}
    return Encoder(df.sparkSession, medians, other, table, counted, {other[r.column_id] for r in found if r.other})


def split(
    df: DataFrame, seed: int = 42, keys: list[str] | None = None, stratify: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """75/25 split by a hash of (seed, keys): no shuffle, stable, copies together.

    With ``stratify``, a class that the hash puts on one side entirely moves its
    row with the smallest hash (and copies of it) to the other.
    """
    flagged = with_test_flag(df, seed, keys, stratify)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def with_test_flag(
    df: DataFrame, seed: int = 42, keys: list[str] | None = None, stratify: str | None = None
) -> DataFrame:
    parts = [as_text(df, k) for k in keys or df.columns]
    by_hash = split_bucket(seed, *parts) < TEST_PERCENT
    if stratify is None:
        return df.withColumn("is_test", by_hash)
    # Classes with rows on one side only are known from counts; what is joined is the key of the
    # row that moves, which is as good as unique, never the class.
    row = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    tests = F.count_if(by_hash)
    sides = df.groupBy(col(stratify)).agg(
        F.count(F.lit(1)).alias("n"), tests.alias("tests"), F.min(row).alias("first"), F.max(row).alias("last")
    )
    lonely = sides.where("n > 1 AND (tests = 0 OR tests = n) AND first <> last")
    moved = lonely.select(F.col("first").alias("__row")).distinct()
    names = [col(c) for c in df.columns]
    flagged = df.select(*names, row.alias("__key"), by_hash.alias("__hash")).join(moved, F.col("__key") == F.col("__row"), "left")
    return flagged.select(*names, (F.col("__hash") != F.col("__row").isNotNull()).alias("is_test"))


def baseline_prediction(train: DataFrame, task: str) -> object:
    """Most frequent training class (smallest on ties), or the training mean."""
    if task == REGRESSION:
        return train.agg(F.avg(LABEL)).first()[0]
    counts = train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), LABEL).first()[LABEL]


def _estimator(task: str, algo: str, seed: int, max_depth: int, trees: int, rows: int):
    """The logistic penalty has unit weight against the summed loss of all rows."""
    if algo not in ("linear", "tree", "forest"):
        raise ValueError(f"unknown algorithm: {algo}")
    columns = {"featuresCol": FEATURES, "labelCol": LABEL}
    if task == CLASSIFICATION:
        if algo == "linear":
            return C.LogisticRegression(
                maxIter=LINEAR_ITERATIONS, regParam=1.0 / rows, standardization=False, **columns
            )
        if algo == "tree":
            return C.DecisionTreeClassifier(seed=seed, maxDepth=max_depth, **columns)
        return C.RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=max_depth, **columns)
    if algo == "linear":
        return R.LinearRegression(**columns)
    if algo == "tree":
        return R.DecisionTreeRegressor(seed=seed, maxDepth=max_depth, **columns)
    return R.RandomForestRegressor(
        numTrees=trees, seed=seed, maxDepth=max_depth, featureSubsetStrategy="all", **columns
    )


def importances(model: Model, encoder: Encoder, k: int | None = TOP_IMPORTANCES) -> tuple[DataFrame, int | None]:
    """(feature, value) of the largest impurity importances, or absolute coefficients of the first class, and the top slot.

    All with ``k=None``.
    """
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()[0])
    else:
        weights = abs(model.coefficients.toArray())
    ranked = sorted(enumerate(weights.tolist()), key=lambda pair: (-pair[1], pair[0]))[:k]
    spark = encoder.spark
    if k is None:
        values = spark.createDataFrame([(i, w, place) for place, (i, w) in enumerate(ranked)], "slot bigint, value double, place int")
        table = encoder.slot_table().join(values, "slot").orderBy("place").select("feature", "value")
    else:
        names = encoder.slot_names([i for i, _ in ranked])
        table = spark.createDataFrame([(names[i], w) for i, w in ranked], "feature string, value double")
    return table, ranked[0][0] if ranked else None


def class_table(rows: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> tuple[DataFrame, int]:
    """(class, number) of the classes of a target in order of their text, and how many there are."""
    names = rows.select(as_text(rows, target).alias("class")).distinct()
    classes = materialise(dense_index(names, ["class"], "number"), "classes")
    n = classes.count()
    if n > max_classes:
        raise ValueError(f"{target} has {n} classes, more than max_classes ({max_classes})")
    return classes, n


def with_label(rows: DataFrame, target: str, classes: DataFrame, n: int, name: str) -> DataFrame:
    """Add the number of a row's class, marked as one of ``n``.  At most ``max_classes`` rows are broadcast."""
    known = F.broadcast(classes.select(F.col("class").alias("__class"), F.col("number").cast("double").alias("__number")))
    marked = {"ml_attr": {"type": "nominal", "name": LABEL, "num_vals": n}}
    met = rows.join(known, as_text(rows, target) == F.col("__class"))
    return met.select(*[col(c) for c in rows.columns], F.col("__number").alias(name, metadata=marked))


def with_class_names(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """A confusion matrix of class numbers with their names."""
    for side in ("actual", "predicted"):
        names = F.broadcast(classes.select(F.col("class").alias(f"__{side}"), F.col("number").cast("double").alias(f"__n_{side}")))
        matrix = matrix.join(names, F.col(side) == F.col(f"__n_{side}"))
    return matrix.select(F.col("__actual").alias("actual"), F.col("__predicted").alias("predicted"), "count")


def _primary(scored: DataFrame, task: str) -> float:
    """Accuracy or r2 of a scored table, in one job."""
    if task == CLASSIFICATION:
        return scored.agg(F.avg((F.col(LABEL) == F.col("prediction")).cast("double"))).first()[0]
    return scored.agg(regression_columns(F.col(LABEL), F.col("prediction"))["r2"]).first()[0]


def perturb(test: DataFrame, slots: int, seed: int, top: int | None) -> dict[str, DataFrame]:
    """Damaged copies of the encoded test rows (``row_index``, label, features).

    Noise is Gaussian with a tenth of each slot's deviation; a tenth of the
    values are zeroed; the top slot is permuted across rows.  All draws are
    hashes of (seed, row, slot).
    """
    deviation = test.agg(Summarizer.std(F.col(FEATURES))).first()[0].toArray()
    scale = F.array(*[F.lit(NOISE_SHARE * (float(d) if d > 0 else 1.0)) for d in deviation])
    values = vector_to_array(F.col(FEATURES))
    row = F.col(INDEX)

    def gauss(slot: Column) -> Column:
        radius = F.sqrt(-2 * F.ln(unit_hash(F.lit(seed), F.lit("radius"), row, slot)))
        return radius * F.cos(2 * math.pi * unit_hash(F.lit(seed), F.lit("angle"), row, slot))

    def noisy(value: Column, slot: Column) -> Column:
        return value + gauss(slot) * F.element_at(scale, slot + F.lit(1))

    def zeroed(value: Column, slot: Column) -> Column:
        return F.when(unit_hash(F.lit(seed), F.lit("zero"), row, slot) < ZEROED_SHARE, 0.0).otherwise(value)

    copies = {
        "noise": test.withColumn(FEATURES, array_to_vector(F.transform(values, noisy))),
        "zeroed": test.withColumn(FEATURES, array_to_vector(F.transform(values, zeroed))),
    }
    if top is not None:
        # A random order of the rows, indexed densely, pairs every row with
        # another row's value.
        drawn = test.select(
            unit_hash(F.lit(seed), F.lit("shuffle"), row, F.lit(0)).alias("draw"),
            row.alias("source"),
            values[top].alias("moved"),
        )
        moved = dense_index(drawn, ["draw", "source"]).select(INDEX, "moved")
        swapped = F.transform(values, lambda v, i: F.when(i == top, F.col("moved")).otherwise(v))
        copies["shuffled"] = test.join(moved, INDEX).withColumn(FEATURES, array_to_vector(swapped)).drop("moved")
    return copies


def train(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    algo: str = "forest",
    seed: int = 42,
    max_depth: int = 10,
    trees: int = TREES,
    max_levels: int | None = None,
    split_keys: list[str] | None = None,
    top_importances: int | None = TOP_IMPORTANCES,
    max_classes: int = MAX_CLASSES,
) -> dict:
    """Fit, grade and stress one model; small results come back as DataFrames.

    A target of more than ``max_classes`` classes is an error: what models keep grows with them.
    """
    spark = df.sparkSession
    leaks = leakage(df, target, features)
    rows, names = prepare(df, target, features, split_keys)
    task = detect_task(rows, target).first().task
    classes, n_classes = class_table(rows, target, max_classes) if task == CLASSIFICATION else (None, 0)
    encoder = fit_encoder(rows, names, max_levels)
    train_raw, test_raw = split(rows, seed, split_keys, target if task == CLASSIFICATION else None)
    # The test rows are scored several times, so they are indexed and written once.
    test_rows = dense_index(test_raw)
    index = test_rows.columns[-1]

    def encoded(side: DataFrame, *more: Column) -> DataFrame:
        """Label and vector, apart from the given columns, which may be called the same."""
        if task != CLASSIFICATION:
            return encoder.encode(side, [*more, as_double(target).alias(LABEL)])
        name = free_name(side, "__label")
        side = with_label(side, target, classes, n_classes, name)
        return encoder.encode(side, [*more, col(name).alias(LABEL, metadata=side.schema[name].metadata)])

    encoded_train = encoded(train_raw)
    encoded_test = encoded(test_rows, col(index).alias(INDEX))
    n_train, n_test = train_raw.count(), test_rows.count()
    if not n_train or not n_test:
        raise ValueError("the split left one side empty; pass other split_keys")

    model = _estimator(task, algo, seed, max_depth, trees, n_train).fit(encoded_train)
    scored = model.transform(encoded_test).select(INDEX, LABEL, "prediction")
    guess = baseline_prediction(encoded_train, task)
    guessed = encoded_test.select(LABEL, F.lit(guess).alias("prediction"))
    if task == CLASSIFICATION:
        primary_name = "accuracy"
        # Scores only need the few outcome counts; classes get their names back there.
        metrics = as_dict(classification_metrics(scored))
        baseline = {"accuracy": _primary(guessed, task)}
        matrix = with_class_names(confusion(scored), classes)
    else:
        primary_name = "R2"
        metrics = as_dict(regression_metrics(scored))
        against = as_dict(regression_metrics(guessed))
        baseline = {"r2": against["r2"], "mae": against["mae"]}
        matrix = None
    ranked, top = importances(model, encoder, top_importances)
    clean = metrics[primary_name.lower()]
    titles = {
        "noise": "noise of a tenth of the deviation",
        "zeroed": "a tenth of the values zeroed",
        "shuffled": f"{encoder.slot_names([top])[top]} permuted" if top is not None else "",
    }
    stress = [
        (titles[key], _primary(model.transform(copy), task), clean)
        for key, copy in perturb(encoded_test, encoder.n_slots, seed, top).items()
    ]
    return {
        "task": task,
        "algo": algo,
        "target": target,
        "seed": seed,
        "features": names,
        "model": model,
        "encoder": encoder,
        "predictions": scored,
        "metrics": metrics,
        "baseline": baseline,
        "primary": {"name": primary_name, "model": clean, "baseline": baseline[primary_name.lower()]},
        "beats_baseline": clean > baseline[primary_name.lower()] + GATE_MARGIN,
        "confusion": matrix,
        "importances": ranked,
        "leakage": leaks,
        "stress": spark.createDataFrame(stress, "name string, metric double, clean double"),
        "n_train": n_train,
        "n_test": n_test,
        "n_features": encoder.n_slots,
    }


def model_table(result: dict) -> DataFrame:
    """The scalar results of ``train`` as (metric, value) rows."""
    values = result["metrics"] | {f"baseline_{k}": v for k, v in result["baseline"].items()}
    values |= {k: float(result[k]) for k in ("n_train", "n_test", "n_features", "beats_baseline")}
    return result["importances"].sparkSession.createDataFrame(list(values.items()), "metric string, value double")
