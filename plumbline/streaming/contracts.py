"""Re-check a contract on every micro-batch of a stream.

All rules of a contract are one streaming aggregation.  Each row becomes one cell for the
batch it came with, which counts violations, and two for every uniqueness rule: its key
for all time, and its key for this batch.  Update mode returns the keys of the batch with
both counts, so a batch costs its own rows and keys, however many batches came before.
Keys are held in a RocksDB state store, sharded by key, next to the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.columns import as_text, col
from plumbline.operators.contracts import (
    RESULT_SCHEMA,
    Rule,
    describe,
    is_local,
    reads_text,
    static_error,
    violation,
)

STREAM_SCHEMA = RESULT_SCHEMA + ", batch_id bigint"

#: How long the counts of single batches outlive them; clocks of a restarted driver may differ by this.
KEPT = "1 hour"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Batches without rows would only tidy up, which the next one does too.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def contract_stream(
    stream: DataFrame,
    table: str,
    rules: list[Rule],
    results: str,
    checkpoint: str,
    once: bool = False,
    partitions: int | None = None,
) -> StreamingQuery:
    """Append one result row per rule and batch to the parquet folder ``results``.

    A row breaks a uniqueness rule if another row with its key came in this or any earlier
    batch.  Null keys break none.  Each batch owns one sub-folder and overwrites it, and the
    state goes back to where the batch began, so a batch that is replayed after a failure is
    not counted twice.  A batch without rows writes nothing.  A rule that cannot be evaluated
    has ``failing_rows = -1`` and a message.  The rules of one checkpoint must keep their ids.

    ``partitions`` is the number of state stores, which a checkpoint keeps for good (by
    default ``spark.sql.shuffle.partitions``): choose it for the keys that are to come.
    """
    errors = {r.id: static_error(stream, r) for r in rules}
    sound = [r for r in rules if errors[r.id] is None]

    def check(batch: DataFrame, batch_id: int) -> None:
        found = {r.rule: r for r in per_rule(batch, len(sound)).collect()}
        if None not in found:
            return
        rows = [_result(table, r, errors[r.id], sound, found) for r in rules]
        checked = batch.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
        checked = checked.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        checked.coalesce(1).write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    writer = counts(stream, sound).writeStream.outputMode("update").foreachBatch(check)
    writer = writer.option("checkpointLocation", checkpoint)
    wanted = STATE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    with settings(stream.sparkSession, wanted):
        return (writer.trigger(availableNow=True) if once else writer).start()


def counts(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """Streaming counts of ``rule, key, at``: the batch as a whole has no rule, a key of all time has no ``at``."""
    now, none = F.current_timestamp(), F.lit(None)
    cells = [F.struct(none.cast("string").alias("rule"), none.cast("string").alias("key"), now.alias("at"))]
    flags = {}
    for i, rule in enumerate(rules):
        if rule.type == "unique":
            key = F.sha2(as_text(stream, rule.column), 256)
            for at in (now, none.cast("timestamp")):
                cells.append(F.struct(F.lit(rule.id).alias("rule"), key.alias("key"), at.alias("at")))
        elif is_local(rule):
            flags[f"failing{i}"] = violation(stream, rule)
            if reads_text(stream, rule):
                value = col(rule.column)
                flags[f"unread{i}"] = value.isNotNull() & value.try_cast("double").isNull()
    wide = stream.select(F.array(*cells).alias("cells"), *[v.alias(n) for n, v in flags.items()])
    needed = F.filter("cells", lambda c: c["rule"].isNull() | c["key"].isNotNull())
    rows = wide.select(F.inline(needed), *flags)
    sums = [F.count_if(F.col("rule").isNull() & F.col(name)).alias(name) for name in flags]
    grouped = rows.withWatermark("at", KEPT).groupBy("rule", "key", "at").agg(F.count(F.lit(1)).alias("n"), *sums)
    missing = {name: F.lit(0).cast("bigint") for name in _names(len(rules)) if name not in flags}
    return grouped.withColumns(missing) if missing else grouped


def _names(n: int) -> list[str]:
    return [name for i in range(n) for name in (f"failing{i}", f"unread{i}")]


def per_rule(batch: DataFrame, n_rules: int) -> DataFrame:
    """Of one batch, in one job: its rows and flags (no rule), and for each rule its rows with a key seen before."""
    whole, own = F.max(F.when(F.col("at").isNull(), F.col("n"))), F.max(F.when(F.col("at").isNotNull(), F.col("n")))
    flags = [F.max(c).alias(c) for c in _names(n_rules)]
    keys = batch.groupBy("rule", "key").agg(whole.alias("whole"), own.alias("own"), *flags)
    repeated = F.sum(F.when(F.col("whole") > 1, F.col("own")).otherwise(0))
    return keys.groupBy("rule").agg(F.sum("own").alias("rows"), repeated.alias("repeated"), *[F.max(c).alias(c) for c in _names(n_rules)])


def _result(table: str, rule: Rule, error: str | None, sound: list[Rule], found: dict) -> tuple:
    """A result row of ``rule``, with the columns of a contract."""
    batch = found[None]
    failing, detail = -1, error
    if error is None and rule.type == "unique":
        # No row with a key has come yet, or none in this batch.
        failing = found[rule.id].repeated if rule.id in found else 0
    elif error is None and rule.type == "row_count":
        low = rule.min is not None and batch.rows < rule.min
        failing = int(low or (rule.max is not None and batch.rows > rule.max))
        detail = f"{batch.rows} rows"
    elif error is None:
        place = sound.index(rule)
        failing, unread = batch[f"failing{place}"], batch[f"unread{place}"]
        if unread:
            failing, detail = -1, f"{unread} values of {rule.column} are not numbers"
    return (table, rule.id, rule.type, rule.column, failing == 0, failing, batch.rows, detail, describe(rule))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that a streaming query takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_results(spark, results: str) -> DataFrame:
    return spark.read.schema(STREAM_SCHEMA).parquet(results).drop("batch")
