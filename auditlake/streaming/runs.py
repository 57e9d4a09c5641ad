"""Incremental jobs on Structured Streaming: resume, run state, deltas of growing text.

Each runs with the available-now trigger, so one call handles what is new and ends.
Results go to tables in files, never to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a parquet table, be it a folder or one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if fs.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A result table; empty while nothing was written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


#: Parts of the index of processed keys.
KEY_BUCKETS = 64


def _batches(spark: SparkSession, path: str) -> set[str]:
    """Names of the batch folders of a result table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return {n.removeprefix("batch=") for n in names if n.startswith("batch=")}


def processed_keys(spark: SparkSession, out: str, key: str, buckets: list[int], but: str) -> DataFrame | None:
    """Keys in ``out`` of some buckets, other than those of one batch; None where there are none.

    They come from the index beside the table, a narrow table of keys in which only these buckets
    are read. Batches that the index lacks, as of an older run, are read from the table itself.
    """
    listed, written = _batches(spark, f"{out}_keys"), _batches(spark, out)
    found = []
    if listed - {but}:
        rows = spark.read.option("basePath", f"{out}_keys").parquet(*[f"{out}_keys/batch={n}" for n in sorted(listed - {but})])
        found.append(rows.filter(F.col("bucket").isin(buckets)).select(key))
    if written - listed - {but}:
        rows = spark.read.parquet(*[f"{out}/batch={n}" for n in sorted(written - listed - {but})])
        found.append(rows.select(key))
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def process_new(source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run ``work`` once per unseen key and append its rows to ``out``.

    A key counts as processed once a row of it is in ``out``, whatever run wrote it; ``work``
    keeps the key column. Each batch of a checkpoint writes its own folder, so a batch that is
    run again after a failure replaces what it wrote before, and a new checkpoint adds to what
    is there. Of rows with the same key the one with the smallest hash is taken. Keys are kept once
    more in ``out`` + ``_keys``, by bucket: a batch reads those of its own buckets, not the results.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        spark, name = rows.sparkSession, f"{run}-{number}"
        whole = F.struct(F.xxhash64(*rows.columns), *rows.columns)
        fresh = rows.groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_row")).select("_row.*").select(*rows.columns)
        bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
        buckets = sorted(r["bucket"] for r in rows.select(bucket).distinct().collect())  # at most KEY_BUCKETS
        done = processed_keys(spark, out, key, buckets, name)
        if done is not None:
            fresh = fresh.join(done, key, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{out}/batch={name}")
        kept = spark.read.parquet(f"{out}/batch={name}").select(key).distinct().select(key, bucket)
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}_keys/batch={name}")

    _finish(source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))


def _merged(parts: DataFrame) -> DataFrame:
    """Counts of parts added up; the last value is that of the latest time, the largest of equals."""
    whole = parts.groupBy("run_id", "event", "window_start").agg(F.sum("n").alias("n"), F.max(F.struct("last_ts", "last_score")).alias("l"))
    return whole.select("run_id", "event", "window_start", "n", "l.last_ts", "l.last_score")


def event_counts(
    events: DataFrame, run: str, event: str, ts: str, out: str, checkpoint: str, window: str = "1 day"
) -> DataFrame:
    """Counts and last value per run, event and time window, kept up to date.

    ``events`` is a stream with a ``score`` column. A batch adds its own counts to the table, where those of
    a window add up: nothing is held between batches, no window is ever closed, and an event counts
    however late it comes. A batch that is run again replaces what it wrote. Batches of other
    checkpoints count as well, so each event must reach one checkpoint only.
    """
    plain = dict(events.dtypes)[ts] == "timestamp_ntz"
    # A time without zone counts as UTC, whatever the session's zone.
    time = F.to_timestamp(F.concat(F.col(ts).cast("string"), F.lit("Z"))) if plain else F.col(ts)
    single = events.select(
        F.col(run).alias("run_id"), F.col(event).alias("event"), F.window(time, window)["start"].alias("window_start"),
        F.lit(1).cast("bigint").alias("n"), time.alias("last_ts"), F.col("score").alias("last_score"),
    )
    schema, name = single.schema, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        _merged(rows).write.mode("overwrite").parquet(f"{out}/batch={name}-{number}")

    _finish(single.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))
    return _merged(_table(events.sparkSession, out, schema)).drop("last_ts")


#: A key that expires is idle for a day.
IDLE_MS = 86_400_000
# Fixed value: a prime modulo which a text, as a number, stands for itself.
_PRIME = (1 << 127) - 1


def _joined(length: int, mark: int, more: bytes) -> tuple[int, int]:
    """Length and mark of a text with more bytes at its end; the mark is the text as a number modulo a prime."""
    return length + len(more), (mark * pow(256, len(more), _PRIME) + int.from_bytes(more, "big")) % _PRIME


def _taken(length: int, mark: int, text: str) -> tuple[int, int, str]:
    """Length and mark after a snapshot, and what it adds: its end if it goes on from the text so far, else all of it."""
    raw = text.encode("utf-8")
    grows = len(raw) >= length and _joined(0, 0, raw[:length])[1] == mark
    delta = raw[length:] if grows else raw
    return *_joined(length, mark, delta), delta.decode("utf-8")


def _new_text(key: str, seqs: list[int], deltas: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a key; none is no frame at all, as making and sending an empty one costs as much as the rest of the key."""
    if seqs:
        yield pd.DataFrame({"key": [key] * len(seqs), "seq": seqs, "delta": deltas})


def _deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    length, mark = (state.get[0], int(state.get[1])) if state.exists else (0, 0)
    new = pd.concat(list(batches)).sort_values("seq")
    seqs, deltas = [], []
    for seq, text in zip(new["seq"], new["text"]):
        length, mark, delta = _taken(length, mark, text)
        if delta:
            seqs.append(seq)
            deltas.append(delta)
    state.update((length, str(mark)))
    yield from _new_text(key[0], seqs, deltas)


def _deltas_expiring(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _deltas(key, batches, state)
    if state.exists:
        state.setTimeoutDuration(IDLE_MS)


def text_delta_stream(snapshots: DataFrame, key: str, seq: str, text: str, expire: bool = False) -> DataFrame:
    """Stream of new text per key; the state is the length and a 127-bit mark of the text emitted so far.

    Within a micro-batch a key's new snapshots are put in order of ``seq``; the source's
    files-per-trigger or bytes-per-trigger option bounds how many those are. With ``expire``
    a key without snapshots for ``IDLE_MS`` is forgotten, and what still comes counts as new.
    """
    rows = snapshots.select(
        F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("text")
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(
        _deltas_expiring if expire else _deltas, "key string, seq bigint, delta string", "length bigint, mark string", "append", timeout
    )


def _deltas_in_order(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Snapshots wait until the watermark has passed their time, then they are taken in the order of ``seq``."""
    length, mark, held = (state.get[0], int(state.get[1]), json.loads(state.get[2])) if state.exists else (0, 0, [])
    if not state.hasTimedOut:
        for batch in batches:
            held += [[int(s), int(t), x] for s, t, x in zip(batch["seq"], batch["at"], batch["text"])]
    passed = state.getCurrentWatermarkMs()
    ready, held = sorted(h for h in held if h[1] <= passed), [h for h in held if h[1] > passed]
    seqs, deltas = [], []
    for seq, _, text in ready:
        length, mark, delta = _taken(length, mark, text)
        if delta:
            seqs.append(seq)
            deltas.append(delta)
    state.update((length, str(mark), json.dumps(held)))
    if held:
        state.setTimeoutTimestamp(max(min(h[1] for h in held), passed + 1))
    yield from _new_text(key[0], seqs, deltas)


def ordered_delta_stream(snapshots: DataFrame, key: str, seq: str, text: str, time: str, delay: str) -> DataFrame:
    """As :func:`text_delta_stream` for snapshots that arrive out of order, over any number of batches.

    A snapshot is held until the watermark, ``delay`` behind the latest ``time`` of the stream, has passed
    its time: by then all before it are there. Snapshots later than that are dropped. ``seq`` must rise with
    ``time`` in each key. What is held for a key is what came within the delay.
    """
    rows = snapshots.withWatermark(time, delay).select(
        F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("text"), F.col(time).alias("_time"),
    ).withColumn("at", F.unix_millis("_time"))
    return rows.groupBy("key").applyInPandasWithState(
        _deltas_in_order, "key string, seq bigint, delta string", "length bigint, mark string, held string", "append", GroupStateTimeout.EventTimeTimeout
    )


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream to its end into a parquet table."""
    _finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return _table(rows.sparkSession, out, rows.schema)
