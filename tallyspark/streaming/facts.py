"""Tables that micro-batches merge into, kept in plain files.

A table's rows belong to parts (a day of a device and source, a session store of one, a log file). Every batch writes the
parts that it touches anew to a folder of its own number, and last a log of them: a part's rows are those of its newest
batch in the log, so all tables of a batch become current at once, and a batch that comes again after a failure writes the
same folders again. A log row without a part resets its owner: older parts of that owner, touched or not, are gone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from itertools import batched, chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import merge as M
from tallyspark.operators.stages import checkpointed
from tallyspark.sources import readers
from tallyspark.streaming.jobs import placed

LOG = "table string, owner string, part string, batch int"
OWNED = ["owner", "part"]
LATEST = 1 << 30
PATHS = 10_000  # of changed files in one read, at most


def there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def owner_of(*columns: str) -> Column:
    """A table's rows are replaced by owner; names may hold any character."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))


def log(spark: SparkSession, root: str, table: str, below: int = LATEST) -> DataFrame:
    rows = spark.read.schema(LOG).parquet(f"{root}/_log") if there(spark, f"{root}/_log") else spark.createDataFrame([], LOG)
    return rows.where((F.col("table") == table) & (F.col("batch") < below))


def current(spark: SparkSession, root: str, table: str, below: int = LATEST, like: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """A table's rows as the batches before `below` left them, with their owner and part; of the owners and parts in `only`, if given.

    like: a frame with the table's columns, for the time before the first batch.
    """
    path = f"{root}/{table}"
    if not there(spark, path):
        return like.limit(0)
    entries = log(spark, root, table, below)
    parts = entries.where("part IS NOT NULL").groupBy(*OWNED).agg(F.max("batch").alias("batch"))
    if only is not None:
        parts = parts.join(only, OWNED, "left_semi")
    resets = entries.where("part IS NULL").groupBy("owner").agg(F.max("batch").alias("reset"))
    parts = parts.join(resets, "owner", "left").where("reset IS NULL OR batch >= reset").drop("reset")
    return spark.read.parquet(path).where(F.col("batch") < below).join(parts, [*OWNED, "batch"]).drop("batch")


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    return current(spark, root, table).drop(*OWNED)


class Batch:
    """What one micro-batch writes: parts of tables, then the log."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number, self.entries = spark, root, number, []

    def merge(self, table: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], resets: DataFrame | None = None) -> None:
        """rows, with owner and part, merged with what their parts hold; owners in `resets` start from nothing."""
        touched = checkpointed(rows.select(*OWNED).distinct())
        old = current(self.spark, self.root, table, self.number, rows, touched)
        if resets is not None:
            old = old.join(resets.select("owner"), "owner", "left_anti")
            touched = touched.unionByName(resets.select("owner", F.lit(None).cast("string").alias("part")))
        self.put(table, merge(old, rows), touched)

    def put(self, table: str, rows: DataFrame, touched: DataFrame, more: Iterable[DataFrame] = ()) -> None:
        """rows, and those of the frames in `more`, as the new content of the touched parts; a part without rows is empty from now on."""
        for mode, frame in chain([("overwrite", rows)], (("append", m) for m in more)):
            frame.write.mode(mode).parquet(f"{self.root}/{table}/batch={self.number}")
        self.entries.append(touched.select(F.lit(table).alias("table"), *OWNED))

    def commit(self) -> None:
        readers.union_sources(self.entries).write.mode("overwrite").parquet(f"{self.root}/_log/batch={self.number}")


def upserted(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: M.merge_replace(old, new, keys)


def keep_newest(spark: SparkSession, root: str, table: str, keys: list[str], part: Column, owner: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body for streams in update mode: a group's row takes the place of the one that an earlier batch wrote."""

    def run(batch: DataFrame, number: int) -> None:
        now = Batch(spark, root, number)
        now.merge(table, batch.withColumns({"owner": F.lit("") if owner is None else owner, "part": part.cast("string")}), upserted(keys))
        now.commit()

    return run


def _newest(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Of rows with one key the last by place; partial aggregation keeps one for each key and task."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), place).alias("x")).select(*keys, "x.*")


def ingest_payloads(spark: SparkSession, root: str, today: date, now: Column, keep_runs: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: device payloads (lines of stream_text_lines) into the daily, time, session and run tables.

    Payloads count in the order of their time of collection, then their place. A full one replaces the events of every device
    and source it has events of, days that it has none of included; an incremental one only adds and corrects. Daily rows keep
    the cost that a past day was locked at: the stored one, or the first in the batch. An event key keeps its day.
    """
    place = F.struct("at", "pos")

    def run(batch: DataFrame, number: int) -> None:
        payloads = readers.read_push_payload(checkpointed(placed(batch).select("value", F.struct("file_path", "line_no").alias("place"))))
        out = Batch(spark, root, number)
        pair = {"owner": owner_of("device", "source")}

        days = payloads["daily"].drop("mode", "from_device")
        first = days.groupBy(*M.DAILY_KEYS).agg(F.min_by("cost", place).alias("first_cost"))
        days = _newest(days, M.DAILY_KEYS, place).drop("at", "pos").join(first, M.DAILY_KEYS)
        days = days.withColumn("cost", F.when(F.col("usage_date") < F.lit(today), F.col("first_cost")).otherwise(F.col("cost"))).drop("first_cost")
        days = days.withColumns(pair | {"part": F.col("usage_date").cast("string"), "pricing_locked_at": F.lit(None).cast("timestamp")})

        def locked(old: DataFrame, new: DataFrame) -> DataFrame:
            return M.merge_daily_price_locked(old.drop(*OWNED), new.drop(*OWNED, "pricing_locked_at"), today, now).withColumns(pair | {"part": F.col("usage_date").cast("string")})

        out.merge("daily", days, locked)

        events = payloads["time"].drop("from_device").withColumns(pair)
        full = checkpointed(events.where("mode = 'full'").groupBy("owner").agg(F.max("at").alias("since")))
        events = events.join(full, "owner", "left").where("since IS NULL OR at >= since").drop("since", "mode")
        events = _newest(events, M.EVENT_KEYS, place).drop("at", "pos").withColumn("part", F.col("usage_date").cast("string"))
        out.merge("time", checkpointed(events), upserted(M.EVENT_KEYS), full)

        sessions = _newest(payloads["sessions"].drop("mode", "from_device"), M.SESSION_KEYS, place).drop("at", "pos")
        out.merge("sessions", sessions.withColumns(pair | {"part": F.lit("")}), upserted(M.SESSION_KEYS))

        one = {"owner": F.lit(""), "part": F.lit("")}
        runs = payloads["runs"].drop("mode", "from_device").withColumns({"batch_no": F.lit(number), **one})
        all_runs = current(spark, root, "runs", number, runs).unionByName(runs)
        newest = all_runs.orderBy(F.desc("batch_no"), F.desc("at"), F.desc("pos")).limit(keep_runs)
        out.put("runs", newest, spark.range(1).select(*(v.alias(k) for k, v in one.items())))
        out.commit()

    return run


def collect_changed(spark: SparkSession, folder: str, root: str, number: int, glob: str = "*.jsonl") -> DataFrame:
    """Reads the log files that are new or changed since the runs before and puts their lines in the place of those they had.

    A file counts as changed by its size or its time. Lines of files that are gone go too. Returns what was done: file_path,
    what (new, changed or gone). The paths of changed files pass through the driver, as those of any read do, PATHS at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    files = checkpointed(files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    owner = {"owner": F.col("file_path"), "part": F.lit("")}
    known = current(spark, root, "files", number, files.withColumns(owner)).select("file_path", F.col("size").alias("had"), F.col("modified").alias("then"))
    both = files.join(known, "file_path", "full_outer")
    what = F.when(F.col("then").isNull(), "new").when(F.col("size").isNull(), "gone").when((F.col("size") != F.col("had")) | (F.col("modified") != F.col("then")), "changed")
    done = checkpointed(both.select("file_path", "size", "modified", what.alias("what")).where("what IS NOT NULL"))
    changed = (r.file_path for r in done.where("what <> 'gone'").select("file_path").toLocalIterator())
    read = (readers.scan_session_lines(spark, list(paths), glob).drop("modified").withColumns(owner) for paths in batched(changed, PATHS))
    batch = Batch(spark, root, number)
    touched = done.withColumns(owner).select(*OWNED)
    lines = next(read, None)
    if lines is not None:
        batch.put("lines", lines, touched, read)
    elif there(spark, f"{root}/lines"):
        batch.put("lines", spark.read.parquet(f"{root}/lines").drop("batch").limit(0), touched)
    batch.put("files", done.where("what <> 'gone'").drop("what").withColumns(owner), touched)
    batch.commit()
    return done.select("file_path", "what")


def split_late(spark: SparkSession, root: str, cutoffs: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: events (device, source, event_key, event_time, usage_date, ...) behind their source's cutoff go to the table `late`, others are merged.

    A source's newest time is kept beside the events in the table `marks`; cutoffs makes device, source, cutoff of it. What
    lies in `late` waits for repair_late.
    """

    def run(batch: DataFrame, number: int) -> None:
        out = Batch(spark, root, number)
        own = {"owner": owner_of("device", "source"), "part": F.col("usage_date").cast("string")}
        batch = checkpointed(batch.withColumns(own))
        marks = batch.groupBy("device", "source").agg(F.max("event_time").alias("watermark")).withColumns({"owner": own["owner"], "part": F.lit("")})
        seen = checkpointed(current(spark, root, "marks", number, marks))
        split = batch.join(cutoffs(seen.select("device", "source", "watermark")), ["device", "source"], "left").withColumn("behind", F.coalesce(F.col("event_time") <= F.col("cutoff"), F.lit(False))).drop("cutoff")
        split = checkpointed(split)
        out.merge("time", split.where(~F.col("behind")).drop("behind"), upserted(M.EVENT_KEYS))
        out.merge("late", split.where("behind").drop("behind"), upserted(M.EVENT_KEYS))
        out.merge("marks", marks, lambda old, new: old.unionByName(new).groupBy("device", "source", *OWNED).agg(F.max("watermark").alias("watermark")))
        out.commit()

    return run


def repair_late(spark: SparkSession, root: str, number: int, everything: DataFrame) -> DataFrame:
    """Rebuilds the devices and sources that have late events from `everything` that was ever landed, and empties their share of `late`.

    Returns the rebuilt devices and sources.
    """
    own = {"owner": owner_of("device", "source"), "part": F.col("usage_date").cast("string")}
    everything = everything.withColumns(own)
    late = checkpointed(current(spark, root, "late", number, everything).select(*OWNED, "device", "source").distinct())
    pairs = checkpointed(late.select("owner", "device", "source").distinct())
    rows = checkpointed(everything.join(pairs.select("owner"), "owner", "left_semi").dropDuplicates(M.EVENT_KEYS))
    out = Batch(spark, root, number)
    out.merge("time", rows, upserted(M.EVENT_KEYS), pairs)
    out.put("late", rows.limit(0), late.select(*OWNED))
    out.commit()
    return pairs.select("device", "source")

