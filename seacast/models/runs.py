"""The append-only table of model runs and its comparisons."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seacast.models.metrics import SCORES
from seacast.schemas import MODEL_RUNS


def run_record(
    metrics: DataFrame, version: str, data_source: str, n_samples: int, n_features: int,
    input_path: str = "default", active: bool = False,
) -> DataFrame:
    """One ``model_runs`` row from a one-row metrics frame."""
    return metrics.select(
        F.lit(version).alias("version"),
        F.current_timestamp().alias("run_at"),
        F.lit(data_source).alias("data_source"),
        F.lit(input_path).alias("input_path"),
        *SCORES,
        F.lit(n_samples).cast("long").alias("n_samples"),
        F.lit(n_features).cast("long").alias("n_features"),
        "target_rate",
        F.lit(active).alias("active"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in MODEL_RUNS.fields])


def append_run(record: DataFrame, path: str) -> DataFrame:
    """Adds a record to the run table and returns the table."""
    record.write.mode("append").parquet(path)
    return record.sparkSession.read.schema(MODEL_RUNS).parquet(path)


def promote(runs: DataFrame, version: str) -> DataFrame:
    """The run table with the newest run of ``version`` as the only active one."""
    newest = runs.where(F.col("version") == version).agg(F.max("run_at")).first()[0]
    if newest is None:
        raise ValueError(f"no run of version {version!r}")
    return runs.withColumn("active", (F.col("version") == version) & (F.col("run_at") == F.lit(newest)))


class Conflict(RuntimeError):
    """Another writer committed first."""


class RunLog:
    """A run table in a folder: records as Parquet, and a log with one numbered entry for each change.

    An entry is created only if its number is free, so of two writers that saw the same state one wins. Readers
    take the records that entries name, so a record without its entry is not there, and the last promoted run is
    the only active one. Entries are one small file for each run or promotion.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> list[dict]:
        """The changes so far, in order."""
        fs, root = FileSystem.from_uri(self.path if ":" in self.path else os.path.abspath(self.path))
        if fs.get_file_info(f"{root}/log").type != FileType.Directory:
            return []
        names = sorted(i.path for i in fs.get_file_info(FileSelector(f"{root}/log")) if i.path.endswith(".json"))
        return [json.loads(fs.open_input_stream(name).read()) for name in names]

    def commit(self, entry: dict, number: int) -> None:
        """Adds an entry as the one with this number; a number that is taken is a conflict."""
        name = f"{self.path}/log/{number:012d}.json"
        if not create_if_absent(self.spark, name, json.dumps(entry)):
            raise Conflict(f"change {number} of {self.path} was made by another writer")

    def append(self, record: DataFrame, tries: int = 20) -> str:
        """Adds the record of a run; returns the run's id. Appends never conflict with each other, so a taken number is tried again."""
        run = uuid.uuid4().hex
        record.write.parquet(f"{self.path}/runs/{run}")
        for _ in range(tries):
            try:
                self.commit({"add": run}, len(self.entries()))
                return run
            except Conflict:
                continue
        raise Conflict(f"{tries} tries to append to {self.path} failed")

    def promote(self, run: str, seen: int | None = None) -> None:
        """Makes a run the only active one, if the log still has the ``seen`` entries (default: those of now)."""
        entries = self.entries()
        if run not in {e.get("add") for e in entries}:
            raise ValueError(f"no run {run!r}")
        self.commit({"promote": run}, len(entries) if seen is None else seen)

    def table(self) -> DataFrame:
        """All committed runs with their ids; ``active`` is true for the one promoted last."""
        entries = self.entries()
        runs, active = [e["add"] for e in entries if "add" in e], next((e["promote"] for e in reversed(entries) if "promote" in e), None)
        if not runs:
            return self.spark.createDataFrame([], MODEL_RUNS).withColumn("run", F.lit(""))
        read = self.spark.read.schema(MODEL_RUNS).parquet(*[f"{self.path}/runs/{r}" for r in runs])
        run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return read.withColumn("run", run).withColumn("active", F.col("run") == F.lit(active) if active else F.lit(False))


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it exists; of several writers one succeeds."""
    if ":" not in path or path.startswith("file:"):
        local = path.removeprefix("file:").replace("///", "/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        whole = f"{local}.{uuid.uuid4().hex}"
        with open(whole, "w") as out:
            out.write(text)
        try:
            os.link(whole, local)  # the name appears with its content, or the link fails
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def leader_board(runs: DataFrame, by: str = "accuracy") -> DataFrame:
    return runs.orderBy(F.desc(by), "version")


def signed(value: Column) -> Column:
    """Delta text with sign and four digits."""
    return F.format_string("%+.4f", value)


def _long(runs: DataFrame) -> DataFrame:
    return runs.select(
        "version",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value")) for m in SCORES])),
    )


def compare_two(runs: DataFrame, first: str, second: str, tie: str = "first") -> DataFrame:
    """Per metric both values, the delta, its text, and the winner on F1.

    An equal F1 goes to the ``tie`` side: 'first' or 'second'.
    """
    if tie not in ("first", "second"):
        raise ValueError(f"tie must be 'first' or 'second', got {tie!r}")

    def pick(version: str, metric: str) -> Column:
        return F.max(F.when(F.col("version") == version, F.coalesce(F.col(metric), F.lit(0.0))))

    f1, f2 = pick(first, "f1"), pick(second, "f1")
    second_wins = (f2 > f1) if tie == "first" else (f2 >= f1)
    winner = F.when(second_wins, F.lit(second)).otherwise(F.lit(first))
    rows = runs.where(F.col("version").isin(first, second)).agg(
        F.array(
            *[F.struct(F.lit(m).alias("metric"), pick(first, m).alias("first_value"), pick(second, m).alias("second_value")) for m in SCORES]
        ).alias("rows"),
        winner.alias("winner"),
    )
    delta = F.col("second_value") - F.col("first_value")
    return rows.select(F.inline("rows"), "winner").select(
        "metric", "first_value", "second_value", delta.alias("delta"), signed(delta).alias("delta_text"), "winner"
    )


def compare_many(runs: DataFrame, versions: list[str]) -> DataFrame:
    """One row per metric, one column per version."""
    return _long(runs).groupBy("metric").pivot("version", versions).agg(F.max("value"))


def or_vote(first: DataFrame, second: DataFrame, keys: list[str], prediction: str = "annulation_predicted") -> DataFrame:
    """Cancelled when either model says so."""
    a = first.select(*keys, F.col(prediction).cast("int").alias("_a"))
    b = second.select(*keys, F.col(prediction).cast("int").alias("_b"))
    return a.join(b, keys).select(*keys, F.greatest("_a", "_b").alias(prediction))
