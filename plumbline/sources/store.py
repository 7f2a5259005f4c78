"""Artifact tables: predictions, metrics and features by key, in partitioned Parquet, and the
exchange formats (TSV, gz JSON lines with header and trailer, id lists)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("task", "dataset_id")
KINDS = ("predictions", "metrics", "dataset_features", "instance_features", "models", "conformal", "conformal_metrics")


@dataclass(frozen=True)
class Spec:
    """The key of an experiment."""

    dataset_id: int
    seed: int
    ratio: float
    task: str = "regression"


class Store:
    """Tables under several roots: all are read, the first is written.  Where roots hold the
    same key, the first root wins."""

    def __init__(self, spark: SparkSession, roots: Sequence[str]):
        if not roots:
            raise ValueError("a store needs a root")
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]

    def _path(self, root: str, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        return f"{root}/{kind}"

    def _there(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def save(self, rows: DataFrame, kind: str) -> None:
        """Replaces the partitions that ``rows`` touches; a write is committed as a whole."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self._path(self.roots[0], kind))

    def scan(self, kind: str, models: Sequence[str] | None = None, specs: Sequence[Spec] | None = None, task: str | None = None, skip_corrupt: bool = False) -> DataFrame:
        """All rows of a kind; filters on keys prune partitions before any file is opened."""
        parts = []
        for k, root in enumerate(self.roots):
            if self._there(path := self._path(root, kind)):
                reader = self.spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
                parts.append(reader.parquet(path).withColumn("root", F.lit(k)))
        if not parts:
            raise FileNotFoundError(f"no {kind} under {self.roots}")
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other, allowMissingColumns=True)
        if task is not None:
            out = out.where(F.col("task") == task)
        if specs is not None:
            # However many there are, they are one small table; its datasets prune partitions.
            wanted = self.spark.createDataFrame([(s.task, s.dataset_id, s.seed, float(s.ratio)) for s in specs], "task string, dataset_id long, seed int, __ratio double").distinct()
            met = [out[k] == wanted[k] for k in ("task", "dataset_id", "seed")] + [F.abs(out["ratio"] - wanted["__ratio"]) < 1e-9]
            out = out.where(F.col("task").isin({s.task for s in specs}) & F.col("dataset_id").isin({s.dataset_id for s in specs}))
            out = out.join(wanted, met, "left_semi")
        if models is not None:
            out = out.where(F.col("model").isin(list(models)))
        if len(parts) == 1:
            return out.drop("root")
        own = [c for c in ("task", "dataset_id", "seed", "ratio", "model") if c in out.columns]
        first = out.groupBy(*own).agg(F.min("root").alias("root"))
        return out.join(first, [*own, "root"], "left_semi").drop("root")

    def models(self, spec: Spec) -> DataFrame:
        return self.scan("predictions", specs=[spec]).select("model").distinct().orderBy("model")

    def pending(self, kind: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Wanted keys that have no rows yet."""
        try:
            have = self.scan(kind).select(*keys).distinct()
        except FileNotFoundError:
            return wanted
        return wanted.join(have, list(keys), "left_anti")


def parse_file_names(files: DataFrame, column: str = "path") -> DataFrame:
    """Keys from names such as dataset_12_seed_3_ratio_1.0__model.parquet; null where absent."""
    name = F.element_at(F.split(column, "/"), -1)
    part = lambda k, kind: F.expr(f"try_cast(nullif(regexp_extract(__name, '{k}_([0-9.]*[0-9])', 1), '') as {kind})")
    out = files.withColumn("__name", name)
    return out.withColumns({"dataset_id": part("dataset", "int"), "seed": part("seed", "int"), "ratio": part("ratio", "double"), "model": F.nullif(F.regexp_extract("__name", r"__([^.]+)\.[a-z]+$", 1), F.lit(""))}).drop("__name")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One integer a line; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where("value <> '' and not startswith(value, '#')").select(F.col("value").cast("long").alias("dataset_id")).distinct()


TRIALS = T.StructType([T.StructField(n, k) for n, k in (("task", T.StringType()), ("dataset_id", T.LongType()), ("model", T.StringType()), ("seed", T.IntegerType()), ("ensemble", T.IntegerType()), ("metric", T.StringType()), ("value", T.DoubleType()))])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = TRIALS) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="", nanValue="nan")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")


def write_json_lines(rows: DataFrame, path: str, metadata: dict) -> None:
    """gz JSON lines: one metadata row, a row each, and one that tells their number."""
    spark = rows.sparkSession
    body = rows.select(F.to_json(F.struct(F.lit("metric").alias("type"), *rows.columns)).alias("value"))
    body.write.mode("overwrite").option("compression", "gzip").text(path)
    # Part names sort, so that the metadata come first and the number of rows, counted in what
    # was written, last.
    n = spark.read.text(path).count()
    for name, line in (("part-!", {"type": "metadata"} | metadata), ("part-~", {"type": "complete", "rows": n})):
        write_text(spark, f"{path}/{name}.txt", json.dumps(line) + "\n")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def json_lines_metadata(spark: SparkSession, path: str) -> dict:
    """What the first line of such a file tells."""
    line = spark.read.text(path).where(F.get_json_object("value", "$.type") == "metadata").first()
    return {k: v for k, v in json.loads(line[0]).items() if k != "type"} if line else {}


def save_model(spark: SparkSession, model, path: str) -> None:
    """A library model and, once all of it is there, a sidecar with its size."""
    model.write().overwrite().save(path)
    write_text(spark, f"{path}.complete.json", json.dumps({"bytes": _bytes(spark, path)}))


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether a model is there as whole as its sidecar says."""
    side = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.complete.json")
    files = side.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(side) or not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return False
    return json.loads(spark.read.text(f"{path}.complete.json").first()[0])["bytes"] == _bytes(spark, path)


#: What marks a folder as one that drop_checkpoints may delete.
OWNED = "_plumbline_checkpoints"


def make_checkpoints(spark: SparkSession, path: str) -> str:
    """A folder for checkpoints, marked as ours; one that is there and is not is refused."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, OWNED)
    if files.exists(where) and not files.exists(mark) and len(files.listStatus(where)):
        raise ValueError(f"{path} holds other files")
    files.mkdirs(where)
    write_text(spark, f"{path}/{OWNED}", "")
    return path


def drop_checkpoints(spark: SparkSession, path: str) -> None:
    """Deletes a folder that make_checkpoints has marked, and no other."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where):
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, OWNED)):
            raise ValueError(f"{path} is not a checkpoint folder of ours")
        files.delete(where, True)


def write_validation(spark: SparkSession, path: str, checks: dict[str, int], sources: dict[str, DataFrame]) -> dict:
    """validation.json: how many rows broke each check, and a digest of every source table."""
    digests = {}
    for name, rows in sources.items():
        made = fingerprint(rows.withColumn("__one", F.lit(1)), ["__one"], rows.columns).first()
        digests[name] = made["fingerprint"] if made else None
    out = {"ok": not any(checks.values()), "checks": checks, "sources": digests}
    write_text(spark, path, json.dumps(out, sort_keys=True, indent=1) + "\n")
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, in a folder of its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").csv(f"{folder.rstrip('/')}/{name}.csv", header=True, nullValue="")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of such a file; an error if their number is not the one told."""
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    told = raw.where(kind == "complete").select(F.get_json_object("value", "$.rows").cast("long")).first()
    rows = raw.where(kind == "metric")
    if told is None or rows.count() != told[0]:
        raise ValueError(f"{path} is not complete")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def fingerprint(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """An order-free digest of each key's rows."""
    each = rows.groupBy(*keys).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    return each.select(*keys, F.sha2(F.concat_ws(":", F.col("h").cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"))


def run_log(spark: SparkSession, records: Sequence[dict], path: str) -> None:
    """Appends job records: key, status, seconds of each phase, error."""
    schema = "job string, status string, seconds map<string,double>, error string"
    spark.createDataFrame([(r["job"], r["status"], r.get("seconds", {}), r.get("error")) for r in records], schema).write.mode("append").parquet(path)


def claim_protocol(spark: SparkSession, root: str, protocol: str, most: int) -> None:
    """Writes a root's sampling protocol once; another one later is an error."""
    path = f"{root.rstrip('/')}/protocol.json"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    want = json.dumps({"sampling_protocol": protocol, "max_n": most}, sort_keys=True)
    try:
        out = fs.create(where, False)
        out.write(bytearray(want.encode()))
        out.close()
    except Exception:
        have = spark.read.text(path).first()
        if have is None or have[0] != want:
            raise ValueError(f"{root} was made with another protocol: {have and have[0]}") from None
