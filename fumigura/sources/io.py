"""Reading and writing of works and records."""

from __future__ import annotations

import base64
import gzip as gz
import json
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def distinct_rows(df: DataFrame, *by: str) -> DataFrame:
    """Distinct rows in as many partitions as shuffles have, not fewer: what follows is costlier than its size tells.

    ``by``: columns that keep rows together, if a join on them follows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *(by or df.columns)).distinct()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only in local mode, where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="fumigura-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: cuts the lineage of iterations."""
    path = f"{shared_dir(df.sparkSession)}/fumigura-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole text files; files that vanish meanwhile are left out."""
    return spark.read.option("ignoreMissingFiles", "true").text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def decoded(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """(path, text, encoding) of binary files: Shift JIS if every byte is, else UTF-8 without what isn't; not strict: Shift JIS without what isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    out.append((raw.decode("shift_jis", "strict" if strict else "ignore"), "shift_jis"))
                except UnicodeDecodeError:
                    out.append((raw.decode("utf-8", "ignore"), "utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], names=["path", "text", "encoding"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def json_lines(spark: SparkSession, schema: T.StructType | str, *paths: str) -> DataFrame:
    """Records of JSON lines, gzipped or not; malformed and blank lines are left out, missing keys are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Nulls of missing keys replaced by the default of their column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, packed): texts as base64 of gzip; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else base64.b64encode(gz.compress(t.encode("utf-8"), mtime=0)).decode("ascii") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "packed"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, packed string").withColumnRenamed("key", key)


def embedded_lines(df: DataFrame, key: str, packed: str) -> DataFrame:
    """(key, line_no, line) of texts embedded as base64 of gzip; nulls and what isn't such a text have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                try:
                    out.append(gz.decompress(base64.b64decode(x, validate=True)).decode("utf-8"))
                except (ValueError, OSError, EOFError, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    texts_ = df.select(F.col(key).alias("key"), packed).mapInArrow(run, f"key {kind}, text string")
    return texts_.select(F.col("key").alias(key), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")


def write_json_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines with nulls kept and letters as they are."""
    df.write.option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def digest(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a digest that does not depend on their order or partitions."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(5)]
    sums = rows.agg(F.count("*").alias("rows"), *words)
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(5)]), 256).alias("digest"))


def manifest(df: DataFrame, seed: int | None = None, path: str | None = None, **extra) -> str:
    """JSON of a data set: rows, digest, seed, bytes of its files (of ``path``, if given), seconds taken to count it, and what else is named."""
    began = time.monotonic()
    row = digest(df).first()
    size = None
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    facts = {"rows": row["rows"], "digest": row["digest"], "seed": seed, "bytes": size, "elapsed": round(time.monotonic() - began, 3), **extra}
    return json.dumps({k: v for k, v in facts.items() if v is not None}, ensure_ascii=False, sort_keys=True)


def stats_json(df: DataFrame, category: str, flag: str) -> DataFrame:
    """One row ``stats``: JSON of rows, flagged rows, their ratio (four places) and the counts by category in the order of names."""
    by = df.groupBy(category).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    all_ = by.agg(F.sum("n").alias("total"), F.sum("k").alias("flagged"), F.array_sort(F.collect_list(F.struct(F.coalesce(category, F.lit("")).alias("name"), "n"))).alias("categories"))  # a row for each category
    return all_.select(F.to_json(F.struct("total", "flagged", F.round(F.col("flagged") / F.col("total"), 4).alias("ratio"), "categories")).alias("stats"))


def run_history(runs: DataFrame, run: str, at: str, *measures: str) -> DataFrame:
    """(run, history): the measures of each run as JSON, in the order of ``at``."""
    rows = F.array_sort(F.collect_list(F.struct(at, *measures)))  # the steps of one run
    return runs.groupBy(run).agg(F.to_json(rows).alias("history"))
