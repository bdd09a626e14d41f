"""Readers and writers of result tables: typed scans, file-name columns, key-value caches, layouts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE = "_metadata.file_path"
#: Rows that a task puts in order.
TASK_ROWS = 500_000


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True)


def read_samples(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of a Parquet table; the others aren't read."""
    return spark.read.parquet(path).select(*columns)


def read_latest(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    """Rows of the newest file or folder by name: the greatest value that ``pattern`` finds in the path, as ``snapshot``.

    Names are compared as text. They are listed through the file system, so
    the other files aren't read; paths that share the newest name are read together.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [(m[1], p) for p in (status.getPath().toString() for status in listed) if (m := re.search(pattern, p))]
    if not names:
        raise FileNotFoundError(f"no path of {glob} matches {pattern}")
    newest = max(name for name, _ in names)
    return spark.read.parquet(*[p for name, p in names if name == newest]).withColumn("snapshot", F.lit(newest))


def read_glob(spark: SparkSession, glob: str, order: Sequence[str]) -> DataFrame:
    """Rows of many files with their number within their file, ``batch_idx``, from 0."""
    df = spark.read.parquet(glob).withColumn("file", F.col(FILE))
    return df.withColumn("batch_idx", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)


def read_replicates(spark: SparkSession, glob: str, pattern: str, names: Sequence[str], schema: str) -> DataFrame:
    """CSV files of replicates, tagged with the whole numbers that ``pattern``'s groups find in the path."""
    df = spark.read.schema(schema).csv(glob, header=True)
    return df.withColumns({name: F.regexp_extract(FILE, pattern, k + 1).cast("int") for k, name in enumerate(names)})


def file_tags(paths: DataFrame, path: str, pattern: str, name: str) -> DataFrame:
    """A tag in the file name, and the number of the file among those with that tag, from 0."""
    tagged = paths.withColumn(name, F.regexp_extract(path, pattern, 1).cast("int"))
    return tagged.withColumn("replicate", F.row_number().over(Window.partitionBy(name).orderBy(path)) - 1)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``state,reward`` without a header."""
    return spark.read.schema("state string, reward double").csv(path, header=False)


def chunk_runs(log: DataFrame, key: str, step: str = "step", value: str = "reward", size: int = 1000) -> DataFrame:
    """The steps of runs, numbered from 1 without gaps, as rows of at most ``size`` values: (key, start, rewards), ``start`` being the steps before."""
    start = (F.floor((F.col(step) - 1) / size) * size).cast("bigint")
    inside = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))
    return log.groupBy(key, start.alias("start")).agg(F.transform(inside, lambda x: x["v"]).alias("rewards"))


def explode_runs(runs: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """One row per step of every run: its configuration joined with its rewards, in order from t = 1.

    A run is one row, or some of ``chunk_runs`` with the steps before each in ``start``.
    """
    start = F.col("start") if "start" in runs.columns else F.lit(0)
    steps = runs.select(key, start.alias("start"), F.posexplode("rewards").alias("pos", "reward"))
    return config.join(steps.select(key, (F.col("start") + F.col("pos") + 1).cast("int").alias("t"), "reward"), key)


def kv_to_samples(cache: DataFrame, prefix: str = "state_") -> DataFrame:
    """A key-value cache (key, fields MAP<STRING, STRING> of JSON pairs) as sample rows."""
    rows = cache.select(F.col("key").substr(F.lit(len(prefix) + 1), F.length("key")).alias("state"), F.explode("fields").alias("param_idx", "pair"))
    pair = F.from_json("pair", "array<double>")
    return rows.select("state", F.col("param_idx").cast("bigint").alias("param_idx"), F.get(pair, 0).alias("acf_min"), F.get(pair, 1).alias("sim_time"))


def params_to_kv(params: DataFrame, id_col: str, seed: str, counts: Sequence[str], rates: Sequence[str], n_counts: int, n_rates: int) -> DataFrame:
    """Parameter rows as (key, JSON array of seed, counts and rates); the numbers of columns are checked."""
    if len(counts) != n_counts or len(rates) != n_rates:
        raise ValueError(f"{n_counts} counts and {n_rates} rates are expected, not {len(counts)} and {len(rates)}")
    value = F.to_json(F.struct(F.col(seed).alias("seed"), F.array(*counts).alias("prots0"), F.array(*rates).alias("params")))
    return params.select(F.col(id_col).cast("string").alias("key"), value.alias("value"))


def write_samples(df: DataFrame, path: str, by: str = "state", kind: str = "parquet") -> None:
    """A folder per value of ``by``; its rows are brought together first, so a folder has few files."""
    df.repartition(by).write.partitionBy(by).format(kind).save(path)


def split_write(df: DataFrame, outputs: dict[str, Column], path: str) -> None:
    """Rows to the outputs whose predicates they meet, in a single pass: a folder per output."""
    routes = F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in outputs.items()]), lambda n: n.isNotNull())
    df.withColumn("route", F.explode(routes)).write.partitionBy("route").parquet(path)


def compact_by_state(samples: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All samples of a state in one partition, ordered, with the sample number that their parameters have.

    There are as many partitions as the (counted) samples ask for, ``TASK_ROWS`` each, and no fewer than shuffles have; so what a task
    orders doesn't grow with the table. Numbers are looked up in a hash table of their partition; samples aren't ordered for that.
    """
    parts = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-samples.count() // TASK_ROWS))
    joined = samples.join(numbers.hint("shuffle_hash"), list(keys))
    return joined.repartition(parts, "state").sortWithinPartitions("state", "sample_num")
