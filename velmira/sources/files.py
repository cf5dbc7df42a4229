"""Readers and writers with explicit schemas; nested columns are written as JSON where the format is flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str, null_literals: tuple[str, ...] = ("",), keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV with header; ``null_literals`` become null except in the columns of ``keep`` (labels such as "None")."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*null_literals), F.col(c)) for c in text}) if text else df


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", **options: str) -> DataFrame:
    """The table at ``path``, or an empty one of the schema if there is nothing at ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(file_format).options(**options).load(path)


def find_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of the files under ``root`` with one of the extensions and a name that ``pattern`` fits."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    if extensions:
        df = df.where(F.lower(name).rlike(r"\.(?:" + "|".join(e.lower().lstrip(".") for e in extensions) + ")$"))
    return df.where(name.rlike(pattern)) if pattern else df


def first_existing(candidates: DataFrame, existing: DataFrame, key: str, order: str, path: str = "path") -> DataFrame:
    """``key, path``: of the candidate places of each key, in ``order``, the first that exists."""
    met = candidates.join(existing.select(path).distinct(), path, "left_semi")
    return met.groupBy(key).agg(F.min_by(path, order).alias(path))


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Run results, one JSON file each: the stem gives task, seed and variant; files that don't parse are left out."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob).withColumn("stem", stem)
    return df.withColumns(
        {"task": F.regexp_replace("stem", r"(?:_(?:seed\d+|strong|regime\w*))+$", ""), "seed": F.regexp_extract("stem", r"_seed(\d+)", 1).try_cast("int"), "strong": F.col("stem").endswith("_strong"), "regime": F.nullif(F.regexp_extract("stem", r"_regime_?(\w+?)(?:_strong)?$", 1), F.lit(""))}
    )


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls left out; nested columns stay nested."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small table as one indented JSON array in one file; more than ``limit`` rows are an error."""
    import json

    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    with open(path, "w", encoding="utf-8") as out:
        json.dump([json.loads(r) for r in rows], out, indent=2, ensure_ascii=False)


def write_flat_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    (df.withColumns(flat) if flat else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parted(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """All outputs of a fan-out in one pass."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def primary_documents(files: DataFrame) -> DataFrame:
    """One document file per directory: ``path`` rows to ``dir, path``; .nxml before .xml, upper levels first, then by
    name; dot files don't count."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(F.lower(name).endswith(".nxml"), 0).when(F.lower(name).endswith(".xml"), 1)
    depth = F.size(F.split("path", "/"))
    return files.withColumns({"name": name, "rank": rank, "depth": depth}).where(F.col("rank").isNotNull() & ~F.col("name").startswith(".")).groupBy(
        F.regexp_extract("path", r"(PMC\d+)", 1).alias("pmc_id")
    ).agg(F.min(F.struct("depth", "rank", "name", "path"))["path"].alias("path"))


#: Answers of a server after which it is worth asking again.
AGAIN = (408, 409, 425, 429, 500, 502, 503, 504)


class AskAgain(Exception):
    """A client's error with the ``code`` of the server's answer."""

    def __init__(self, code: int, message: str = "") -> None:
        super().__init__(message or f"code {code}")
        self.code = code


def wait_seconds(attempt: int, first: float = 1.0, most: float = 60.0, jitter: float = 0.5, draw=None) -> float:
    """Seconds before the next attempt: doubled each time up to ``most``, and up to half as much again by chance."""
    import random

    return min(most, first * 2.0 ** min(attempt, 30)) * (1 + jitter * (draw or random.random)())


def patient(complete: Callable[[list[str]], list[str | None]], attempts: int = 25, sleep=None) -> Callable[[list[str]], list[str | None]]:
    """A client that asks again after a failed connection or one of ``AGAIN``, at most ``attempts`` times in all."""
    import time

    def ask(prompts: list[str]) -> list[str | None]:
        for attempt in range(attempts):
            try:
                return complete(prompts)
            except (ConnectionError, TimeoutError, AskAgain) as problem:
                if getattr(problem, "code", 503) not in AGAIN or attempt + 1 == attempts:
                    raise
                (sleep or time.sleep)(wait_seconds(attempt))
        return [None] * len(prompts)

    return ask


def round_robin(clients: list[Callable[[list[str]], list[str | None]]]) -> Callable[[list[str]], list[str | None]]:
    """A client that asks several servers in turn."""
    turn = iter(range(1 << 62))
    return lambda prompts: clients[next(turn) % len(clients)](prompts)


def answered(df: DataFrame, key: str, prompt: str, complete: Callable[[list[str]], list[str | None]], batch: int = 64, concurrent: int = 1) -> DataFrame:
    """``key, answer, error``: answers of a pluggable model client, asked in batches per partition, ``concurrent`` at once.  Write the result
    before using it twice; a failed batch gives nulls with the error, never an exception."""
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    kind = dict(df.dtypes)[key]

    def asked(part):
        try:
            return complete(part), [None] * len(part)
        except Exception as problem:  # noqa: BLE001
            return [None] * len(part), [str(problem)[:200]] * len(part)

    def run(frames):
        with ThreadPoolExecutor(max(1, concurrent)) as pool:
            for frame in frames:
                prompts = frame[prompt].tolist()
                done = list(pool.map(asked, [prompts[at : at + batch] for at in range(0, len(prompts), batch)]))
                yield pd.DataFrame({key: frame[key], "answer": [x for a, _ in done for x in a], "error": [x for _, e in done for x in e]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, answer string, error string")
