"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATORS = {".csv": ",", ".tsv": "\t", ".tab": "\t"}
JSON = (".json", ".jsonl", ".ndjson")


class SourceError(ValueError):
    """A path that isn't there or of a kind that isn't read."""


def _exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, so any store that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name[name.rfind(".") :] if "." in name else ""


def guard(spark: SparkSession, path: str) -> str:
    """The path, if it is there and of a kind that load() reads."""
    if _suffix(path) not in (*SEPARATORS, *JSON):
        raise SourceError(f"unsupported kind of file: {path}")
    if not _exists(spark, path):
        raise SourceError(f"no such path: {path}")
    return path


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, max_rows: int | None = None, multi_line: bool = True) -> DataFrame:
    """CSV or TSV by extension, a JSON array or JSON lines. max_rows is the caller's preview limit. With `multi_line` quoted line ends are
    read, and a CSV file is one task; without it files are split."""
    kind = _suffix(guard(spark, path))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in SEPARATORS:
        options = {"sep": SEPARATORS[kind], "header": True, "multiLine": multi_line, "escape": '"', "quote": '"'}
        out = reader.options(**options, **({} if schema is not None else {"inferSchema": True})).csv(path)
    else:
        out = reader.option("multiLine", kind == ".json").json(path)
    return out if max_rows is None else out.limit(max_rows)


def load_any_encoding(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, str | None]:
    """A delimited source and a warning. Files that aren't UTF-8 are read as Latin-1, with a comma as separator; the others as they are.
    Files are told apart by their paths, which the driver lists in any case."""
    kind = _suffix(guard(spark, path))
    lines = spark.read.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    by_file = lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).collect()
    good, bad = (sorted(r.file for r in by_file if r.valid == v) for v in (True, False))
    options = {"header": True, "escape": '"', "quote": '"'}
    parts = [spark.read.schema(schema).options(sep=SEPARATORS[kind], **options).csv(good or path)] if good or not bad else []
    if bad:
        parts.append(spark.read.schema(schema).options(sep=",", encoding="ISO-8859-1", **options).csv(bad))
    return reduce(DataFrame.unionByName, parts), "read as latin-1" if bad else None


def _decoded(files: DataFrame) -> DataFrame:
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents: path, text, encoding. Bytes that aren't UTF-8 are read as Latin-1, and the encoding says so. The driver lists the
    files; texts_of() needs no list."""
    return _decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


#: Bytes of files that are passed on together.
TOGETHER = 1 << 22


def texts_of(paths: DataFrame) -> DataFrame:
    """As texts(), of the files that a table names in `path`. Tasks read them through Arrow's file systems, so neither names nor states of
    files come to the driver; empty files, which Spark's reader leaves out, are read too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            names, held, size = [], [], 0
            for name in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_stream(at, compression=None) as source:
                    held.append(source.read())
                names.append(name)
                size += len(held[-1])
                if size >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
                    names, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    return _decoded(paths.select("path").mapInArrow(run, "path string, content binary"))


def file_writer(folder: str):
    """For mapInPandas over (doc_id, content), to (doc_id, path): writes each content as a whole file `<doc_id>.txt` through Arrow's file systems. A task that is
    repeated writes the same files again."""

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            for i, content in zip(b["doc_id"], b["content"], strict=True):
                with store.open_output_stream(f"{at}/{i}.txt", compression=None) as out:
                    out.write(bytes(content))
            yield b[["doc_id"]].assign(path=[f"{folder}/{i}.txt" for i in b["doc_id"]])

    return run


def relational(spark: SparkSession, folder: str, required: list[str]) -> dict[str, DataFrame]:
    """The required tables of a folder of Parquet tables; refused if one is missing."""
    if missing := [t for t in required if not _exists(spark, f"{folder}/{t}.parquet")]:
        raise SourceError(f"missing tables: {', '.join(missing)}")
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in required}


def relational_jdbc(spark: SparkSession, url: str, required: dict[str, str | None], partitions: int = 8, **options: str) -> dict[str, DataFrame]:
    """The required tables of a database; refused if its catalogue lacks one. required: a table and the numeric column by whose bounds it is
    read in so many partitions; without a column, or without rows, a table is read in one task."""
    manager = spark._jvm.java.sql.DriverManager
    if "driver" in options:
        spark._jvm.java.lang.Class.forName(options["driver"])
    connection = manager.getConnection(url, options.get("user", ""), options.get("password", "")) if "user" in options else manager.getConnection(url)
    try:
        found, known = connection.getMetaData().getTables(None, None, "%", None), set()
        while found.next():
            known.add(found.getString("TABLE_NAME").lower())
    finally:
        connection.close()
    if missing := [t for t in required if t.lower().rsplit(".", 1)[-1] not in known]:
        raise SourceError(f"missing tables: {', '.join(missing)}")
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    out = {}
    for name, column in required.items():
        ends = reader(query=f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {name}").load().first() if column else None
        bounds = {"partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(partitions)} if ends and ends[0] is not None else {}
        out[name] = reader(dbtable=name, **bounds).load()
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header, in one file: reports are aggregates. Line ends and quotes in values are quoted."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, in one file."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, column: str = "_split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
