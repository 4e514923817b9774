"""Files of their own form (workbooks, calendars), written by the tasks themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OpenFile:
    """A file that appears under its name only when it is complete, on any file system that Arrow knows (local, HDFS, object stores).
    A task that runs again replaces what an earlier attempt left, by the same content."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}.part"
        self.fs.create_dir(root, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) into a folder that all executors share; (name, bytes) of what was written. Runs when collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for i, name in enumerate(names):
                content = batch.column(1)[i].as_py() or b""
                out = OpenFile(folder, name)
                out.write(content)
                out.close()
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, bytes bigint")


def hadoop_paths(spark: SparkSession, *names: str) -> tuple:
    """The file system of the first path, and all paths, as Spark's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    made = [path(n) for n in names]
    return (made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the complete folder `fresh` in the place of `path`: the old one is renamed away first and deleted last."""
    fs, old, new, bak = hadoop_paths(spark, path, fresh, path + ".old")
    fs.delete(bak, True)
    if fs.exists(old):
        fs.rename(old, bak)
    fs.rename(new, old)
    fs.delete(bak, True)


def replace_workbooks(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """SNK-4: the set of workbooks (name, content) takes the place of the folder's, old .xls and .xlsx included, all at once; the number
    of files. An empty set never replaces anything."""
    fs, fresh = hadoop_paths(spark, folder + ".new")
    fs.delete(fresh, True)
    written = write_files(files, folder + ".new").count()
    if not written:
        raise ValueError("refusing to replace workbooks by none")
    swap_in(spark, folder + ".new", folder)
    return written
