"""Documents and unpacked files as one file each below a folder, by any file system that executors can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folder_key


def write_files(files: DataFrame, root: str) -> DataFrame:
    """files: path (below root) and content (binary). Returns path and bytes written.

    A file appears under its name only when it is whole and replaces an older one, so that a repeated
    task or run gives the same tree. Nothing is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, name = f"{base}/{path}".rpartition("/")
                place.create_dir(folder, recursive=True)
                unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with place.open_output_stream(unfinished) as out:
                    out.write(content)
                place.move(unfinished, f"{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def document_files(documents: DataFrame, name: str) -> DataFrame:
    """documents: base_id, document. One file `name` in each paper's folder."""
    return documents.select(F.concat_ws("/", folder_key(F.col("base_id")), F.lit(name)).alias("path"), F.encode("document", "UTF-8").alias("content"))


def member_files(members: DataFrame) -> DataFrame:
    """members: base_id, version, name, content. Files below <paper>/tex/<paper>v<n>, with their own folders."""
    folder = folder_key(F.col("base_id"))
    of_version = F.concat(folder, F.lit("v"), F.col("version").cast("string"))
    return members.where("content is not null").select(F.concat_ws("/", folder, F.lit("tex"), of_version, F.col("name")).alias("path"), "content")
