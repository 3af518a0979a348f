"""Files as DataFrames: corpora, codec files and archives.

Reading goes through Spark's binary file source, so any store that Spark reads will do, and
files are spread over tasks.  Writing uses the ``slotgram_files`` data source: each row of
(path, content) becomes a file under the target, which all executors must share; files appear
under their names only when the job commits.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from slotgram.functions.text import decoded, is_text
from slotgram.scratch import new_path
from slotgram.sources import layouts

ENTRY = "archive string, codec string, entry_type string, ord int, path string, enc_size long, encoded binary"
HEAD = "archive string, codec string, entry_type string, entries long, encoded_bytes long, meta_bytes binary, archive_bytes long"
#: Bytes of entries in one Arrow batch.
BATCH_BYTES = 64 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_metadata", "_common_metadata"))


def _left_out(spark: SparkSession, path: str) -> Iterator[tuple[str, int]]:
    """path, length of the files that the binary source leaves out: empty ones, and those that
    their name or a folder below ``path`` hides.  Local folders are walked, other stores listed
    by Hadoop."""
    if re.match(r"(file:|/|[^:]*$)", path):
        local = re.sub("^file:(//(?=/))?", "", path)
        for root in [local] if os.path.exists(local) else glob.glob(local, include_hidden=True):
            root = os.path.abspath(root)
            for folder, _, names in os.walk(root) if os.path.isdir(root) else [(os.path.dirname(root), [], [os.path.basename(root)])]:
                below = [x for x in os.path.relpath(folder, root).split("/") if x not in (".", "..")]
                for name in names:
                    full = os.path.join(folder, name)
                    hidden = any(map(_hidden, [*below, name]))
                    if os.path.isfile(full) and (hidden or not os.path.getsize(full)):
                        yield f"file:{full}", os.path.getsize(full)
        return
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.globStatus(pattern) or ():
        root = status.getPath().toString()
        base = root if status.isDirectory() else root.rpartition("/")[0]
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            file = found.next()
            name, length = file.getPath().toString(), file.getLen()
            hidden = any(map(_hidden, name[len(base) + 1 :].split("/")))
            if hidden or not length:
                yield name, length


def _copied(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, content of hidden files, through copies with plain names in the shared folder
    of intermediate tables: no file source of Spark opens a hidden name."""
    folder, java = new_path(spark, "hidden"), spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for i, path in enumerate(paths):
        source, target = java.Path(path), java.Path(f"{folder}/{i}")
        java.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    names = spark.createDataFrame(list(enumerate(paths)), "i long, name string")
    copies = spark.read.format("binaryFile").load(folder).withColumn("i", F.regexp_extract("path", "[0-9]+$", 0).cast("long"))
    return copies.join(names, "i").select(F.col("name").alias("path"), "length", "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files under ``path``, or of one file.  The binary source
    leaves out empty files and names that begin with ``_`` or ``.``; these are listed on the
    driver and added."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    more = list(_left_out(spark, path))
    if empty := [(p, 0, b"") for p, n in more if not n]:
        found = found.union(spark.createDataFrame(empty, "path string, length long, content binary"))
    if hidden := [p for p, n in more if n]:
        found = found.union(_copied(spark, hidden))
    return found


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, length, text of the files that look like text."""
    return scan(spark, path).where(is_text(F.col("content"))).select("path", "length", decoded(F.col("content")).alias("text"))


def read_codecs(spark: SparkSession, path: str) -> DataFrame:
    """codec, token, slot of one codec file or of all ``*.edc`` under a folder."""

    def run(batches):
        for batch in batches:
            rows = [(Path(p).stem, *e) for p, x in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for e in layouts.read_codec(x)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], ["codec", "token", "slot"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.edc").load(path)
    return files.select("path", "content").mapInArrow(run, "codec string, token string, slot int")


def archive_entries(archives: DataFrame, content: bool = True) -> DataFrame:
    """One row per entry of ``archives`` (path, content); ord 0 is the metadata, unencoded.  Without
    ``content`` other entries have a null ``encoded``, and file archives are read by their headers.
    Entries leave in batches of at most BATCH_BYTES, or of one larger entry."""
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary())
    names = ["archive", "codec", "entry_type", "ord", "path", "enc_size", "encoded"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        for batch in batches:
            for p, x in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not content and x[4:5] != b"D":
                    codec, about, size, _ = layouts.read_header(x)
                    rows = [(p, codec, "F", 0, layouts.META_FILE, len(about), about), (p, codec, "F", 1, "", size, None)]
                else:
                    codec, kind, entries = layouts.read_archive(x)
                    rows = [(p, codec, kind, i, path, len(data), data if content or not i else None) for i, path, data in entries]
                held = 0
                for i, row in enumerate(rows):
                    size = len(row[-1] or b"") + len(row[4]) + 64
                    if i and held + size > BATCH_BYTES:
                        yield batch_of(rows[first:i])
                        held = 0
                    first, held = (first, held + size) if held else (i, size)
                yield batch_of(rows[first:])

    return archives.select("path", "content").mapInArrow(run, ENTRY)


def archive_heads(archives: DataFrame) -> DataFrame:
    """One row per archive of ``archives`` (path, content): its entries and their encoded bytes, both without the
    metadata, its metadata and its size, in one pass.  File archives are read by their headers."""
    return archives.select("path", "content").mapInArrow(heads, HEAD)


def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task of ``archive_heads``, over batches of paths and contents."""
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["archive", "codec", "entry_type", "entries", "encoded_bytes", "meta_bytes", "archive_bytes"]
    for batch in batches:
        rows = []
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x[4:5] == b"D":
                codec, _, entries = layouts.read_archive(x)
                about = next(entries, (0, "", None))[2]
                held = [len(data) for _, _, data in entries]
                rows.append((p, codec, "D", len(held), sum(held), about, len(x)))
            else:
                codec, about, size, _ = layouts.read_header(x)
                rows.append((p, codec, "F", 1, size, about, len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    return archive_entries(scan(spark, path), content)


def pack_directories(entries: DataFrame, preset: int = 9) -> DataFrame:
    """archive, content: one directory archive for each ``archive`` of (archive, codec, meta,
    path, encoded).  One XZ stream is serial, so an archive is one group by its format; for
    large corpora keep the encoded rows as Parquet."""

    def run(key, rows):
        files = list(zip(rows["path"].to_pylist(), rows["encoded"].to_pylist(), strict=True))
        data = layouts.write_directory_archive(rows["codec"][0].as_py(), rows["meta"][0].as_py(), files, preset)
        return pa.table({"archive": pa.array([key[0].as_py()], pa.string()), "content": pa.array([data], pa.binary())})

    return entries.select("archive", "codec", "meta", "path", "encoded").groupBy("archive").applyInArrow(run, "archive string, content binary")


def pack_files(rows: DataFrame, preset: int = 9) -> DataFrame:
    """archive, content: one file archive for each row of (archive, codec, meta, encoded)."""
    return rows.select("archive", "codec", "meta", "encoded").mapInArrow(lambda batches: packed(batches, preset), "archive string, content binary")


def packed(batches: Iterator[pa.RecordBatch], preset: int = 9) -> Iterator[pa.RecordBatch]:
    """The task of ``pack_files``."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("codec", "meta", "encoded"))
        data = [layouts.write_file_archive(*row, preset) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(data, pa.binary())], ["archive", "content"])


def find_codec(name: str, folder: str = "codecs") -> Path:
    """The file of that name, else ``folder/name.edc``, with or without ``.edc`` in ``name``; folders
    don't count."""
    for path in (Path(name), Path(folder) / f"{Path(name).name.removesuffix('.edc')}.edc"):
        if path.is_file():
            return path
    raise FileNotFoundError(f"no codec {name}")


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> _Done:
        from slotgram.functions.paths import checked

        done = []
        for row in rows:
            target = Path(self.root) / checked(row["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            part.write_bytes(row["content"])
            done.append((str(part), str(target)))
        return _Done(done)

    def commit(self, messages: list) -> None:
        for m in messages:
            for part, target in m.files if m else ():
                os.replace(part, target)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.files if m else ():
                Path(part).unlink(missing_ok=True)


class FilesSource(DataSource):
    """Sink of (path string, content binary); option ``path`` is the target folder."""

    @classmethod
    def name(cls) -> str:
        return "slotgram_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    files.sparkSession.dataSource.register(FilesSource)
    files.select("path", "content").write.format("slotgram_files").mode("append").save(folder)
