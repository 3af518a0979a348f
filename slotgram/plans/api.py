"""The operations a user runs: train, list, pack, unpack, summarize."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotgram.functions import codec, meta
from slotgram.functions.text import decoded
from slotgram.operators import inspect, vocab
from slotgram.shipping import ship
from slotgram.sources import files, layouts


def train(spark: SparkSession, source: str, name: str, output: str = "codecs", min_freq: int = 5, min_len: int = 3, max_len: int = 16) -> DataFrame:
    """Learns a codec from the text files under ``source``; writes ``name.edc`` and
    ``name.json`` to ``output`` and returns the vocabulary."""
    ship(spark)
    corpus = files.text_corpus(spark, source)
    if corpus.isEmpty():
        raise ValueError(f"no text files in {source}")
    learned = vocab.train(corpus, min_len, max_len, min_freq)
    save_codec(learned, name, output)
    return learned


def save_codec(learned: DataFrame, name: str, output: str = "codecs") -> None:
    """At most 3,570 rows reach the driver."""
    entries = sorted(codec.vocab_map(learned).items(), key=lambda x: x[1])
    sidecar = json.dumps({"flag_byte": "0x1", "vocab": {str(s): t for t, s in entries}}, ensure_ascii=False, indent=2)
    spark = learned.sparkSession
    files.write_files(spark.createDataFrame([(f"{name}.edc", layouts.write_codec(entries)), (f"{name}.json", sidecar.encode())], "path string, content binary"), output)


def load_codec(spark: SparkSession, name: str, folder: str = "codecs") -> DataFrame:
    return files.read_codecs(spark, str(files.find_codec(name, folder)))


def list_codecs(spark: SparkSession, folder: str = "codecs") -> DataFrame:
    return vocab.catalog(files.read_codecs(spark, folder)).orderBy("codec")


def pack(spark: SparkSession, source: str, name: str, target: str, folder: str = "codecs", preset: int = 9, strict: bool = False, at: dt.datetime | None = None) -> str:
    """Packs a file or folder into ``target``; returns the archive's path, which is the source's
    name with ``.eda``.  ``strict`` refuses files whose bytes would not survive (invalid UTF-8, CR
    line ends); ``at`` is the UTC time to note (default: now)."""
    ship(spark)
    path, is_dir = Path(source), Path(source).is_dir()
    rows = files.scan(spark, source)
    if rows.isEmpty():
        raise ValueError(f"nothing to pack in {source}")
    rows = rows.select("path", "length", decoded(F.col("content")).alias("text"))
    if strict and not rows.where(F.octet_length("text") != F.col("length")).isEmpty():
        raise ValueError("some files would not survive packing byte by byte")
    name = files.find_codec(codec_ := name, folder).stem
    about = meta.build_meta(F.lit(name), F.lit(path.name), F.lit(is_dir), F.lit(path.suffix), F.lit(at or dt.datetime.now(dt.UTC).replace(tzinfo=None)))
    encoded = codec.encode(rows, load_codec(spark, codec_, folder), ["path"])
    root = path.resolve().as_uri().removeprefix("file://")
    local = F.regexp_replace("path", "^file:(//)?", "")
    out = f"{path.name}{meta.SUFFIX}"
    described = encoded.select(F.lit(out).alias("archive"), F.lit(name).alias("codec"), about.alias("meta"), meta.relative_path(local, F.lit(root)).alias("path"), "encoded")
    packed = files.pack_directories(described, preset) if is_dir else files.pack_files(described, preset)
    files.write_files(packed.select(F.col("archive").alias("path"), "content"), target)
    return str(Path(target) / out)


def unpack(spark: SparkSession, archive: str, target: str, name: str | None = None, folder: str = "codecs") -> DataFrame:
    """Restores the files of an archive, or of all archives that a folder or pattern names, under
    ``target``; returns path and text.  Each archive is decoded with the codec that it names, unless
    ``name`` overrides that.  A folder's metadata comes back as a file, unless it held one of that name."""
    ship(spark)
    entries = files.read_archives(spark, archive)
    stem = meta.codec_name(F.col("archive"))
    heads = entries.where("ord = 0").withColumn("meta", meta.parse_meta(F.decode("encoded", "UTF-8")))
    single = meta.unpacked_name(F.col("archive"), F.lit(False), F.col("meta")["source_name"], F.col("meta")["source_extension"])
    names = heads.select(F.col("archive").alias("of"), F.when(F.col("entry_type") == "D", F.concat(stem, F.lit("/"))).otherwise(single).alias("base"))
    texts = None
    for used in [name] if name else sorted(r[0] for r in heads.select("codec").distinct().collect()):  # as many as there are codecs
        own = entries.where("ord > 0") if name else entries.where("ord > 0").where(F.col("codec") == used)
        part = codec.decode(own, load_codec(spark, used if name else _plain(used), folder), ["archive", "path"])
        texts = part if texts is None else texts.union(part)
    if texts is None:
        raise ValueError(f"no archive at {archive}")
    texts = texts.join(names, F.col("archive") == F.col("of")).select(F.concat("base", "path").alias("path"), "text")
    about = heads.where("entry_type = 'D'").select(F.concat(stem, F.lit("/"), "path").alias("path"), F.decode("encoded", "UTF-8").alias("text"))
    texts = texts.union(about.join(texts.select("path"), "path", "left_anti"))
    files.write_files(texts.select("path", F.encode("text", "UTF-8").alias("content")), target)
    return texts


def _plain(name: str) -> str:
    if "/" in name or "\\" in name or name in ("", ".", ".."):
        raise ValueError(f"an archive may not name a codec by path: {name!r}")
    return name


def summarize(spark: SparkSession, archive: str) -> DataFrame:
    """One row for each archive, with sizes also as text; file archives are read by their headers."""
    ship(spark)
    found = inspect.summary_of_heads(files.archive_heads(files.scan(spark, archive)))
    return found.withColumns({"archive_size": meta.megabytes(F.col("archive_bytes")), "encoded_size": meta.megabytes(F.col("encoded_bytes"))})


def list_entries(spark: SparkSession, archive: str) -> DataFrame:
    """archive, ord, path, enc_size of the files that archives hold, in their order."""
    ship(spark)
    return files.read_archives(spark, archive, content=False).where("ord > 0").select("archive", "ord", "path", "enc_size").orderBy("archive", "ord")
