"""Log sources: preflight checks, byte-exact lines, plain text lines, directories, call filters, stage flows."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.streaming import DataStreamReader

from voxledger.functions.store import materialize

#: Limits of one batch and codes of files that fail them.
MAX_FILES = 100
MAX_FILE_BYTES = 500 * 1024 * 1024
FILE_CODES = ("FILE_UNAVAILABLE", "NOT_REGULAR_FILE", "FILE_NOT_READABLE", "EMPTY_FILE", "FILE_TOO_LARGE", "FILE_METADATA_ERROR", "FILE_OPEN_ERROR", "FILE_READ_ERROR", "BATCH_LIMIT_EXCEEDED")
ERRORS_SCHEMA = "file_token string, app string, code string"
SOURCES_SCHEMA = "file_token string, app string, path string, size_bytes long, mtime_ns long"


def check_file(path: str) -> str | None:
    """The code of what is wrong with a file, in the order: there, regular, readable, not empty, not too large."""
    p = Path(path)
    try:
        if not p.exists():
            return "FILE_UNAVAILABLE"
        if not p.is_file():
            return "NOT_REGULAR_FILE"
        if not os.access(p, os.R_OK):
            return "FILE_NOT_READABLE"
        size = p.stat().st_size
    except OSError:
        return "FILE_METADATA_ERROR"
    return "EMPTY_FILE" if size == 0 else "FILE_TOO_LARGE" if size > MAX_FILE_BYTES else None


def preflight(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(sources, errors) of (app, path) pairs; tokens follow the order given, failures are one by one."""
    sources, errors = [], []
    for i, (app, path) in enumerate(files, 1):
        token = f"<ARQUIVO_{i}>"
        if code := "BATCH_LIMIT_EXCEEDED" if i > MAX_FILES else check_file(path):
            errors.append((token, app, code))
        else:
            stat = os.stat(path)
            sources.append((token, app, str(Path(path).resolve()), stat.st_size, stat.st_mtime_ns))
    return spark.createDataFrame(sources, SOURCES_SCHEMA), spark.createDataFrame(errors, ERRORS_SCHEMA)


def _in_ranges(column: str, extra: int, flag: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a scan with their number and the bytes up to them within their file's range, and how many rows up to them
    have `flag`: a task reads a range from its beginning to its end, so this needs no shuffle. `extra` bytes end each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            paths, starts = batch.column("path"), batch.column("block").to_numpy()
            of = paths.dictionary_encode().indices.to_numpy()
            new = np.ones(n, bool)
            new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1])
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            sizes = batch.column(column)
            sizes = pc.fill_null(sizes if pa.types.is_integer(sizes.type) else pc.binary_length(sizes), 0)
            counted = {"line_in": np.ones(n, np.int64), "end_in": sizes.to_numpy(zero_copy_only=False).astype(np.int64) + extra}
            if flag:
                counted["flag_in"] = batch.column(flag).to_numpy(zero_copy_only=False).astype(np.int64)
            on = (paths[0].as_py(), int(starts[0])) == at
            for name, each in counted.items():
                up = np.cumsum(each)
                up -= (up - each)[first][own]
                if on:
                    up[own == 0] += before[name]
                counted[name] = up
            at, before = (paths[n - 1].as_py(), int(starts[-1])), {name: int(up[-1]) for name, up in counted.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counted.values())], names=[*batch.schema.names, *counted])

    return run


def in_ranges(raw: DataFrame, column: str, extra: int, flag: str | None = None) -> DataFrame:
    """raw (path, block, and `column`: bytes or their number) with line_in and end_in, and flag_in if a flag is named."""
    added = [T.StructField(n, T.LongType()) for n in ("line_in", "end_in", *(["flag_in"] if flag else []))]
    return raw.mapInArrow(_in_ranges(column, extra, flag), T.StructType([*raw.schema.fields, *added]))


def _numbered(raw: DataFrame, column: str, extra: int) -> DataFrame:
    """raw (path, block and more) with `line_no` and `end`: what each range holds is counted in one scan, and a second
    scan adds what the ranges before it hold. Only a row for each range is shuffled, never a line."""
    counted = in_ranges(raw, column, extra)
    each = counted.groupBy("path", "block").agg(F.max("line_in").alias("lines"), F.max("end_in").alias("bytes"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shift = each.select(F.col("path").alias("__path"), F.col("block").alias("__block"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")])
    # a row for each range of at most MAX_FILES files of at most MAX_FILE_BYTES: a few thousand
    placed = counted.join(F.broadcast(materialize(shift)), (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    added = {"line_no": F.col("line_in") + F.col("lines_before"), "end": F.col("end_in") + F.col("bytes_before")}
    return placed.withColumns(added).drop("__path", "__block", "line_in", "end_in", "lines_before", "bytes_before")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines cut at LF, CR or CRLF, undecodable bytes replaced: line_no and text for each path."""
    raw = spark.read.text(path).select(F.make_valid_utf8("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return _numbered(raw, "text", 0).select("text", "path", "line_no")


@arrow_udf(T.IntegerType())
def _bad_byte(line: pa.Array) -> pa.Array:
    """Where the first byte stands that isn't UTF-8; null if none is."""
    out = []
    for b in line.to_pylist():
        try:
            out.append(b and b.decode() and None)
        except UnicodeDecodeError as e:
            out.append(e.start)
    return pa.array([x if isinstance(x, int) else None for x in out], pa.int32())


def raw_lines(reader: DataFrameReader | DataStreamReader, path: str | list[str]) -> DataFrame:
    """Lines as they are read, with their bytes `b`, their file and its range. Splitting at LF alone keeps a CR with its
    line, and the reader keeps a line's raw bytes."""
    raw = reader.option("lineSep", "\n").text(path)
    return raw.select(F.col("value").cast("binary").alias("b"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of files, see byte_lines()."""
    return byte_lines(raw_lines(spark.read, path))


def byte_lines(line: DataFrame) -> DataFrame:
    """raw_lines() with their bytes: path, line_no, start_byte, end_byte (with the terminator),
    text (null where it isn't UTF-8), terminator, sha256 of the line's bytes, decodable, and bad_byte: the place in the
    file of the first byte of the line that isn't UTF-8.
    """
    return typed_lines(_numbered(line, "b", 1))


def typed_lines(numbered: DataFrame, *more: str) -> DataFrame:
    """The columns of byte_lines(), and `more`, of lines (b, path, size) whose number and end in their file are known."""
    line = numbered.withColumns({"value": F.col("b").cast("string"), "start": F.col("end") - F.octet_length("b") - 1})
    closed = F.col("end") <= F.col("size")
    cr = F.col("value").endswith("\r")
    terminator = F.when(~closed, "").when(cr, "\r\n").otherwise("\n")
    valid = F.is_valid_utf8("value")
    body = F.when(closed & cr, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    ending = F.when(closed, F.lit(b"\n")).otherwise(F.lit(b""))
    bad = F.col("start") + F.when(~valid, _bad_byte(F.when(~valid, F.col("b"))))
    return line.select(
        "path", "line_no", F.col("start").alias("start_byte"), F.least("end", "size").alias("end_byte"), F.when(valid, body).alias("text"), terminator.alias("terminator"),
        F.sha2(F.concat("b", ending), 256).alias("sha256"), valid.alias("decodable"), bad.alias("bad_byte"), *more,
    )


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path, size, modification time and sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), "modificationTime", F.sha2("content", 256).alias("sha256"))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size, time or digest isn't what it was, or that are gone: no entry of theirs may be used."""
    same = ["path", "size_bytes", "modificationTime", "sha256"]
    return before.join(after.select(*same), same, "left_anti").select("path", F.lit("SOURCE_CHANGED").alias("code"))


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of files, sorted by file: a file is opened once."""
    at, file = None, None
    for batch in batches:
        out = []
        for path, start, end, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "start_byte", "end_byte", "sha256")), strict=True):
            try:
                if path != at:
                    at, file = path, None
                    store, name = fs.FileSystem.from_uri(path)
                    file = store.open_input_file(name)
                data = file.read_at(end - start, start) if file else None
            except (OSError, ValueError):
                data = None
            if data is None:
                out.append((None, "FILE_READ_ERROR"))
            elif len(data) == end - start and hashlib.sha256(data).hexdigest() == digest:
                out.append((data, None))
            else:
                out.append((None, "SOURCE_CHANGED"))
        yield pa.RecordBatch.from_arrays([batch.column("entry_id"), pa.array([d for d, _ in out], pa.binary()), pa.array([c for _, c in out], pa.string())], names=["entry_id", "data", "code"])


def reread(selected: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """entry_id, text and code of selected entries (path, entry_id, start_byte, end_byte, sha256) from a second read of
    their bytes alone.

    An entry whose bytes have another digest now is SOURCE_CHANGED, and others of its file aren't affected; a file that
    can't be opened is FILE_READ_ERROR. Ranges that lie near one another are read by one task. text is null where it
    isn't UTF-8.
    """
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = selected.select("path", "entry_id", "start_byte", "end_byte", "sha256")
    dealt = own.repartition(n, "path", F.floor(F.col("start_byte") / chunk)).sortWithinPartitions("path", "start_byte")
    read = dealt.mapInArrow(_read_ranges, "entry_id string, data binary, code string")
    text = F.col("data").cast("string")
    return read.select("entry_id", F.when(F.is_valid_utf8(text), text).alias("text"), "code")


def log_files(directory: str) -> list[str]:
    """Log files in a directory (`.log`, `.gz`, the orchestrator's name, or `.log.` in it), last path first."""
    names = [n for n in os.listdir(directory) if n.endswith((".log", ".gz")) or "olos-ai-orchestrator" in n or ".log." in n]
    paths = [os.path.join(directory, n) for n in names]
    return sorted((p for p in paths if os.path.isfile(p)), reverse=True)


def flow_files(directory: str) -> list[str]:
    """Flow documents (`.json`) in a directory, in order; none if it isn't one."""
    names = sorted(os.listdir(directory)) if os.path.isdir(directory) else []
    return [n for n in names if n.endswith(".json") and os.path.isfile(os.path.join(directory, n))]


def call_id_problem(call_id: Column) -> Column:
    """What is wrong with an orchestrator call id, null if nothing: it has 16 hexadecimal digits."""
    plain = F.trim(F.coalesce(call_id, F.lit("")))
    return F.when(plain == "", "EMPTY").when(F.length(plain) != 16, "LENGTH").when(~plain.rlike("^[0-9a-fA-F]{16}$"), "NOT_HEXADECIMAL")


def call_lines(lines: DataFrame, call_id: str) -> DataFrame:
    """Lines that hold the call's id: a case-sensitive substring, tested before any pattern."""
    return lines.where(F.contains("text", F.lit(call_id)))


FLOW_SCHEMA = "flows array<struct<name:string, type:string, nodes:array<struct<name:string, promptText:string>>>>"


def flow_stages(spark: SparkSession, path: str) -> DataFrame:
    """Stages of flow documents in node order: path, pos, name, version, instruction.

    The flow named "Stages Module" is taken, else the first whose type isn't "start"; a document that isn't
    of this form has no stages.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", FLOW_SCHEMA).alias("d"))
    named = F.filter("d.flows", lambda f: f["name"] == "Stages Module")
    other = F.filter("d.flows", lambda f: F.coalesce(f["type"], F.lit("")) != "start")
    flow = F.coalesce(F.get(named, F.lit(0)), F.get(other, F.lit(0)))
    node = text.select("path", F.posexplode(flow["nodes"]).alias("pos", "node")).where("trim(node.name) <> ''")
    prompt = F.from_json("node.promptText", "instruction string, name string, value string, label string")
    version = F.coalesce(F.get(F.regexp_extract_all(prompt["name"], F.lit(r"(?i)(v\d+(?:\.\d+)*)"), F.lit(1)), F.lit(0)), F.lit(None).cast("string"))
    return node.select("path", "pos", F.col("node.name").alias("name"), version.alias("version"), F.coalesce(prompt["instruction"], F.when(~F.col("node.promptText").startswith("{"), F.col("node.promptText"))).alias("instruction"))
