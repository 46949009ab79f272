"""Following growing log directories with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxledger.functions.store import remove, scratch
from voxledger.operators import blocks, stats
from voxledger.plans.registry import Application
from voxledger.sources import logs


def follow(spark: SparkSession, directory: str, per_trigger: int = 100) -> DataFrame:
    """Lines of files as they appear in a directory: path and text."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(directory)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))


def activity(lines: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Lines, calls and errors in windows of event time; lines later than the watermark are left out."""
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract("text", stats.STAMP, 1), F.lit("")))
    call = F.nullif(F.regexp_extract("text", stats.CALL, 1), F.lit(""))
    dated = lines.select(ts.alias("ts"), call.alias("call_id"), F.contains("text", F.lit("ERROR -")).alias("error")).where("ts is not null")
    each = dated.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"))
    return each.agg(F.count(F.lit(1)).alias("lines"), F.approx_count_distinct("call_id").alias("calls"), F.count_if("error").alias("errors")).select("w.start", "w.end", "lines", "calls", "errors")


def call_sessions(lines: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """A row for each call and pause-free stretch of its lines."""
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract("text", stats.STAMP, 1), F.lit("")))
    dated = lines.select(ts.alias("ts"), F.nullif(F.regexp_extract("text", stats.CALL, 1), F.lit("")).alias("call_id")).where("ts is not null and call_id is not null")
    each = dated.withWatermark("ts", late).groupBy("call_id", F.session_window("ts", gap).alias("s"))
    return each.agg(F.count(F.lit(1)).alias("lines")).select("call_id", "s.start", "s.end", "lines")


def _number(path: str) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(1 << 53))


def _token(path: str) -> Column:
    return F.format_string("<ARQUIVO_%d>", _number(path))


def _tokened(lines: DataFrame, app: Application, path: str) -> DataFrame:
    """Lines with application and token, which follows from the path alone, and what kind of line they are."""
    own = lines.withColumns({"file_token": _token(path), "app": F.lit(app.app_id)})
    return blocks.with_start_kind(own) if app.has_blocks else own


def entries_of(lines: DataFrame, app: Application) -> DataFrame:
    """Entries of an application's lines (byte_lines())."""
    marked = _tokened(lines, app, "path")
    return app.parse(blocks.blocks(marked) if app.has_blocks else marked)


def store_entries(spark: SparkSession, directory: str, app: Application, out: str, checkpoint: str, per_trigger: int = 100) -> StreamingQuery:
    """Follow a directory to which whole files are added: each file's entries go to `out` once, as one batch read of all
    files would give them. A file is read when it appears, so blocks never span batches. What a batch writes is in a
    folder of its own, which a restart that repeats the batch replaces."""

    def store(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            entries_of(logs.byte_lines(batch), app).write.mode("overwrite").parquet(f"{out}/batch={number}")

    raw = logs.raw_lines(spark.readStream.option("maxFilesPerTrigger", per_trigger), directory)
    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The path of a part of a growing file: the file, and the part's number from 0 on.
PART = r"^(.+)\.(\d+)$"
#: What one batch leaves to the next: how far each file has been read (`part` is null) and what each part that waits holds, and
#: the lines that are needed once more. `closed` counts a file's closed blocks, `open_from` is the first line of its open one.
#: `first_header` and `last_header` are lines of the part, `headers` of a line counts those of its part up to it. The lines of
#: parts that wait are written once, by the batch `held` that they came in. A row that tells nothing but `held` names lines that
#: the batch before was the last to need.
FILES = "file string, next_part long, lines long, bytes long, closed long, open_from long, part long, headers long, first_header long, last_header long, held long"
LINES = "file string, part long, line_no long, start_byte long, end_byte long, text string, terminator string, headers long, start_kind string"
#: Where a range of a part, or a part that has waited, stands: what lies before it, and how its blocks are numbered.
PLACES = "place long, path string, block long, file string, part long, lines_in long, bytes_in long, headers_in long, ready boolean, lines_before long, bytes_before long, orphans_from long, blocks_from long, last_line long, open_from long"


@dataclass
class _Part:
    """What a part holds, and where its ranges stand in it: (path, block, lines, bytes and headers before). One that has waited
    has none: its lines know their places, and are `held` by the batch that it came in."""

    file: str
    part: int
    lines: int = 0
    bytes: int = 0
    headers: int = 0
    first_header: int | None = None
    last_header: int | None = None
    held: int | None = None
    ranges: list[tuple] = field(default_factory=list)

    def add(self, r: Row) -> None:
        self.ranges.append((r["path"], r["block"], self.lines, self.bytes, self.headers))
        if r["headers"]:
            self.first_header = self.first_header or self.lines + r["first"]
            self.last_header = self.lines + r["last"]
        self.lines, self.bytes, self.headers = self.lines + r["lines"], min(self.bytes + r["bytes"], r["size"]), self.headers + r["headers"]


def _parts(ranges: list[Row]) -> list[_Part]:
    """The parts that a batch's ranges make up; of paths that tell the same part the first counts."""
    found: dict[tuple[str, int], tuple[str, _Part]] = {}
    for r in sorted(ranges, key=lambda r: (r["path"], r["block"])):
        path, own = found.setdefault((r["file"], r["part"]), (r["path"], _Part(r["file"], r["part"])))
        if path == r["path"]:
            own.add(r)
    return [own for _, own in found.values()]


def _in_turn(known: list[Row], arrived: list[_Part], has_blocks: bool) -> tuple[list[dict], list[tuple], list[_Part]]:
    """(files, places, waiting): how far the files of a batch are after it, where its ranges and the parts whose turn has come
    stand, and which parts wait: a part's turn comes once all before it are there. Each header opens a block; lines before a file's first one are
    orphans, a block each.

    A row for each part of one batch and each part of its files that waits, as the stream itself lists them on the driver."""
    now = {r["file"]: {n: r[n] for n in ("file", "next_part", "lines", "bytes", "closed", "open_from")} for r in known if r["next_part"] is not None}
    queue = {(r["file"], r["part"]): _Part(*[r[n] for n in ("file", "part", "lines", "bytes", "headers", "first_header", "last_header", "held")]) for r in known if r["part"] is not None}
    for p in arrived:
        queue.setdefault((p.file, p.part), p)
    placed, waiting = [], []
    for p in sorted(queue.values(), key=lambda p: (p.file, p.part)):
        at = now.setdefault(p.file, {"file": p.file, "next_part": 0, "lines": 0, "bytes": 0, "closed": 0, "open_from": None})
        if p.part < at["next_part"]:
            continue
        if p.part > at["next_part"]:
            waiting.append(p)
            if p.ranges:
                placed.append((p, False, 0, 0, None, None))
            continue
        lead = (p.first_header - 1 if p.headers else p.lines) if at["open_from"] is None else None
        orphans = None if lead is None else at["closed"]
        blocks_from = at["closed"] if lead is None else at["closed"] + lead - 1
        placed.append((p, True, at["lines"], at["bytes"], orphans, blocks_from))
        if not has_blocks:
            at["closed"] += p.lines
        else:
            at["closed"] = blocks_from + p.headers if p.headers or lead is None else at["closed"] + lead
            at["open_from"] = at["lines"] + p.last_header if p.headers else at["open_from"]
        at.update(next_part=p.part + 1, lines=at["lines"] + p.lines, bytes=at["bytes"] + p.bytes)
    places = []
    for p, ready, lines, size, orphans, blocks_from in placed:
        for path, block, *inside in p.ranges or [(None, None, 0, 0, 0)]:
            places.append((len(places), path, block, p.file, p.part, *inside, ready, lines, size, orphans, blocks_from, lines + p.lines, now[p.file]["open_from"]))
    return list(now.values()), places, waiting


def _told(batch: DataFrame, app: Application) -> DataFrame:
    """raw_lines() with their start_kind, and whether they are headers."""
    if not app.has_blocks:
        return batch.withColumns({"start_kind": F.lit(None).cast("string"), "header": F.lit(False)})
    value = F.col("b").cast("string")
    body = F.when(value.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    text = batch.withColumn("value", value).withColumns({"text": F.when(F.is_valid_utf8("value"), body), "app": F.lit(app.app_id)})
    return blocks.with_start_kind(text).withColumn("header", F.col("start_kind") != blocks.CONTINUATION).drop("value", "text", "app")


def _ranges(batch: DataFrame, app: Application, part: str) -> list[Row]:
    """What each range of a batch's parts holds. A row for each, of at most a batch's files."""
    narrow = _told(batch, app).select("path", "block", "size", F.octet_length("b").alias("n"), "header")
    header = F.when(F.col("header"), F.col("line_in"))
    each = logs.in_ranges(narrow, "n", 1, "header").groupBy("path", "block", "size").agg(
        F.max("line_in").alias("lines"), F.max("end_in").alias("bytes"), F.max("flag_in").alias("headers"), F.min(header).alias("first"), F.max(header).alias("last"),
    )
    of = {"file": F.regexp_extract("path", part, 1), "part": F.regexp_extract("path", part, 2).try_cast("long")}
    return each.withColumns(of).where("part is not null").collect()


def _arrived(batch: DataFrame, places: DataFrame, app: Application) -> DataFrame:
    """The lines of a batch that stand at `places`, numbered within their parts, with what is told of their part."""
    here = batch.join(F.broadcast(places.select("path", "block", "place")), ["path", "block"])
    counted = logs.in_ranges(_told(here.select("b", "size", "block", F.col("place").alias("path")), app), "b", 1, "header")
    inside = {"line_no": F.col("line_in") + F.col("lines_in"), "end": F.col("end_in") + F.col("bytes_in"), "headers": F.col("flag_in") + F.col("headers_in")}
    told = counted.withColumnRenamed("path", "place").join(F.broadcast(places.drop("block")), "place").withColumns(inside)
    return logs.typed_lines(told, "file", "part", "headers", "start_kind", *_OF_PART).drop("path", "sha256", "decodable", "bad_byte")


#: What is told of a part to its lines.
_OF_PART = ("ready", "lines_before", "bytes_before", "orphans_from", "blocks_from", "open_from")


def _moved(lines: DataFrame) -> DataFrame:
    """Lines of ready parts with their places in their files and the block they are in."""
    orphan = (F.col("headers") == 0) & F.col("orphans_from").isNotNull()
    order = F.when(orphan, F.col("orphans_from") + F.col("line_no") - 1).otherwise(F.col("blocks_from") + F.col("headers"))
    moved = lines.where("ready").withColumn("read_order", order)
    return moved.withColumns({"line_no": F.col("line_no") + F.col("lines_before"), "start_byte": F.col("start_byte") + F.col("bytes_before"), "end_byte": F.col("end_byte") + F.col("bytes_before")})


def _table(session: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    columns = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return session.createDataFrame(pa.table([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns]))


class _Batch:
    """One batch of the growing files of an application: `entries` of files that have grown (None if none has), and what the
    next one needs to know: `files`, `lines` of open blocks, and `waiting` lines (None if no part of the batch has to wait).

    Two scans of a batch's lines make its entries: one counts what each range holds; then the place of each line and its block
    are known. `held` names the folder of the waiting lines of a batch and a file's number.
    """

    def __init__(self, batch: DataFrame, number: int, files: DataFrame, opened: DataFrame, app: Application, part: str, held: Callable[[int, int], str]):
        session = batch.sparkSession
        ranges = _ranges(batch, app, part)
        named = _table(session, sorted({(r["file"],) for r in ranges}), "file string")
        rows = files.join(F.broadcast(named.withColumn("own", F.lit(True))), "file", "left").where("own or coalesce(next_part, part) is null").withColumn("of", _number("file")).collect()
        self.unneeded = [held(r["held"], r["of"]) for r in rows if r["next_part"] is None and r["part"] is None]
        known = [r for r in rows if r["own"]]
        now, placed, waiting = _in_turn(known, _parts(ranges), app.has_blocks)
        for p in waiting:
            p.held = number if p.held is None else p.held
        wait = {(p.file, p.part) for p in waiting}
        taken = [r for r in known if r["part"] is not None and (r["file"], r["part"]) not in wait]
        freed = {(r["file"], r["held"]) for r in taken} - {(p.file, p.held) for p in waiting}
        none = [None] * 9
        told = [(*f.values(), *none[:5]) for f in now] + [(p.file, None, p.lines, p.bytes, None, None, p.part, p.headers, p.first_header, p.last_header, p.held) for p in waiting]
        told = _table(session, told + [(file, *none, n) for file, n in freed], FILES)
        self.files = files.join(F.broadcast(named), "file", "left_anti").where("coalesce(next_part, part) is not null").unionByName(told)
        places = _table(session, placed, PLACES)
        self.waiting = _arrived(batch, places.where("not ready"), app).select(*opened.columns) if any(not p[8] for p in placed) else None
        self.entries, self.lines = None, opened
        if number and not any(p[8] for p in placed):
            return
        folders = sorted({held(r["held"], r["of"]) for r in taken})

        def grown(ready: DataFrame) -> DataFrame:
            out = _arrived(batch, ready, app)
            if folders:
                waited = session.read.schema(LINES).parquet(*folders)
                out = out.unionByName(waited.join(F.broadcast(ready.where("path is null").select("file", "part", *_OF_PART)), ["file", "part"]))
            return _moved(out)

        ready = places.where("ready")
        tokens = F.broadcast(named.withColumns({"file_token": _token("file"), "app": F.lit(app.app_id)}))
        at = ["file", "line_no", "start_byte", "end_byte", "text", "terminator", "start_kind", "read_order"]
        new = grown(ready).select(*at)
        if not app.has_blocks:
            self.entries = app.parse(new.join(tokens, "file").drop("file", "start_kind", "read_order"))
            return
        # open blocks are written again when they have grown
        grew = ready.select("file").distinct().join(_table(session, [(r["file"], r["closed"]) for r in known if r["next_part"] is not None], "file string, read_order long"), "file")
        new = new.unionByName(opened.join(F.broadcast(grew), "file").select(*at))
        self.entries = app.parse(blocks.joined(new.join(tokens, "file").drop("file")))
        last = grown(ready.where("open_from <= last_line")).where("line_no >= open_from").withColumns({"part": F.lit(None).cast("long"), "headers": F.lit(None).cast("long")})
        since = told.where("next_part is not null").select("file", F.col("open_from").alias("since"))
        still = opened.join(F.broadcast(since), "file", "left").where("since is null or line_no >= since")
        self.lines = still.select(*opened.columns).unionByName(last.select(*opened.columns))


def store_growing(spark: SparkSession, directory: str, app: Application, out: str, checkpoint: str, per_trigger: int = 100, part: str = PART) -> StreamingQuery:
    """Follow a directory to which files are added in numbered parts: entries come out as one read of the whole files
    would give them, blocks that span parts, line numbers and bytes included (see entries_so_far()).

    `part` matches the path of a part and tells file and number. Parts may come in any order; one waits until all before it
    are there, and one that was taken before is left out. They hold whole lines and aren't empty. A batch writes the
    entries of what it could place, a file's open block too, and what the next one needs: how far each file is, the lines of
    its open block, and those of its parts that have to wait, which stay where they are until their turn comes. All are in
    folders of the batch, which a restart that repeats it replaces, and what is kept grows with open blocks and waiting parts,
    not with the files. An open block is written again when it has grown.
    """

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = lambda n, name: f"{out}/state/batch={n}/{name}"
        if number:
            files, opened = session.read.schema(FILES).parquet(state(number - 1, "files")), session.read.schema(LINES).parquet(state(number - 1, "lines"))
        else:
            files, opened = session.createDataFrame([], FILES), session.createDataFrame([], LINES)
        new = _Batch(batch, number, files, opened, app, part, lambda n, of: f"{out}/waiting/batch={n}/of={of}")
        if new.entries is not None:
            new.entries.write.mode("overwrite").parquet(f"{out}/entries/batch={number}")
        if new.waiting is not None:
            new.waiting.withColumn("of", _number("file")).write.mode("overwrite").partitionBy("of").parquet(f"{out}/waiting/batch={number}")
        new.files.coalesce(1).write.mode("overwrite").parquet(state(number, "files"))
        new.lines.write.mode("overwrite").parquet(state(number, "lines"))
        for path in new.unneeded:
            remove(session, path)
        remove(session, f"{out}/state/batch={number - 2}")  # repeating this batch takes the one before

    raw = logs.raw_lines(spark.readStream.option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true"), directory)
    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The entries that store_growing() has written for block applications: of an entry that was open in several batches, the
    last and longest form. Only a file's open block is written again, so a batch's entries hold up to where the next one that
    has the file begins: a row for each file of a batch tells that, and no entry is shuffled."""
    rows = spark.read.parquet(f"{out}/entries")
    begun = rows.groupBy("file_token", "batch").agg(F.min("read_order").alias("first"))
    until = begun.select("file_token", "batch", F.lead("first").over(W.partitionBy("file_token").orderBy("batch")).alias("until"))
    return rows.join(F.broadcast(until), ["file_token", "batch"]).where("until is null or read_order < until").drop("batch", "until")
