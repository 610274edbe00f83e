"""Raw archives: hour files of JSON lines, perhaps compressed, torn or damaged.

Layout: ``<instrument>/raw/<day>/<channel>-<HH>[.rNNN].jsonl.gz``; a line is
``{"t": receive ms, "n": sequence, "m": message}``.  What the path says becomes
columns and prunes files before any is read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a damaged file that go on at a time.
LINES = 10_000
LINE = "t long, n long, m string, _corrupt string"
PATH = r"([^/]+)/raw/(\d{4}-\d{2}-\d{2})/(.+)-(\d{2})(?:\.r(\d+))?\.jsonl(?:\.gz)?$"


def path_columns(path: Column) -> dict[str, Column]:
    """instrument, day, channel, hour and restart of a file's path; a channel's name may have dashes."""
    part = lambda i: F.regexp_extract(path, PATH, i)
    return {"instrument": part(1), "day": part(2).try_cast("date"), "channel": part(3), "hour": part(4).try_cast("int"), "restart": F.coalesce(part(5).try_cast("int"), F.lit(0))}


def _glob(instrument: str | None, day: str | None, channel: str | None) -> str:
    return f"{instrument or '*'}/raw/{day or '*'}/{channel or '*'}-[0-9][0-9]*"


def read_lines(spark: SparkSession, root: str, instrument: str | None = None, day: str | None = None, channel: str | None = None) -> DataFrame:
    """Lines of clean archives, by Spark's own text reader: the quick way.  Filters become a glob, so other files aren't opened."""
    lines = spark.read.text(f"{root}/{_glob(instrument, day, channel)}").withColumn("path", F.col("_metadata.file_path"))
    return lines.select(F.col("value").alias("line"), "path")


def read_torn(spark: SparkSession, root: str, instrument: str | None = None, day: str | None = None, channel: str | None = None) -> DataFrame:
    """path, line_no, line, damage, at: every line that can be saved of damaged files, and a row for each damage (line null).  A file is a task's unit."""
    return recovered(spark.read.format("binaryFile").load(f"{root}/{_glob(instrument, day, channel)}").select("path", "content"))


def recovered(files: DataFrame) -> DataFrame:
    """line_no, line, damage, at of ``files`` (a string that names a file, and its content; none where that is null), some lines at a time: a task holds a file, not its lines."""
    name = next(c for c in files.columns if c != "content")

    def lines(batches):
        for batch in batches:
            for path, content in zip(batch.column(name).to_pylist(), batch.column("content"), strict=True):
                found = recover(content.as_py()) if content.is_valid else iter(())
                while rows := list(itertools.islice(found, LINES)):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))], [name, "line_no", "line", "damage", "at"])

    return files.mapInArrow(lines, f"{name} string, line_no long, line string, damage string, at long")


@F.udtf(returnType="line_no: bigint, line: string, damage: string, at: bigint")
class RecoverLines:
    """The table function of ``recover``: a row for each line that can be saved of a file's bytes, and for each damage."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from recover(bytes(content))


def register_recovery(spark: SparkSession) -> None:
    """``select * from files, lateral recover_lines(content)``"""
    spark.udtf.register("recover_lines", RecoverLines)


MAGIC = b"\x1f\x8b\x08"
BLOCK, PIECE = 1 << 16, 1 << 18


def recover(content: bytes):
    """(line_no, line, damage, at) of a file of gzip members: whole members give their lines, damaged ones what comes before the damage.

    tail: the last member lacks its end; torn: a member stops where another begins; corrupt: a member's data are wrong; junk: bytes between members.
    The line_no of a damage is the number of lines saved up to it."""
    if not content.startswith(MAGIC) and MAGIC not in content:
        for i, line in enumerate(content.decode("utf-8", "replace").splitlines()):
            yield i, line, None, None
        return
    view, at, number, found = memoryview(content), 0, 0, []
    while at < len(content):
        if content[at : at + 3] != MAGIC:
            nxt = content.find(MAGIC, at)
            end = nxt if nxt >= 0 else len(content)
            found.append(("junk", at, number))
            at = end
            continue
        size, ended, error = _member(view, at)
        if error is None and ended is not None:
            step = ended - at
        else:
            nxt = content.find(MAGIC, at + 3)
            if nxt > 0:  # another member begins before this one ends
                size, _, broken = _member(view[:nxt], at)
                error, step = "corrupt" if broken else "torn", nxt - at
            else:
                error, step = error or "tail", len(content) - at
        for line in _lines(view[: at + step], at, size, error is None):
            yield number, line, None, None
            number += 1
        if error:
            found.append((error, at, number))
        at += step
    for kind, where, before in found:
        yield before, None, kind, where


def _data(view: memoryview, at: int) -> Iterator[tuple[bytes, int | None, str | None]]:
    """What a gzip member holds, block by block, so that each byte is read about once; last of all where it ends (None: it doesn't), and "corrupt" where its data are
    wrong.  A block is unpacked in pieces, however much it holds."""
    reader, where, held = zlib.decompressobj(31), at, 0
    while where < len(view):
        block = bytes(view[where : where + BLOCK])
        where += len(block)
        try:
            while block and not reader.eof:
                piece = reader.decompress(block, PIECE)
                held += len(piece)
                yield piece, None, None
                block = reader.unconsumed_tail
        except zlib.error:
            # again by small steps from the member's start, for all that comes before the damage
            reader, passed = zlib.decompressobj(31), 0
            for i in range(at, where, 512):
                block = bytes(view[i : min(i + 512, len(view))])
                try:
                    while block and not reader.eof:
                        piece = reader.decompress(block, PIECE)
                        if passed + len(piece) > held:
                            yield piece[max(0, held - passed) :], None, None
                        passed += len(piece)
                        block = reader.unconsumed_tail
                except zlib.error:
                    break
            yield b"", None, "corrupt"
            return
        if reader.eof:
            yield b"", where - len(reader.unused_data), None
            return


def _member(view: memoryview, at: int) -> tuple[int, int | None, str | None]:
    """How many bytes a gzip member holds, where it ends, and "corrupt" where its data are wrong (see ``_data``)."""
    size, ended, error = 0, None, None
    for piece, ended, error in _data(view, at):
        size += len(piece)
    return size, ended, error


def _lines(view: memoryview, at: int, size: int, whole: bool) -> Iterator[str]:
    """The lines, but empty ones, of a member's first ``size`` bytes; a last one without its end only of a ``whole`` member."""
    rest: list[bytes] = []
    for piece, _, _ in _data(view, at):
        piece, size = piece[:size], size - len(piece[:size])
        first, *lines = piece.split(b"\n")
        rest.append(first)
        if lines:
            lines, rest = [b"".join(rest), *lines[:-1]], [lines[-1]]
            yield from (x.decode("utf-8", "replace") for x in lines if x)
    if whole and any(rest):
        yield b"".join(rest).decode("utf-8", "replace")


def decode(lines: DataFrame, line: str = "line") -> DataFrame:
    """t, n, m of each line, ``good`` being false where it isn't an object with all three; nothing fails."""
    parsed = F.from_json(F.col(line), LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("_p", parsed)
    good = F.col("_p._corrupt").isNull() & F.col("_p.t").isNotNull() & F.col("_p.n").isNotNull() & F.col("_p.m").isNotNull()
    return rows.select("*", F.col("_p.t").alias("t"), F.col("_p.n").alias("n"), F.col("_p.m").alias("m"), F.coalesce(good, F.lit(False)).alias("good")).drop("_p")


def message_bytes(line: Column) -> Column:
    """The message as archived, byte for byte."""
    return F.regexp_extract(line, r'"m":\s*(.*)\}\s*$', 1)


def events(lines: DataFrame) -> DataFrame:
    """Good records with the columns of their path, ready to be ordered by (t, n)."""
    good = decode(lines).where("good").drop("good", "line")
    return good.select("*", *[c.alias(k) for k, c in path_columns(F.col("path")).items()])


def audit(torn: DataFrame) -> DataFrame:
    """Per file: records saved, damages by kind, where the first damage is, verdict; strict: the records of a reader that stops at the first damage;
    recovered: those beyond it."""
    per = torn.groupBy("path").agg(
        F.count("line").alias("records"), F.count_if(F.col("damage") == "tail").alias("tail"), F.count_if(F.col("damage") == "torn").alias("torn"),
        F.count_if(F.col("damage") == "corrupt").alias("corrupt"), F.count_if(F.col("damage") == "junk").alias("junk"), F.min("at").alias("first_damage"),
        F.coalesce(F.min_by("line_no", F.when(F.col("damage").isNotNull(), F.col("at"))), F.count("line")).alias("strict"),
    )
    per = per.withColumn("recovered", F.col("records") - F.col("strict"))
    inner = F.col("torn") + F.col("corrupt") + F.col("junk")
    return per.withColumn("verdict", F.when(inner > 0, "damaged").when(F.col("tail") > 0, "tail only").otherwise("clean"))


def write_archive(events_: DataFrame, root: str) -> None:
    """Events in the hive layout of this library: partitioned by instrument, day, channel and hour, so that filters prune."""
    out = events_.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86_400_000).cast("int"))).withColumn("hour", (F.floor(F.col("t") / 3_600_000) % 24).cast("int"))
    out.repartition("instrument", "day", "channel").sortWithinPartitions("t", "n").write.partitionBy("instrument", "day", "channel", "hour").json(root, compression="gzip")


def rejected_rows(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows that aren't written yet: an append that can be repeated."""
    return rows.join(existing.select(*key).distinct(), key, "left_anti")


def audit_totals(audits: DataFrame) -> DataFrame:
    """verdict, files, records, recovered, short (files of which a strict reader gives fewer records) of all files."""
    return audits.groupBy("verdict").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("recovered").alias("recovered"), F.count_if(F.col("recovered") > 0).alias("short"))


def read_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of JSON lines under ``root`` in one schema; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_rows(rows: DataFrame, root: str, schema: str, key: list[str]) -> None:
    """Adds those of ``rows`` whose key isn't under ``root`` yet, one of each key, as JSON lines.  An append that is repeated, or begun again
    after it failed, adds nothing twice: its files show up together when the job commits.  One writer at a time."""
    new = rejected_rows(rows, read_rows(rows.sparkSession, root, schema), key).dropDuplicates(key)
    new.select(*rows.sparkSession.createDataFrame([], schema).columns).write.mode("append").json(root)
