"""Operation logs: as text, one record per line, `timestamp|TAG |field|field...`, or binary; read, sorted out and written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.time import micros, moment
from chronofold.sources import binary
from chronofold.sources.records import KNOWN, LATEST, OLDEST, grammars, upgraded, with_version
from chronofold.sources.tables import scratch


class UnknownTag(ValueError):
    """A record has a tag that the reader doesn't know."""


def read_lines(spark: SparkSession, path: str, logs: list[str] | None = None) -> DataFrame:
    """(replay_id, op_seq, line) of all logs below the folder `path`, or of `logs` there; op_seq grows in the order of each file.

    replay_id is the log's path below the folder. A log is one file, of any size. It is read in splits: a line's number is that
    of its split, by which megabyte it begins in, and its own in the task that reads it. Splits below a megabyte, which no
    default gives, would not do.
    """
    if logs == []:
        return spark.createDataFrame([], "replay_id string, op_seq long, line string")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path if logs is None else logs)
    split = F.shiftright(F.col("_metadata.file_block_start"), 20)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    seq = F.shiftleft(split, 33).bitwiseOR(own)
    return text.select(_below(spark, path).alias("replay_id"), seq.alias("op_seq"), F.rtrim("value", F.lit("\r")).alias("line"))


def _below(spark: SparkSession, path: str) -> Column:
    """The path of a row's file below the folder; its name, where `path` is the file."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(root) and files.getFileStatus(root).isFile():
        return F.col("_metadata.file_name")
    folder = root.toUri().getPath().rstrip("/") + "/"
    # File names come as parts of a URI.
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(whole, F.locate(folder, whole) + len(folder))


def _long_text(spark: SparkSession, path: str) -> list[str]:
    """The text logs below a folder that are too long for one task. Their names go to the driver."""

    def text_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not binary.is_binary(u) for u in b.column("uri").to_pylist()], pa.bool_()))

    found = [(uri,) for uri, _, n in binary.log_files(path) if n > binary.BinaryLogReader.TEXT_BYTES]
    if not found:
        return []
    return [r["uri"] for r in spark.createDataFrame(found, "uri string").repartition(min(len(found), 200)).mapInArrow(text_only, "uri string").collect()]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(replay_id, op_seq, line) of the logs below a folder that are text; as `read_lines`, but many short logs go to one task."""
    binary.register(spark)
    short = spark.read.format("binary_log").option("lines", "true").load(path).where("line is not null").select("replay_id", "op_seq", "line")
    long = _long_text(spark, path)
    return short.unionByName(read_lines(spark, path, long)) if long else short


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(replay_id, op_seq, ts_us, version, tag, fields, error) of all logs below a folder, text and binary, each known by how it begins.

    A row with an error has no tag: its log, a binary one, can't be read on from there.
    """
    binary.register(spark)
    text = F.col("line").isNotNull()
    rows = spark.read.format("binary_log").option("lines", "true").load(path).withColumn("_f", _split("line")).where(~text | _is_record("line"))
    told = {c: F.when(text, v).otherwise(F.col(c)).alias(c) for c, v in _parsed().items()}
    records = rows.select("replay_id", "op_seq", told["ts_us"], "version", told["tag"], told["fields"], "error")
    long = _long_text(spark, path)
    if not long:
        return records
    lines = with_version(parse(read_lines(spark, path, long)))
    return records.unionByName(lines.select("replay_id", "op_seq", "ts_us", "version", "tag", "fields", F.lit(None).cast("string").alias("error")))


def saved(records: DataFrame, name: str) -> DataFrame:
    """`records`, written once for all that reads them."""
    spark = records.sparkSession
    path = f"{scratch(spark, name)}/all"
    records.write.parquet(path)
    return spark.read.schema(records.schema).parquet(path)


def sorted_out(records: DataFrame, whole_logs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): records that can be used, and the others with their `problem`.

    A problem is an error of the reader, a log without a version or of one that is too old, an unknown tag, a time or fields that can't be
    read, or an entity that is made while it is there. It condemns its whole log, or its record alone; other logs
    are not touched. Records that are condemned with their log have no problem of their own.
    """
    known = records if "version" in records.columns else with_version(records)
    if "error" not in known.columns:
        known = known.withColumn("error", F.lit(None).cast("string"))
    entity = F.lower(F.split_part(F.get("fields", F.lit(0)), F.lit("/"), F.lit(1)))
    lives = known.where("tag in ('ACT+', 'ACT-')").withColumn("_entity", F.ltrim(entity, F.lit("0")))
    before = F.lag("tag").over(Window.partitionBy("replay_id", "_entity").orderBy("op_seq"))
    twice = lives.withColumn("_before", before).where("tag = 'ACT+' and _before = 'ACT+'").select("replay_id", "op_seq", F.lit(True).alias("_twice"))
    own = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("version").isNull(), "no version")
        .when(F.col("version") < OLDEST, "version is too old")
        .when(~F.coalesce(F.col("tag").isin(*KNOWN), F.lit(False)), "unknown tag")
        .when(F.col("ts_us").isNull(), "no time")
        .when(~_fits(), "fields are not as they should be")
    )
    checked = known.withColumn("problem", own)
    told = checked.join(twice, ["replay_id", "op_seq"], "left").withColumn("problem", F.coalesce("problem", F.when(F.col("_twice"), "made while it is there"))).drop("_twice")
    if whole_logs:
        # The good are told by the names of the others alone, and lie as they will be written: all of a log in one part.
        broken = checked.where("problem is not null").select("replay_id").unionByName(twice.select("replay_id")).distinct().hint("shuffle_hash")
        return known.drop("error").join(broken, "replay_id", "left_anti"), told.join(broken, "replay_id", "left_semi").drop("error")
    good = F.col("problem").isNull()
    return told.where(good).drop("problem", "error"), told.where(~good).drop("error")


def _fits() -> Column:
    """Whether a record's fields are as its tag and version have them.

    The expressions of all tags and versions are one literal, on tag, version as a character, and fields: it is compiled once
    for a task, where a column of expressions would be for each record, and a case for each tag is too long to be compiled at all.
    """
    shown = 95
    every = "|".join(f"{re.escape(tag)}[{chr(shown + first)}-{chr(shown + last)}](?:{expression.removeprefix('^')})" for tag, first, last, expression in grammars())
    told = F.concat("tag", F.char(F.least("version", F.lit(LATEST)) + shown), F.array_join("fields", "|", ""))
    return F.coalesce(F.regexp_like(told, F.lit(f"^(?:{every})")), F.lit(False))


def frames(records: DataFrame) -> DataFrame:
    """(replay_id, op_seq, ts_us): where frames begin. Logs below version 5 have no frames of their own: one begins wherever time goes on."""
    own = records.where("tag = 'FRAM'").select("replay_id", "op_seq", "ts_us")
    log = Window.partitionBy("replay_id").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, -1)
    old = records.where("version < 5 and tag <> 'VER '").withColumn("_before", F.max("ts_us").over(log))
    new = old.where("tag <> 'FRAM' and (_before is null or ts_us > _before)")
    return own.unionByName(new.select("replay_id", "op_seq", "ts_us"))


def write_logs(records: DataFrame, path: str, form: str = "binary") -> None:
    """Write each log to a file of its own below the folder `path`, in the latest version; form is binary or text.

    replay_id is the file's path there. A log is sorted and written by one task. Binary logs keep the time of frames alone.
    """
    now = upgraded(records if "version" in records.columns else with_version(records))
    fields = F.when(F.col("tag") == "VER ", F.concat(F.array(F.lit(str(LATEST))), F.slice("fields", 2, 2))).otherwise(F.col("fields"))
    told = now.select("replay_id", "op_seq", "ts_us", "tag", fields.alias("fields"))
    if form == "text":
        write_lines(told.withColumn("line", line(F.col("ts_us"), F.col("tag"), F.col("fields"))), path)
    else:
        _write(told, path, form)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (replay_id, op_seq, line) as text, each log to a file of its own below the folder `path`."""
    # No other columns: where one of lists is null, Spark goes over all rows of a batch for each that it adds.
    _write(lines.select("replay_id", "op_seq", "line"), path, "text")


def _write(told: DataFrame, path: str, form: str) -> None:
    """Each log in one task, one after another.

    They are sorted by a hash first: names often begin alike, and of strings a sort compares the first eight bytes before it
    looks at the rows themselves.
    """
    binary.register(told.sparkSession)
    dealt = told.repartition("replay_id").sortWithinPartitions(name_hash(), "replay_id", "op_seq")
    dealt.write.format("binary_log").option("form", form).mode("append").save(path)


def name_hash() -> Column:
    return F.xxhash64("replay_id")


def convert(spark: SparkSession, source: str, target: str, form: str) -> DataFrame:
    """Write the logs below `source` that can be read below `target`, in another form; the records of the others, with their problems. The logs are read once."""
    good, bad = sorted_out(saved(read_records(spark, source), "records"))
    write_logs(good, target, form)
    return bad


def line(ts_us: Column, tag: Column, fields: Column) -> Column:
    """A record as text; a seventh fractional digit is written as 0."""
    stamp = F.concat(F.date_format(moment(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    return F.concat_ws("|", stamp, tag, fields)


def parse(lines: DataFrame, line: str = "line", known: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Columns ts_us, tag and fields for each record; blank lines, comments and what is no record are left out.

    The seventh fractional digit of a timestamp is dropped. Unknown tags are kept as they are, or end
    the query in mode FAILFAST.
    """
    parts = _parsed()
    if known is not None and mode == "FAILFAST":
        tag = parts["tag"]
        parts["tag"] = F.when(tag.isin(known), tag).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), tag)).cast("string"))
    return lines.withColumn("_f", _split(line)).where(_is_record(line)).withColumns(parts).drop("_f")


def _split(line: str) -> Column:
    return F.split(F.col(line), r"\|")


def _is_record(line: str) -> Column:
    """Whether a line is a record. Its parts in `_f` are not asked, as a filter would split the line anew for each question."""
    ok = (F.length(F.trim(line)) > 0) & ~F.startswith(F.ltrim(line), F.lit("#"))
    second = F.substring_index(F.substring_index(line, "|", 2), "|", -1)
    return ok & F.contains(F.col(line), F.lit("|")) & (F.length(second) == 4)


def _parsed() -> dict[str, Column]:
    """What a record's parts in `_f` tell."""
    stamp = F.regexp_replace(F.get("_f", F.lit(0)), r"(\.\d{6})\d*Z?$", "$1")
    return {"ts_us": micros(stamp.try_cast("timestamp_ntz")), "tag": F.get("_f", F.lit(1)), "fields": F.slice("_f", F.lit(3), F.greatest(F.size("_f") - 2, F.lit(0)))}


def field(i: int) -> Column:
    """Field i of a record, NULL where it has fewer."""
    return F.get("fields", F.lit(i))


def since(version: Column, first: int, value: Column, default: Column) -> Column:
    """A field that records have from one version on."""
    return F.when(version >= first, F.coalesce(value, default)).otherwise(default)


def emit(rows: DataFrame, ts: Column, tag: Column, fields: list[Column]) -> DataFrame:
    """Records as text; a seventh fractional digit is written as 0."""
    stamp = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    return rows.withColumn("line", F.concat_ws("|", stamp, F.rpad(tag, 4, " "), *(F.coalesce(c.cast("string"), F.lit("")) for c in fields)))


def frame_time(rows: DataFrame, by: list[str], counter: str, frequency: int, start: Column, seq: str) -> DataFrame:
    """time_us from a counter: the start plus what it has advanced; the start itself where it is below its first value."""
    first = F.first(counter).over(Window.partitionBy(*by).orderBy(seq))
    gone = F.col(counter) - first
    # Whole seconds and the rest apart, so that large counters don't overflow.
    whole, rest = F.call_function("div", gone, F.lit(frequency)), gone % frequency
    return rows.withColumn("time_us", F.when(gone < 0, start).otherwise(start + whole * 1_000_000 + F.call_function("div", rest * 1_000_000, F.lit(frequency))))


def split_at(rows: DataFrame, by: list[str], marker: Column, ts: str, seq: str) -> DataFrame:
    """part: how many markers of its log have come up to each record; the records of a part form a log."""
    w = Window.partitionBy(*by).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("part", F.count_if(marker).over(w))


def pseudonyms(rows: DataFrame, by: list[str], name: str, ts: str, seq: str) -> DataFrame:
    """pseudonym: `Player N`, numbered by first appearance within each log."""
    first = rows.groupBy(*by, name).agg(F.min(F.struct(ts, seq)).alias("_first"))
    numbered = first.withColumn("pseudonym", F.concat(F.lit("Player "), F.row_number().over(Window.partitionBy(*by).orderBy("_first")).cast("string"))).drop("_first")
    other = numbered.select(*(F.col(c).alias(f"_{c}") for c in (*by, name)), "pseudonym")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, name)]
    return rows.join(other, same).drop(*(f"_{c}" for c in (*by, name)))
