"""Session logs as rows: JSON lines, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """session_id (the file), line, entry (VARIANT, null where a line is no JSON), raw (its text), for every line that isn't blank.

    A file is read in splits by several tasks. A line's place is its split's start, a sum over the splits before it, and
    its order within the split; no task sees more than a split, however large the file.
    """
    split = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("session_id"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw"))
    sizes = split.groupBy("session_id", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("session_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("session_id", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("session_id", "start").orderBy("at")) - 1
    files = split.withColumn("nth", within).where(~F.col("raw").rlike(r"^\s*$")).join(starts, ["session_id", "start"])
    return files.select("session_id", (F.col("first") + F.col("nth")).cast("long").alias("line"), F.try_parse_json("raw").alias("entry"), "raw")


def scan(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """read_lines of the given files, and of each the outcome: path, missing, n_lines (not blank), n_errors (of these, no JSON).

    A file that isn't there is an outcome; any other failure to read one ends the job with its error. An unreadable line is counted.
    """
    there = {p: _path(spark, p) for p in dict.fromkeys(paths)}
    found = [names[0] for names in there.values() if names]
    named = spark.createDataFrame([(p, names and names[1]) for p, names in there.items()], "path string, session_id string")
    lines = read_lines(spark, found) if found else spark.createDataFrame([], "session_id string, line long, entry variant, raw string")
    told = named.join(parse_errors(lines), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return lines, told.select("path", F.col("session_id").isNull().alias("missing"), zero("n_lines"), zero("n_errors"))


def _path(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """A file's full name, and the same as input_file_name() gives it; none where it doesn't exist."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.getFileStatus(own).getPath() if fs.exists(own) else None
    return full and (full.toString(), full.toUri().toString())


def parse_errors(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("entry").isNull()).alias("n_errors"))


def typed_entries(lines: DataFrame) -> DataFrame:
    """session_id, seq, entry_id, type, role, first_kept, summary, message, raw (its text) of every entry."""
    get = lambda path, kind="string": F.try_variant_get("entry", path, kind)
    return lines.where("entry is not null").select(
        "session_id", F.col("line").cast("long").alias("seq"), get("$.id").alias("entry_id"), get("$.type").alias("type"), get("$.message.role").alias("role"),
        get("$.firstKeptEntryId").alias("first_kept"), get("$.summary").alias("summary"), F.try_variant_get("entry", "$.message", "variant").alias("message"), F.get_json_object("raw", "$.message").alias("raw"),
    )


def conversation_entries(turns: DataFrame) -> DataFrame:
    """conv_id, idx (place in the conversation), role, text, doc (what a search reads)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    idx = (F.row_number().over(order) - 1).cast("long")
    return turns.select("conv_id", idx.alias("idx"), "role", "text", F.concat_ws(" ", F.col("role"), F.coalesce("text", F.lit("")), F.lit("")).alias("doc"))


def event_blocks(events: DataFrame) -> DataFrame:
    """session_id, blk, event_id, kind, name, path, command, exit_code, text, tokens: events seen as blocks of a session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'bash' ELSE 'tool_call' END")
    name = F.expr("CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'read' END")
    command = F.expr("CASE WHEN event_type = 'error' THEN element_at(array('npm test', 'git commit -m x', 'ls -la', 'make'), cast(event_id % 4 + 1 as int)) END")
    return events.select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("blk"), "event_id", kind.alias("kind"), name.alias("name"),
        F.expr("CASE WHEN event_type IN ('purchase', 'view') THEN concat('/repo/src/m', event_id % 7, '/f', event_id % 40, '.py') END").alias("path"), command.alias("command"),
        F.expr("CASE WHEN event_type = 'error' THEN event_id % 2 END").alias("exit_code"),
        F.repeat(F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(". ")), (F.col("event_id") % 20).cast("int")).alias("text"),
        (F.col("event_id") % 900).alias("tokens"),
    )
