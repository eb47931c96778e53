"""Readers of record files, each over a directory: line tables first, then expressions. Bad records keep a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.contracts import with_reasons
from spanloom.scratch import Scratch


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files, in order from 0, however many splits a file is read in.

    Lines are read once and kept with their split and their order in it. A line's place is its order plus the
    lines of the splits before it: a running sum over splits, not over lines. Blank lines count; the end of the last one does not
    begin another.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    kept = Scratch(spark, "lines").save(lines)
    splits = kept.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    ahead = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    return kept.join(splits, ["file", "_split"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("pos"), "line")


def table_with_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def durations(rows: DataFrame, order: str) -> DataFrame:
    """clip, seconds from `clip`, `duration[ms]`: blank rows go, the last of repeated clips by `order` stays."""
    kept = rows.where("clip is not null and trim(clip) <> ''")
    return kept.groupBy("clip").agg((F.max_by(F.col("`duration[ms]`").cast("double"), F.col(order)) / 1000).alias("seconds"))


def voice_corpus(rows: DataFrame, seconds: DataFrame, locale: str) -> tuple[DataFrame, DataFrame]:
    """(items, refused): a row of another locale, or whose clip has no duration, is refused; rows without text or path are skipped with a reason."""
    j = rows.join(seconds, rows["path"] == seconds["clip"], "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    checked = with_reasons(j, {"no text or path": blank("sentence") | blank("path"), "other locale": F.col("locale") != locale, "no duration": F.col("seconds").isNull() & ~blank("path")})
    good = checked.where(F.size("reasons") == 0).select(F.col("path").alias("item_id"), F.col("sentence").alias("reference"), F.col("seconds").alias("duration_s"))
    return good, checked.where(F.size("reasons") > 0)


def human_confirmed(exported, verified, gold, chosen, verdicts):
    """exported is not false, and verified, gold, or a chosen text that was exported or has verdicts; nulls are false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.coalesce(exported, F.lit(True)) & (yes(verified) | yes(gold) | (chosen.isNotNull() & (yes(exported) | yes(verdicts))))


def good_prefix(lines: DataFrame, schema: str, key: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """Parsed records of each file up to its first line that is no record: a torn tail ends it, it is not skipped.

    Blank lines are no records and end nothing. The first bad lines are one row a file at most and are joined to the
    others, so a long file is read by as many tasks as it has splits.
    """
    parsed = lines.where(F.trim(line) != "").withColumn("_r", F.from_json(line, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    first = parsed.where(bad).groupBy(F.col(key).alias("_key")).agg(F.min(pos).alias("_first"))
    met = parsed.join(first, parsed[key].eqNullSafe(first["_key"]), "left")
    return met.where(F.col("_first").isNull() | (F.col(pos) < F.col("_first"))).select(key, pos, "_r.*").drop("_corrupt")


_CLOCK = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def _ms(text, group: int, pattern: str):
    part = lambda k: F.regexp_extract(text, pattern, group + k).try_cast("long")
    return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3)


def srt_cues(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, cue, start_ms, end_ms, reasons of SRT texts: numbering from 1, clock format and span are checked."""
    blocks = texts.select(key, F.posexplode(F.filter(F.split(F.regexp_replace(text, r"\s+$", ""), r"\r?\n\s*\n"), lambda b: F.trim(b) != "")).alias("pos", "block"))
    pattern = rf"^\s*(\d+)\s*\r?\n{_CLOCK} --> {_CLOCK}"
    rows = blocks.select(key, "pos", F.regexp_extract("block", pattern, 1).alias("no"), _ms(F.col("block"), 2, pattern).alias("start_ms"), _ms(F.col("block"), 6, pattern).alias("end_ms"))
    rules = {"bad format": F.col("no") == "", "bad number": (F.col("no") != "") & (F.col("no").try_cast("int") != F.col("pos") + 1), "empty span": F.col("end_ms") <= F.col("start_ms")}
    return with_reasons(rows, rules).select(key, F.col("no").try_cast("int").alias("cue"), "start_ms", "end_ms", "reasons")


def dialogue_times(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with start_ms and end_ms of `Dialogue:` lines (h:mm:ss.cc)."""
    pattern = r"^Dialogue:\s*\d+,(\d+):(\d{2}):(\d{2})\.(\d{2}),(\d+):(\d{2}):(\d{2})\.(\d{2}),"

    def ms(g):
        part = lambda k: F.regexp_extract(line, pattern, g + k).try_cast("long")
        return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3) * 10

    return lines.where(F.col(line).rlike(pattern)).withColumn("start_ms", ms(1)).withColumn("end_ms", ms(5))


def loudness(text) -> dict:
    """integrated, peak and ok (columns) of a loudness log: -24..-15 LUFS, peak at most -1 dBFS; the last report counts."""
    last = lambda p: F.element_at(F.regexp_extract_all(text, F.lit(p), 1), -1).try_cast("double")
    i, peak = last(r"I:\s*(-?\d+(?:\.\d+)?) LUFS"), last(r"Peak:\s*(-?\d+(?:\.\d+)?) dBFS")
    return {"integrated": i, "peak": peak, "ok": F.coalesce(i.between(-24, -15) & (peak <= -1), F.lit(False))}


def silence_intervals(lines: DataFrame, key: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """key, start_ms, end_ms from `silence_start:` and `silence_end:` lines in file order."""
    value = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).cast("double")
    marks = lines.withColumn("_s", value(r"silence_start:\s*(-?[\d.]+)")).withColumn("_e", value(r"silence_end:\s*(-?[\d.]+)")).where("_s is not null or _e is not null")
    before = F.lag("_s").over(Window.partitionBy(key).orderBy(pos))
    return marks.withColumn("_b", before).where("_e is not null and _b is not null").select(key, F.round(F.col("_b") * 1000).cast("long").alias("start_ms"), F.round(F.col("_e") * 1000).cast("long").alias("end_ms"))


def missing_files(spark: SparkSession, items: DataFrame, path_column: str, root: str, folders: bool = False) -> DataFrame:
    """items whose file, or with `folders` whose folder with files, is not under root; paths are relative to it. A null path is missing."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("_p"))
    if folders:
        there = there.select(F.regexp_replace("_p", "/[^/]*$", "").alias("_p")).distinct()
    return items.join(there, items[path_column] == there["_p"], "left_anti")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, lines and sha256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key the table at `path` does not have yet, with a digest of each.

    Returns what became of every row: key and written. The table is never rewritten.
    """
    from spanloom.scratch import Scratch

    spark = df.sparkSession
    rows = df.withColumn("sha256", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows.write.parquet(path)
        return df.select(key, F.lit(True).alias("written"))
    have = spark.read.parquet(path).select(key, F.lit(True).alias("_have")).distinct()
    marked = Scratch(spark, "write_once").save(rows.join(have, key, "left").withColumn("written", F.col("_have").isNull()).drop("_have"))
    marked.where("written").drop("written").write.mode("append").parquet(path)
    return marked.select(key, "written")
