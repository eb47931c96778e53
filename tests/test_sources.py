import json

from pyspark.sql import functions as F

from spanloom.sources import files as I
from spanloom.streaming import ledgers as L


def test_ledger_stops_at_a_torn_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n{"n": \n{"n": 4}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 7}\n{"n": 8}')
    lines = I.numbered_lines(spark, str(tmp_path)).where("line <> ''")
    assert sorted(r.n for r in I.good_prefix(lines, "n long").collect()) == [1, 2, 7, 8]


def test_lines_of_a_file_of_many_splits(spark, tmp_path):
    """Places are those of the file, a torn line in the third split ends it there, and other files go on."""
    long = [json.dumps({"n": i, "t": "x" * (i % 37)}) for i in range(3000)]
    (tmp_path / "long.jsonl").write_text("\n".join(long) + "\n")
    torn = [*long[:1900], '{"n": 1900, "t": "xx', "", *long[1901:]]
    (tmp_path / "torn.jsonl").write_text("\n".join(torn))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = I.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 4
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, want in (("long", long), ("torn", torn)):
        assert [r.line for r in sorted((r for r in got if name in r.file), key=lambda r: r.pos)] == want
        assert sorted(r.pos for r in got if name in r.file) == list(range(len(want)))
    read = I.good_prefix(lines, "n long, t string").groupBy("file").agg(F.count("*").alias("c"), F.max("n").alias("m")).collect()
    assert {(r.file.split("/")[-1], r.c, r.m) for r in read} == {("long.jsonl", 3000, 2999), ("torn.jsonl", 1900, 1899)}


def test_voice_corpus(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("path\tsentence\tlocale\na\tone\tckb\nb\t\tckb\nc\tthree\ten\nd\tfour\tckb\n")
    (tmp_path / "d.tsv").write_text("clip\tduration[ms]\na\t1500\nb\t100\nc\t100\na\t2500\n")
    seconds = I.durations(I.table_with_header(spark, str(tmp_path / "d.tsv")).withColumn("o", F.monotonically_increasing_id()), "o")
    good, bad = I.voice_corpus(I.table_with_header(spark, str(tmp_path / "t.tsv")), seconds, "ckb")
    assert [(r.item_id, r.duration_s) for r in good.collect()] == [("a", 2.5)]
    assert {r.path: list(r.reasons) for r in bad.collect()} == {"b": ["no text or path"], "c": ["other locale"], "d": ["no duration"]}


def test_subtitles_and_logs(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHi\n\n3\n00:00:03,000 --> 00:00:03,000\nNo\n\nbroken\n"
    rows = I.srt_cues(spark.createDataFrame([(1, srt)], "f long, t string"), "f", "t").orderBy("start_ms").collect()
    assert [list(r.reasons) for r in rows if r.start_ms == 1000] == [[]]
    assert ["bad number", "empty span"] in [list(r.reasons) for r in rows] and ["bad format"] in [list(r.reasons) for r in rows]
    log = spark.createDataFrame([(1, 0, "silence_start: 1.5"), (1, 1, "other"), (1, 2, "silence_end: 2.25 | x"), (1, 3, "silence_end: 9")], "file long, pos long, line string")
    assert [(r.start_ms, r.end_ms) for r in I.silence_intervals(log).collect()] == [(1500, 2250)]


def test_write_once_and_files(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert all(r.written for r in I.write_once(a, path, "k").collect())
    again = {r.k: r.written for r in I.write_once(spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string"), path, "k").collect()}
    assert again == {2: False, 3: True}
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "y"), (3, "w")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.wav").write_bytes(b"abc")
    items = spark.createDataFrame([("a.wav",), ("b.wav",)], "p string")
    assert [r.p for r in I.missing_files(spark, items, "p", str(tmp_path / "m")).collect()] == ["b.wav"]
    assert I.file_digests(spark, str(tmp_path / "m")).first().bytes == 3


def test_reuse_and_ledgers(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, d string")
    have = spark.createDataFrame([(1, "a"), (2, "x")], "k long, d string")
    assert {r.k: r.outcome for r in L.reuse(want, have, ["k"], "d").collect()} == {1: "hit", 2: "stale", 3: "miss"}
    ledger = spark.createDataFrame([("r", 1, "v1"), ("r", 2, "v2"), ("q", 1, "v1")], "key string, sequence long, v string")
    assert {r.key: r.v for r in L.current(ledger, "key", "v", "none").collect()} == {"r": "v2", "q": "v1"}
    assert [(r.key, r.sequence, r.v) for r in L.rollback(ledger, "key", "v").collect()] == [("r", 3, "v1")]


def test_stream_keeps_each_key_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("r", 1, "2024-01-01 00:00:00"), ("r", 1, "2024-01-01 00:00:00"), ("r", 2, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "run string, sequence long, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("run string, sequence long, at timestamp").parquet(src)
    L.append_once(stream, ["run", "sequence"], "at", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
