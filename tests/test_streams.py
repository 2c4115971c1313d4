"""Texts in chunks: batch, stateful streaming, and the objects behind them."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import matching
from gristmill.plans.errors import PatternSyntaxError
from gristmill.plans.pattern import compile, compile_bytes
from gristmill.sources import lines
from gristmill.streaming import streams

TEXTS = {1: "ab12 345xyz6", 2: "", 3: "999", 4: "no digits", 5: "é1😀22"}


def expected(pattern, overlapping=False):
    return sorted((k, m.start, m.end) for k, t in TEXTS.items() for m in matching.each(compile(pattern), t, overlapping=overlapping))


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "stream_id long, text string")
    return lines.chunks(df, 2)


def test_batch(chunks):
    got = streams.all_stream_matches(chunks, "[0-9]+").select("stream_id", "match.start", "match.end").collect()
    assert sorted(map(tuple, got)) == expected("[0-9]+")
    got = streams.incremental_matches(chunks, "[0-9]+").select("stream_id", "start", "end").collect()
    assert sorted(map(tuple, got)) == expected("[0-9]+")
    assert {r.stream_id: r.match and r.match.start for r in streams.scan_stream(chunks, "[0-9]").collect()} == {1: 2, 2: None, 3: 0, 4: None, 5: 1}
    octets = chunks.withColumn("chunk", F.encode("chunk", "utf-8"))
    got = streams.all_stream_matches(octets, compile_bytes("[0-9]+")).select("stream_id", "match.start").collect()
    assert (5, 2) in set(map(tuple, got))


@pytest.mark.parametrize("kind", ["buffered", "incremental"])
def test_streaming(spark, chunks, tmp_path, kind):
    source, rows = str(tmp_path / "in"), chunks.orderBy("seq", "stream_id").collect()
    # Three micro-batches: out of order, with a repeated delivery.
    parts = [rows[5:9], rows[:5] + rows[5:7], rows[9:]]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    make = {"buffered": streams.buffered_stream, "incremental": streams.incremental_stream}[kind]
    spark.createDataFrame(rows[:0], chunks.schema).write.parquet(source)
    held = spark.readStream.schema(chunks.schema).parquet(source)
    query = make(held, "[0-9]+").writeStream.format("memory").queryName(f"out_{kind}").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        for part in parts:
            spark.createDataFrame(part, chunks.schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = sorted((r.stream_id, r.start, r.end) for r in spark.table(f"out_{kind}").collect())
    assert got == expected("[0-9]+")


def test_buffer():
    b = streams.Buffer(compile("a+b"))
    for c in ("a", "a", "b"):
        b.feed(c)
    assert b.length == 3 and b.text == "aab" and [m.spans[0] for m in b.finish()] == [(0, 3)] == [m.spans[0] for m in b.finish()]
    with pytest.raises(ValueError):
        b.feed("x")
    b.reset()
    b.feed("xay", 1, 2)
    assert b.text == "a" and not b.finished
    many = streams.Buffer(compile("aa"), overlapping=True)
    many.feed("a"), many.feed("aa")
    assert len(many.finish()) == 2


def test_delivery_resumes():
    b, taken, fail = streams.Buffer(compile("[0-9]")), [], [True]

    def take(found):
        if found.start == 3 and fail.pop():
            raise RuntimeError("sink")
        taken.append(found.start)

    b.feed("a1b2c3")
    with pytest.raises(RuntimeError):
        b.finish(take)
    assert taken == [1] and b.finished
    fail.append(False)
    assert len(b.finish(take)) == 3 and taken == [1, 3, 5]
    b.finish(take)
    assert taken == [1, 3, 5]


def test_delivery_of_batches(spark, chunks, tmp_path):
    """A sink that fails is handed the same batch again under the same number."""
    source, out, seen = str(tmp_path / "in"), [], []
    chunks.coalesce(1).write.parquet(source)

    def take(found, number):
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("sink")
        out.extend((r.stream_id, r.start, r.end) for r in found.collect())

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for attempt in range(2):
            held = streams.incremental_stream(spark.readStream.schema(chunks.schema).parquet(source), "[0-9]+")
            query = streams.deliver(held, take, str(tmp_path / "state"))
            if attempt:
                assert query.awaitTermination(120)
            else:
                with pytest.raises(Exception, match="sink"):
                    query.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] and sorted(out) == expected("[0-9]+")


def test_ended_keys_leave_a_mark_only():
    held = streams.Keyed(streams.Buffer(compile("a")))
    held.read([(1, "a", True), (0, "xa", False)])
    assert held.ended and not held.waiting and held.read([(0, "a", True)]) == []


def test_chunks_and_lines(spark, tmp_path):
    big = "".join(chr(0x20 + i % 90) for i in range(300_000)) + "\n😀\r\nend"
    df = spark.createDataFrame([(1, big), (2, ""), (3, None)], "stream_id long, text string")
    got = lines.chunks(df, 1_000).collect()
    assert "".join(r.chunk for r in sorted(got, key=lambda r: r.seq) if r.stream_id == 1) == big and {len(r.chunk) for r in got if r.stream_id == 1 and not r.is_last} == {1_000}
    assert [(r.chunk, r.is_last) for r in got if r.stream_id == 2] == [("", True)] and [r.seq for r in got if r.is_last and r.stream_id == 1] == [len(big) // 1_000]
    texts = {"a.txt": "one\n\nthree\r\n", "b.txt": "no end", "c.txt": "", "d.txt": "".join(f"line {i}\n" for i in range(5_000))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # the last file is read in many splits
    try:
        rows = lines.file_lines(spark, [str(tmp_path / n) for n in texts]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in texts.items():
        want = text.split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert sorted((r.line_no, r.line) for r in rows if r.label.endswith(name)) == list(enumerate(want, 1)), name


def test_incremental():
    def run(pattern, chunks, start=0):
        live = streams.Incremental(pattern, start)
        return [[m.spans[0] for m in live.feed(c)] for c in chunks], [m.spans[0] for m in live.finish()]

    out, end = run(compile("ab|a"), ["a", "ba", "ba"])
    assert sum(out, []) + end == [m.spans[0] for m in matching.each(compile("ab|a"), "ababa")]
    assert run(compile("a|ab"), ["a", "b"]) == ([[(0, 1)], []], [])
    assert run(compile_bytes(".."), [b"\xc3\xa9\xf0\x9f", b"\x98\x80"], 10) == ([[], [(10, 16)]], [])
    assert run(compile("abc|a"), ["abx"]) == ([[(0, 1)]], [])
    for pattern in ("a*", "(?=a)", "^a", r"a\R", r"\b", r"(?<x>a)\k<x>"):
        with pytest.raises(PatternSyntaxError):
            streams.Incremental(compile(pattern))
    with pytest.raises(PatternSyntaxError):
        streams.Incremental(compile_bytes(r"é(?-u:\xff)"))


def test_a_timeout_leaves_the_search_as_it_was():
    from gristmill.plans.errors import MatchTimeout

    live = streams.Incremental(compile("(?:a|aa|aaa)+b"), timeout=1e-9)
    live.timeout = None
    assert live.feed("aa") == [] and live.position == 2
    live.timeout = 1e-9
    with pytest.raises(MatchTimeout):
        live.feed("a" * 500)
    assert live.position == 2
    live.timeout = None
    assert [m.spans[0] for m in live.feed("b")] == [(0, 3)]
