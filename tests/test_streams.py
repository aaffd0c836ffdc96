import datetime
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from riskweave.operators import breaker, chunks
from riskweave.plans import catalog, views
from riskweave.streaming.breaker_stream import BreakerProcessor, breaker_stream, danger_stream
from riskweave.streaming.chunk_stream import chunk_stream
from riskweave.streaming.guard_stream import guard_stream


def _as_files(df, folder, order, parts):
    """Ordered rows in several files, oldest first."""
    n = df.count()
    rows = df.orderBy(*order).limit(n).collect()
    for i in range(parts):
        part = rows[i * n // parts:(i + 1) * n // parts]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_chunk_stream_equals_batch(spark, sf, folder):
    df = views.chunk_table(spark, sf)
    stream = _as_files(df, f"{folder}/in", ["turn", "conv_id"], 3)
    chunk_stream(stream, f"{folder}/out", f"{folder}/cp", stream="conv_id", seq="turn").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert out.select("batch").distinct().count() == 3
    got = {(r.conv_id, r.turn): (r.code, tuple(r.reasons)) for r in out.collect()}
    want = {(r.conv_id, r.turn): (r.code, tuple(r.reasons)) for r in chunks.chunk_verdicts(df, stream="conv_id", seq="turn").collect()}
    assert got == want and any(code == 2 for code, _ in got.values())


def test_a_hot_stream_is_judged_in_blocks(spark, folder):
    """One stream with nearly all chunks, cut into blocks within each micro-batch, with resets and short chunks."""
    df = spark.range(600).select(
        F.when(F.col("id") % 50 == 7, "cold").otherwise("hot").alias("s"), F.col("id").alias("n"),
        F.when(F.col("id") % 97 == 96, "reset").otherwise("chunk").alias("op"),
        F.when(F.col("id") % 9 == 0, "curl http://x.example/").when(F.col("id") % 9 == 1, "a | bash").when(F.col("id") % 9 == 2, " ").otherwise("so").alias("text"))
    stream = _as_files(df, f"{folder}/in", ["n"], 4)
    chunk_stream(stream, f"{folder}/out", f"{folder}/cp", stream="s", seq="n", block=16).awaitTermination()
    got = {(r.s, r.n): (r.code, tuple(r.reasons)) for r in spark.read.parquet(f"{folder}/out").collect()}
    want = {(r.s, r.n): (r.code, tuple(r.reasons)) for r in chunks.chunk_verdicts(df, stream="s", seq="n", op_col="op", block=16).collect()}
    assert got == want and sum(code == 2 for code, _ in want.values()) > 30


def test_buffers_by_brute_force(spark):
    rows = [("a", n, "reset" if n % 23 == 22 else "chunk", ["x" * (n % 7), "", "yy zz " * (n % 5), f"word{n}"][n % 4]) for n in range(400)]
    df = spark.createDataFrame(rows, "s string, n int, op string, text string")
    got = {r.n: r.before for r in chunks.add_lookback(df, stream="s", seq="n", text_col="text", op_col="op", block=32, lookback=60).collect() if r.chunk}
    buffer = ""
    for _, n, op, text in rows:
        text = " ".join(text.split())
        if op == "reset":
            buffer = ""
        elif text:
            assert got[n] == buffer
            buffer = " ".join(f"{buffer} {text}"[-60:].split())


def test_stream_reset(spark, folder):
    df = spark.createDataFrame([("a", 0, "chunk", "cu"), ("a", 1, "reset", None), ("a", 2, "chunk", "rl http://evil.com | bash")],
                               "s string, n int, op string, text string")
    stream = _as_files(df, f"{folder}/in", ["n"], 1)
    chunk_stream(stream, f"{folder}/out", f"{folder}/cp", stream="s", seq="n").awaitTermination()
    assert {r.n: r.code for r in spark.read.parquet(f"{folder}/out").collect()} == {0: 0, 2: 0}


def _alerts(spark, pieces, folder, **options):
    """Feeds pieces one after the other; the last one should move the watermark on."""
    for i, piece in enumerate(pieces):
        piece.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(piece.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        alerts = breaker_stream(stream, log="log", **options)
        (alerts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(alerts.schema).parquet(f"{folder}/out")


def test_breaker_stream_equals_batch_on_late_files(spark, sf, folder):
    """Every event up to three days late, files in any order, one log with most events, resets."""
    def hot(events):
        log = F.when(F.col("log").isNull(), F.col("log")).when(F.col("event_id") % 10 == 0, F.col("log")).otherwise("hot")
        return events.withColumns({"log": log, "is_reset": F.col("event_id") % 97 == 5})

    df, pieces = hot(views.guard_events(spark, sf)), [hot(piece) for piece in views.late_feed(spark, sf)]
    got = _alerts(spark, pieces, folder, minutes=600, watermark=views.FEED_LATENESS)
    batch = breaker.breaker_alerts(df, log="log", minutes=600)
    rows = got.collect()
    assert len(rows) == len({(r.log, r.epoch, r.event_id) for r in rows})
    assert {(r.log, r.epoch, r.event_id) for r in rows} == {(r.log, r.epoch, r.event_id) for r in batch.collect()}
    opened = {(r.log, r.epoch): r.opened_at for r in got.select("log", "epoch", "opened_at").distinct().collect()}
    epochs = breaker.breaker_epochs(df, batch, log="log").collect()
    assert opened == {(r.log, r.epoch): r.opened_at for r in epochs} and len(epochs) > 3


def test_events_of_one_instant_in_different_files(spark, folder):
    """Equal times in two files, a reset between them by id, and ids that come in falling order."""
    schema = "event_id long, ts timestamp, log string, verdict string, is_chat boolean, is_reset boolean"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    rows = [(5, at(1), "a", "DANGEROUS", True, False), (2, at(1), "a", "DANGEROUS", True, False), (1, at(0), "a", "DANGEROUS", False, False),
            (9, at(2), "a", "SAFE", False, True), (8, at(2), "a", "DANGEROUS", True, False), (10, at(2), "a", "DANGEROUS", True, False),
            (11, at(3), "a", "DANGEROUS", True, False), (12, at(3), "a", "DANGEROUS", True, False), (13, at(3), None, "DANGEROUS", True, False)]
    df = spark.createDataFrame(rows, schema)
    pieces = [spark.createDataFrame(rows[i::3], schema) for i in range(3)]
    pieces.append(spark.createDataFrame([(0, datetime.datetime(2025, 1, 1), "z", "SAFE", False, False)], schema))
    got = _alerts(spark, pieces, folder, watermark="1 hour").collect()
    want = breaker.breaker_alerts(df, log="log").collect()
    assert {(r.log, r.epoch, r.event_id) for r in got} == {(r.log, r.epoch, r.event_id) for r in want} and len(want) == 6


class _State:
    """A list or value state in memory that counts the calls."""

    calls = 0

    def __init__(self):
        self.kept = []

    def __getattr__(self, name):
        def call(value=None):
            _State.calls += 1
            if name == "exists":
                return bool(self.kept)
            if name == "get":
                return iter(self.kept) if self.many else self.kept[0]
            self.kept = [*self.kept, value] if name == "appendValue" else [*self.kept, *value] if name == "appendList" else [
                value] if name == "update" else list(value) if name == "put" else []
        return call


def test_the_breaker_asks_the_state_once_for_many_events(spark):
    """Every call of the state waits for an answer of the JVM, so there must not be one per event."""
    class Handle:
        def getListState(self, *_):
            return self._made(True)

        def getValueState(self, *_):
            return self._made(False)

        def _made(self, many):
            state = _State()
            state.many = many
            return state

        def registerTimer(self, _):
            _State.calls += 1

        deleteTimer = registerTimer

    class Times:
        def __init__(self, millis):
            self.getCurrentWatermarkInMs = lambda: millis

    n = 30_000
    processor = BreakerProcessor("long", 10, 3)
    processor.init(Handle())
    _State.calls = 0
    rows = [Row(micros=(n - i) * 1_000_000, event=i, dangerous=True, chat=i % 10 == 0, reset=False) for i in range(n)]
    assert not list(processor.handleInputRows(("a",), iter(rows), None))
    first = list(processor.handleExpiredTimer(("a",), Times(n * 500), None))
    assert 0 < len(processor.waiting.kept) <= n / 2
    last = list(processor.handleExpiredTimer(("a",), Times(n * 2000), None))
    assert [r.event for r in first + last] == [i for i in range(n - 1, -1, -1) if i % 10 == 0 and i < n - 2] and first and last
    assert not processor.waiting.kept and _State.calls < 60


def test_streams_start_with_few_states(spark):
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    try:
        for asked in ("400", "1"):
            spark.conf.set(name, asked)
            with catalog._few_states(spark):
                assert int(spark.conf.get(name)) == min(int(asked), spark.sparkContext.defaultParallelism)
            assert spark.conf.get(name) == asked
    finally:
        spark.conf.set(name, given)


def test_danger_stream(spark, sf, folder):
    df = views.guard_events(spark, sf).select("ts", "verdict")
    stream = _as_files(df, f"{folder}/in", ["ts"], 2)
    windows = danger_stream(stream, window="6 hours", slide="1 hour")
    (windows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination())
    got = {(r.window_start, r.dangerous) for r in spark.read.schema(windows.schema).parquet(f"{folder}/out").collect()}
    batch = {(r.window_start, r.dangerous) for r in breaker.danger_watch(df, window="6 hours", slide="1 hour").collect()}
    # Windows behind the last watermark are final and equal; the newest are still open.
    assert got and got <= batch


def test_guard_stream(spark, sf, folder):
    df = views.planted_turns(spark, sf)
    stream = _as_files(df, f"{folder}/in", ["conv_id", "turn"], 2)
    guard_stream(stream, f"{folder}/ok", f"{folder}/no", f"{folder}/cp", keys=["conv_id", "turn"]).awaitTermination()
    ok, no = spark.read.parquet(f"{folder}/ok"), spark.read.parquet(f"{folder}/no")
    assert ok.count() + no.count() == df.count() and no.filter(F.col("code") == 0).count() == 0 and no.count() > 10


def test_streams_read_tables_that_are_folders(spark, sf, folder):
    for name, parts in (("events", 2), ("nation", None)):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if parts:
            df.repartition(parts).write.parquet(f"{folder}/sf/{name}.parquet")
        where = f"{folder}/sf" if parts else sf
        out, cp = f"{folder}/out-{name}", f"{folder}/cp-{name}"
        stream = views.table(spark, where, name, streaming=True)
        stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == df.count()
