import pandas as pd
import pytest

from lorelink.streaming import links as streams

SCHEMA = "context string, request_id string, seq long, label string, title string, senseProbability double"


def drained(spark, stream, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@pytest.fixture
def source(spark, tmp_path):
    """Two files, read as two batches."""
    parts = [[("c", "a", 1, "l", "T", 0.5), ("c", "a", 1, "m", "U", 0.1), ("d", "x", 1, "l", "T", 0.9)], [("c", "b", 2, "l", "T", 0.4), ("c", "b", 2, "n", "V", 0.4)]]
    (tmp_path / "in").mkdir()
    import time

    for i, p in enumerate(parts):
        pd.DataFrame(p, columns=["context", "request_id", "seq", "label", "title", "senseProbability"]).to_parquet(tmp_path / "in" / f"{i}.parquet")
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_unique(spark, source, tmp_path):
    got = drained(spark, streams.unique_links(source), tmp_path)
    assert sorted((r.context, r.title, r.request_id) for r in got.collect()) == [("c", "T", "a"), ("c", "U", "a"), ("c", "V", "b"), ("d", "T", "x")]


def test_chunk_numbers(spark, source, tmp_path):
    got = drained(spark, streams.chunk_numbers(source.select("context", "request_id", "seq").dropDuplicates(["context", "request_id"])), tmp_path)
    assert sorted((r.context_id, r.request_id) for r in got.collect()) == [("c:0", "a"), ("c:1", "b"), ("d:0", "x")]


def test_context_degrees(spark, source, tmp_path):
    got = drained(spark, streams.context_degrees(source), tmp_path)
    assert sorted((r.context, r.request_id, r.title, r.degree) for r in got.collect()) == [("c", "a", "T", 1), ("c", "a", "U", 0), ("c", "b", "T", 2), ("c", "b", "V", 1), ("d", "x", "T", 1)]
    near = {(r.request_id, r.title): (r.degree_centrality, list(r.others)) for r in got.collect()}
    assert near["b", "T"] == (2 / 6, ["[0-l]", "[1-l]"]) and near["a", "U"] == (0.0, []) and near["x", "T"] == (0.5, ["[0-l]"])


def test_context_graph_equals_the_batch_operator(spark, tmp_path):
    """Request by request, over several batches and with edges that leave, the state is the graph that the batch operator makes anew."""
    import random
    import time

    from lorelink.operators import context

    rng = random.Random(4)
    rows = [(c, f"{c}{i:02}", i, rng.choice("lmn"), rng.choice("TUVW"), rng.choice((0.1, 0.5))) for c in "cd" for i in range(14) for _ in range(rng.randint(1, 4))]
    (tmp_path / "in").mkdir()
    for k, (lo, hi) in enumerate(((0, 5), (5, 6), (6, 14))):
        pd.DataFrame([r for r in rows if lo <= r[2] < hi], columns=SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")).to_parquet(tmp_path / "in" / f"{k}.parquet")
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.context, r.request_id, r.title): (r.degree, round(r.degree_centrality, 9), set(r.others)) for r in drained(spark, streams.context_degrees(stream, span=3), tmp_path).collect()}
    # every request as the last one of a context of its own
    upto = [(f"{c}{n:02}", f"{c}{n:02}/{r}", i, label, title, p) for c, r, i, label, title, p in rows for n in range(i, 14)]
    links = spark.createDataFrame(upto, SCHEMA)
    chunks = context.numbered(links.select("context", "request_id", "seq").distinct())
    edges = context.alive(context.graph_edges(links, chunks), chunks, 3)
    degree = {(r.context, r.node): (r.degree, round(r.degree_centrality, 9)) for r in context.degrees(edges).collect()}
    near = {(r.context, r.node): set(r.others) for r in context.adjacency(edges).collect()}
    want = {(c, r, t): (*degree.get((r, t), (0, 0.0)), near.get((r, t), set())) for c, r, _, _, t, _ in rows}
    assert got == want


def timed(spark, tmp_path, name, rows, columns):
    (tmp_path / name).mkdir()
    df = pd.DataFrame(rows, columns=columns)
    df["ts"] = pd.to_datetime(df["ts"]).astype("datetime64[us]")
    spark.createDataFrame(df).write.mode("overwrite").parquet(str(tmp_path / name))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))


def test_windows_and_sessions(spark, tmp_path):
    rows = [("2024-01-01 00:05", 1, "a"), ("2024-01-01 00:20", 1, "a"), ("2024-01-01 01:30", 1, "b"), ("2024-01-01 09:00", 2, "a"), ("2024-01-02 09:00", 2, "a")]
    events = timed(spark, tmp_path, "e", rows, ["ts", "user_id", "event_type"])
    got = drained(spark, streams.window_counts(events, length="1 hour", slide="30 minutes"), tmp_path)
    assert {(str(r.start)[11:16], r.event_type, r.n) for r in got.collect()} >= {("00:00", "a", 2), ("01:00", "b", 1), ("01:30", "b", 1), ("09:00", "a", 1)}
    (tmp_path / "second").mkdir()
    got = drained(spark, streams.session_counts(events), tmp_path / "second")
    assert sorted((r.user_id, str(r.start)[11:16], str(r.end)[11:16], r.n) for r in got.collect()) == [(1, "00:05", "00:50", 2), (1, "01:30", "02:00", 1), (2, "09:00", "09:30", 1)]


def test_late_feedback(spark, tmp_path):
    links = timed(spark, tmp_path, "l", [("2024-01-01 00:00", "c", "1"), ("2024-01-01 00:00", "c", "2"), ("2024-01-03 00:00", "c", "9")], ["ts", "context", "id"])
    given = timed(spark, tmp_path, "f", [("2024-01-01 00:30", "c", "1", "good"), ("2024-01-01 05:00", "c", "2", "bad"), ("2024-01-03 00:00", "c", "8", "bad")], ["ts", "context", "id", "type"])
    got = drained(spark, streams.late_feedback(links, given), tmp_path)
    assert sorted((r.id, r.feedback) for r in got.collect() if r.id != "9") == [("1", "good"), ("2", None)]


def test_history(spark, source, tmp_path):
    streams.keep_history(source, str(tmp_path / "history"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "history")).count() == 5


def test_what_streams_hold_back_at_the_end(spark, tmp_path):
    links = timed(spark, tmp_path, "l", [("2024-01-01 00:00", "c", "1"), ("2024-01-01 00:00", "c", "2"), ("2024-01-03 00:00", "c", "9")], ["ts", "context", "id"])
    given = timed(spark, tmp_path, "f", [("2024-01-01 00:30", "c", "1", "good"), ("2024-01-01 00:40", "c", "1", "bad"), ("2024-01-03 00:00", "c", "8", "bad")], ["ts", "context", "id", "type"])
    got = drained(spark, streams.late_feedback(links, given), tmp_path)
    assert "9" not in {r.id for r in got.collect()}
    whole = streams.with_open_links(got, spark.read.parquet(str(tmp_path / "l")), ["context", "id", "ts"])
    assert sorted((r.id, r.feedback or "") for r in whole.collect()) == [("1", "bad"), ("1", "good"), ("2", ""), ("9", "")]
    rows = [("2024-01-01 00:05", 1), ("2024-01-01 00:20", 1), ("2024-01-02 08:50", 1), ("2024-01-02 08:55", 2), ("2024-01-02 09:00", 2)]
    events = timed(spark, tmp_path, "e", rows, ["ts", "user_id"])
    (tmp_path / "second").mkdir()
    closed = drained(spark, streams.session_counts(events), tmp_path / "second")
    assert closed.count() == 1
    whole = streams.with_open_sessions(closed, spark.read.parquet(str(tmp_path / "e")))
    assert sorted((r.user_id, str(r.start)[8:16], r.n) for r in whole.collect()) == [(1, "01 00:05", 2), (1, "02 08:50", 1), (2, "02 08:55", 2)]


def test_state_is_met_once_a_batch():
    """However many requests a batch has, each title and each chunk that lives on is written once; two batches give what one does."""
    import pandas as pd

    calls = []

    class Entries(dict):
        containsKey = dict.__contains__  # noqa: N815
        getValue = dict.__getitem__  # noqa: N815

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

        removeKey = dict.__delitem__  # noqa: N815

    class Count:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    def graph():
        made = streams.ContextGraph(0.2, 5)
        made.chunks, made.titles, made.counts = Entries(), Entries(), Count()
        return made

    rows = pd.DataFrame([("c", f"r{i:03}", i, f"l{i * k % 7}", f"t{(i + k) % 3}", k / 4) for i in range(60) for k in range(4)], columns=["context", "request_id", "seq", "label", "title", "senseProbability"])
    whole = next(graph().handleInputRows(("c",), iter([rows]), None))
    assert len(calls) <= 3 + 6
    halves = graph()
    parts = [next(halves.handleInputRows(("c",), iter([x]), None)) for x in (rows[:100], rows[100:])]
    assert whole.equals(pd.concat(parts, ignore_index=True)) and len(whole) == 180
