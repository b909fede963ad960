"""Operators with state, keyed by context, as structured streaming."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def unique_links(links: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first link of each title in each context; state for ever, or with (column, delay) until the watermark passes."""
    if watermark:
        return links.withWatermark(*watermark).dropDuplicatesWithinWatermark(["context", "title"])
    return links.dropDuplicates(["context", "title"])


def window_counts(events: DataFrame, time: str = "ts", key: str = "event_type", length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events by window of event time and key; late ones up to the delay count."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    counted = events.withWatermark(time, delay).groupBy(span.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key: events without a gap between them."""
    counted = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def late_feedback(links: DataFrame, feedback: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Links of a stream with feedback of another that comes within the delay, null if none does. Both have ts."""
    a, b = links.withWatermark("ts", delay).alias("a"), feedback.withWatermark("ts", delay).alias("b")
    within = F.expr(f"a.context = b.context AND a.id = b.id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {delay}")
    return a.join(b, within, "leftOuter").select("a.*", F.col("b.type").alias("feedback"))


def with_open_links(given: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """What late_feedback() gave until its input ended, and the links that it still held back: no feedback for them has come.

    `keys` tell links apart; links are the same rows as a table.
    """
    still = links.join(given.select(*keys).distinct(), keys, "left_anti")
    return given.unionByName(still.withColumn("feedback", F.lit(None).cast("string")))


def with_open_sessions(closed: DataFrame, events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Sessions that session_counts() gave until its input ended, and those that the watermark hadn't passed, of the same rows as a table.

    A key's sessions are given in the order of time, so what is open lies behind the last one.
    """
    last = closed.groupBy(key).agg(F.max("end").alias("_last"))
    rest = events.join(last, key, "left").where(F.col("_last").isNull() | (F.col(time) >= F.col("_last")))
    counted = rest.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return closed.unionByName(counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"))


class ChunkCounter(StatefulProcessor):
    """Gives each request of a context its number, in the order of seq within a batch: "context:n"."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = int(self.next.get()[0]) if self.next.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["seq", "request_id"])
        numbers = range(n, n + len(batch))
        self.next.update((n + len(batch),))
        yield pd.DataFrame({"context": key[0], "request_id": batch["request_id"].to_numpy(), "context_id": [f"{key[0]}:{i}" for i in numbers], "chunk": list(numbers)})

    def close(self) -> None:
        pass


class ContextGraph(StatefulProcessor):
    """A context's graph: labels of each chunk, their titles and chunks; a chunk's edges leave `span` chunks later. Gives
    each title of a request its degree, its centrality among all nodes, and its neighbours.

    Rows: context, request_id, seq, label, title, senseProbability. A label belongs to one chunk, so each edge is made in
    one chunk: the edges of a chunk are one entry of the state, which leaves as a whole, and each title has an entry with
    its neighbours. A batch reads the titles of its requests and of the chunks that leave, not the whole graph, and writes each
    of them once, at its end: every call of the state is a message. The number of nodes is counted along.
    """

    def __init__(self, least: float = 0.2, span: int = 100) -> None:
        self.least, self.span = least, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk long", "pairs string")  # JSON: [label, title] of a chunk
        self.titles = handle.getMapState("titles", "title string", "labels string")  # JSON: [chunk, label] of a title
        self.counts = handle.getValueState("counts", "chunk long, titles long, labels long")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows))
        place = batch.groupby(["seq", "request_id"], sort=True, dropna=False).ngroup().to_numpy()
        plain = lambda c: [None if pd.isna(x) else x for x in batch[c]]
        requests: dict[int, list] = {}
        for n, *row in zip(place.tolist(), plain("request_id"), plain("label"), plain("title"), (batch["senseProbability"] >= self.least).tolist(), strict=True):
            requests.setdefault(n, []).append(row)
        chunk, titles, labels = (int(x) for x in self.counts.get()) if self.counts.exists() else (-1, 0, 0)
        near, stored, new, out = {}, set(), {}, []  # what titles have, which of them the state has, this batch's chunks

        def of(title: str) -> list:
            if title not in near:
                had = self.titles.containsKey((title,))
                near[title] = json.loads(self.titles.getValue((title,))[0]) if had else []
                if had:
                    stored.add(title)
            return near[title]

        def put(title: str, found: list) -> int:
            """Set a title's neighbours; returns by how many the titles with any change."""
            change = bool(found) - bool(of(title))
            near[title] = found
            return change

        for n in sorted(requests):
            part = requests[n]
            chunk += 1
            gone = chunk - self.span - 1
            left = new.pop(gone, None)
            if left is None and self.chunks.containsKey((gone,)):
                left = json.loads(self.chunks.getValue((gone,))[0])
                self.chunks.removeKey((gone,))
            if left:
                labels -= len({label for label, _ in left})
                for title in {t for _, t in left}:
                    titles += put(title, [x for x in of(title) if x[0] != gone])
            pairs = sorted({(label, t) for _, label, t, likely in part if likely}, key=lambda x: (x[0] is None, x[0] or "", x[1] is None, x[1] or ""))
            if pairs:
                new[chunk] = pairs
                labels += len({label for label, _ in pairs})
                for title in {t for _, t in pairs}:
                    titles += put(title, of(title) + [[chunk, label] for label, t in pairs if t == title])
            linked = chunk - max(0, gone) + 1 if chunk else int(bool(pairs))  # chunks in a row, the first by itself only with labels
            nodes = titles + labels + linked
            for title in sorted({t for _, _, t, _ in part if t is not None}):
                has = of(title)
                out.append((key[0], part[0][0], title, len(has), len(has) / (nodes - 1) if has else 0.0, [f"[{c}-{label}]" for c, label in has]))
        for at, pairs in new.items():
            self.chunks.updateValue((at,), (json.dumps(pairs),))
        for title, found in near.items():
            if found:
                self.titles.updateValue((title,), (json.dumps(found),))
            elif title in stored:
                self.titles.removeKey((title,))
        self.counts.update((chunk, titles, labels))
        yield pd.DataFrame(out, columns=["context", "request_id", "title", "degree", "degree_centrality", "others"])

    def close(self) -> None:
        pass


def chunk_numbers(requests: DataFrame) -> DataFrame:
    """context, request_id, context_id, chunk of a stream of requests."""
    return requests.groupBy("context").transformWithStateInPandas(ChunkCounter(), "context string, request_id string, context_id string, chunk long", "Append", "None")


def context_degrees(links: DataFrame, least: float = 0.2, span: int = 100) -> DataFrame:
    """context, request_id, title, degree, degree_centrality, others in the context's graph of a stream of links.

    The graph is as it stands with the request's own links and without those more than `span` chunks old; titles that no
    link of `least` or more leads to have degree 0.
    """
    return links.groupBy("context").transformWithStateInPandas(ContextGraph(least, span), "context string, request_id string, title string, degree long, degree_centrality double, others array<string>", "Append", "None")


def keep_history(links: DataFrame, path: str, checkpoint: str):
    """Append a stream of links to the history table, each row once."""
    return links.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package
