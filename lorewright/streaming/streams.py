"""Streams: tailing, stateful token processing, rate limits and event-time windows.

Each stateful operator is one small state object (think filter, segment buffer, bucket) kept by key,
as JSON fields in the state row, and the same object replays a batch in order.
State holds what is not emitted yet, never a stream's history; it goes with its key's timeout.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .bucket import TokenBucket
from .segments import SegmentBuffer
from .think import ThinkFilter, strip


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone semantics."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tail(chunks: DataFrame, key: str, ts: str, late: str = "10 seconds", after=None) -> DataFrame:
    """STR1-STR3: rows newer than the history, each id once; ids are forgotten with the watermark.

    Rows later than ``late`` are dropped, as the polling reader loses rows older than its cursor.
    """
    rows = event_time(chunks, ts)
    if after is not None:
        rows = rows.where(F.col(ts) >= F.lit(after))
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Event-time windows, tumbling or sliding."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = event_time(events, ts).withWatermark(ts, late).groupBy(window.alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """STR14: session windows; a session ends after ``gap`` without events."""
    grouped = event_time(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


SEGMENT_SCHEMA = "chat_id string, seq long, segment string"


class _Reader:
    """Think filter, then segments, with sequence numbers (STR5, STR7, STR9)."""

    def __init__(self, limit: int, saved: str | None = None):
        d = json.loads(saved) if saved else {}
        self.think = ThinkFilter(**d.get("think", {}))
        self.buffer = SegmentBuffer(**d.get("buffer", {"limit": limit}))
        self.seq = d.get("seq", 0)

    def saved(self) -> str:
        self.think.blocks.clear()  # finished blocks are not state
        return json.dumps({"think": asdict(self.think), "buffer": asdict(self.buffer), "seq": self.seq})

    def _row(self, chat: str, segment: str | None) -> list[tuple]:
        if segment is None:
            return []
        self.seq += 1
        return [(chat, self.seq - 1, segment)]

    def feed(self, chat: str, token: str) -> list[tuple]:
        return self._row(chat, self.buffer.feed(self.think.feed(token)))

    def tick(self, chat: str) -> list[tuple]:
        return self._row(chat, self.buffer.tick())

    def end(self, chat: str) -> list[tuple]:
        self.buffer.buffer += self.think.flush()
        return self._row(chat, self.buffer.flush())


def segments_of_batch(tokens: DataFrame, limit: int = 100) -> DataFrame:
    """(chat_id, token_index, token_text) to segments; each chat is one stream in token order.

    A chat is one conversation's tokens, which is what bounds a group.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        reader, rows = _Reader(limit), []
        for token in pdf.sort_values("token_index")["token_text"]:
            rows += reader.feed(key[0], token or "")
        return pd.DataFrame(rows + reader.end(key[0]), columns=["chat_id", "seq", "segment"])

    return tokens.select("chat_id", "token_index", "token_text").groupBy("chat_id").applyInPandas(run, SEGMENT_SCHEMA)


def segments_of_stream(tokens: DataFrame, limit: int = 100, idle: str = "1 minute") -> DataFrame:
    """The same over an unbounded stream; a chat ends with a null token or after ``idle`` of silence."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = _Reader(limit, state.get[0] if state.exists else None)
        rows, ended = [], state.hasTimedOut
        if not ended:
            for token in pd.concat(list(pdfs)).sort_values("token_index")["token_text"]:
                if token is None:
                    ended = True
                else:
                    rows += reader.feed(key[0], token)
        if ended:
            rows += reader.end(key[0])
            state.remove()
        else:
            state.update((reader.saved(),))
            state.setTimeoutDuration(ms)
        yield pd.DataFrame(rows, columns=["chat_id", "seq", "segment"])

    grouped = tokens.select("chat_id", "token_index", "token_text").groupBy("chat_id")
    return grouped.applyInPandasWithState(run, SEGMENT_SCHEMA, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)


DECISION_SCHEMA = "key string, request_id long, allowed boolean"


def rate_limited_batch(requests: DataFrame, limit: int) -> DataFrame:
    """(key, request_id, at in seconds) to decisions, in time order for each key.

    Rows of a key lie together in one sorted partition; what is held is its bucket and one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket = None, None
        for pdf in batches:
            keys, allowed = pdf["key"].astype(object).where(pdf["key"].notna(), None), []
            for key, at in zip(keys, pdf["at"], strict=True):
                if bucket is None or key != current:
                    current, bucket = key, TokenBucket(limit)
                allowed.append(bucket.allow(at))
            yield pd.DataFrame({"key": keys, "request_id": pdf["request_id"], "allowed": allowed})

    rows = requests.select("key", "request_id", "at").repartition("key")
    return rows.sortWithinPartitions("key", F.asc_nulls_last("at"), F.asc_nulls_last("request_id")).mapInPandas(run, DECISION_SCHEMA)


def rate_limited_stream(requests: DataFrame, limit: int, idle: str = "2 hours") -> DataFrame:
    """The same over a stream; idle buckets are forgotten."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = TokenBucket(limit, *(state.get if state.exists else ()))
        pdf = pd.concat(list(pdfs)).sort_values(["at", "request_id"])
        allowed = [bucket.allow(t) for t in pdf["at"]]
        state.update((bucket.tokens, bucket.last))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"], "allowed": allowed})

    grouped = requests.select("key", "request_id", "at").groupBy("key")
    return grouped.applyInPandasWithState(run, DECISION_SCHEMA, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_status(log: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """STR12: the latest status of every task, from an append-only log."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(ts, status)).alias(status), F.max(ts).alias("at"))


@F.pandas_udf(T.StringType())
def without_thinking(texts: pd.Series) -> pd.Series:
    """STR7 over whole texts: think blocks out, unclosed ones too; the same states as over tokens."""
    return texts.map(strip, na_action="ignore")


@F.pandas_udf(T.StructType().add("mode", T.StringType()).add("held", T.StringType()).add("n_blocks", T.LongType()).add("shown", T.StringType()))
def think_states(texts: pd.Series) -> pd.DataFrame:
    """SUP37: the filter's state after every text, and what it has shown of it."""
    rows = []
    for text in texts:
        f = ThinkFilter()
        shown = f.feed(text or "")
        rows.append((f.mode, f.held, len(f.blocks), shown))
    return pd.DataFrame(rows, columns=["mode", "held", "n_blocks", "shown"])


def think_seconds(tokens: DataFrame, key: str, ts: str, text: str) -> DataFrame:
    """STR8: key, seconds: from a stream's first opening tag to its first closing one, null where either lacks."""
    opened, closed = F.rlike(text, F.lit(r"(?i)<think\b")), F.rlike(text, F.lit(r"(?i)</think\s*>"))
    seconds = F.unix_micros(F.min(F.when(closed, F.col(ts).cast("timestamp")))) - F.unix_micros(F.min(F.when(opened, F.col(ts).cast("timestamp"))))
    return tokens.groupBy(key).agg((seconds / 1_000_000).alias("seconds"))


def tagged(tokens: DataFrame, source: str) -> DataFrame:
    """STR10: tokens as they are kept, with the stream that they came from."""
    return tokens.withColumn("streaming_source", F.lit(source))


def usage(chats: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """SUP34: usage as character lengths, and why the answer ended."""
    n, m = (F.char_length(F.coalesce(c, F.lit(""))).cast("long") for c in (question, answer))
    finish = F.when(m == 0, "empty").otherwise("stop")
    return chats.select(key, n.alias("prompt"), m.alias("completion"), (n + m).alias("total"), finish.alias("finish_reason"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """A stream's rows of all that is there now, appended to files; it runs until its last batch is written."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
