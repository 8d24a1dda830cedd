"""Token streams with timers: state that outlives a batch, in any order and split of the tokens.

Tokens carry their place in their chat. What arrives early waits in map state for its predecessor, so
results depend neither on how tokens are dealt over batches nor on their order. A chat ends with a null
token; its state goes then, or after ``ttl`` of silence. Both processors keep plain values only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .segments import has_formula, merged
from .streams import _Reader

#: State with several variables and timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Timers would keep a query going that is to end with the data that is there.
NO_IDLE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def timed_state(spark: SparkSession, ends: bool = False) -> Iterator[None]:
    """Settings under which to start a query with timers (``ends``: one that reads what is there), taken back afterwards."""
    wanted = {**STORE, **(NO_IDLE if ends else {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


class _InOrder(StatefulProcessor):
    """Feeds each chat's tokens in the order of their places, which count from 0."""

    def __init__(self, ttl: str):
        self.ttl = _ms(ttl)

    def init(self, handle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "next long, reader string", self.ttl)
        self.early = handle.getMapState("early", "place long", "token string", self.ttl)

    def _begin(self) -> tuple[int, str | None]:
        """Where a chat goes on and its reader; one that is new has neither early tokens nor timers to ask for."""
        found = self.saved.get() if self.saved.exists() else None
        self.is_known = found is not None
        return found or (0, None)

    def _ready(self, rows: Iterator[pd.DataFrame], at: int) -> tuple[list[str | None], int]:
        """Tokens from place ``at`` on without a gap; the others wait."""
        has_early = self.is_known and self.early.exists()
        new = {}
        for pdf in rows:
            new.update(zip(pdf["token_index"].tolist(), pdf["token_text"].astype(object).where(pdf["token_text"].notna(), None), strict=True))
        out: list[str | None] = []
        while True:
            if at in new:
                out.append(new.pop(at))
            elif has_early and self.early.containsKey((at,)):
                out.append(self.early.getValue((at,))[0])
                self.early.removeKey((at,))
            else:
                break
            at += 1
        for place, token in new.items():
            if place > at:  # earlier ones have been read already
                self.early.updateValue((int(place),), (token,))
                self.is_known = True
        return out, at

    def _stop_timers(self) -> None:
        if self.is_known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _forget(self) -> None:
        self._stop_timers()
        if self.is_known:
            self.saved.clear()
            self.early.clear()

    def close(self) -> None:
        pass


@F.pandas_udf(T.ArrayType(T.StringType()))
def merged_segments(segments: pd.Series) -> pd.Series:
    """STR6 as a column of arrays."""
    return segments.map(lambda x: merged(list(x)), na_action="ignore")


SEGMENTS = "chat_id string, seq long, segment string, has_formula boolean, is_final boolean"


class _Segments(_InOrder):
    def __init__(self, limit: int, wait: str, ttl: str):
        super().__init__(ttl)
        self.limit, self.wait = limit, _ms(wait)

    def _table(self, rows: list[tuple], final: bool) -> pd.DataFrame:
        done = [(*r, has_formula(r[2]), final and i == len(rows) - 1) for i, r in enumerate(rows)]
        return pd.DataFrame(done, columns=["chat_id", "seq", "segment", "has_formula", "is_final"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, saved = self._begin()
        reader = _Reader(self.limit, saved)
        tokens, at = self._ready(rows, at)
        out: list[tuple] = []
        for token in tokens:
            if token is None:
                self._forget()
                yield self._table(out + reader.end(key[0]), True)
                return
            out += reader.feed(key[0], token)
        self.saved.update((at, reader.saved()))
        self._stop_timers()
        if reader.buffer.buffer:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        if out:
            yield self._table(out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Nothing came for ``wait``: what is there goes, unless a formula is open."""
        out: list[tuple] = []
        if self.saved.exists():
            at, saved = self.saved.get()
            reader = _Reader(self.limit, saved)
            out = reader.tick(key[0])
            self.saved.update((at, reader.saved()))
        yield self._table(out, False)


def timed_segments(tokens: DataFrame, limit: int = 100, wait: str = "1 second", ttl: str = "1 hour") -> DataFrame:
    """STR5, STR6: segments of a stream (chat_id, token_index from 0, token_text); start it within ``timed_state``."""
    grouped = tokens.select("chat_id", "token_index", "token_text").groupBy("chat_id")
    return grouped.transformWithStateInPandas(_Segments(limit, wait, ttl), SEGMENTS, "append", "processingTime")


#: What opens a formula, its kind and what closes it, longer ones first.
DELIMITERS = {"$$": ("display", "$$"), "\\[": ("display", "\\]"), "\\(": ("inline", "\\)"), "$": ("inline", "$")}


@dataclass
class FormulaReader:
    """TX11: formulas out of a text that comes in pieces.

    Within one piece a delimiter of two characters is seen; one that two pieces share is not: its halves
    count as they stand (a dollar opens or closes, a backslash is text). ``joined`` looks one character
    further: the last character of a piece is kept back as long as it may begin a delimiter, and nothing
    is missed. ``shown`` counts the characters before this point, without delimiters.
    """

    joined: bool = False
    opened: str = ""
    formula: str = ""
    shown: int = 0
    start: int = 0
    kept: str = ""
    counts: dict = field(default_factory=dict)

    def feed(self, piece: str) -> list[tuple[str, str, str, int]]:
        """(formula, kind, delimiter, start) of the formulas that end in this piece."""
        text, found, i = self.kept + piece, [], 0
        self.kept = ""
        while i < len(text):
            if self.joined and i == len(text) - 1 and text[i] in "\\$" and not (text[i] == "$" and self.opened == "$"):
                self.kept = text[i]
                break
            if self.opened:
                kind, close = DELIMITERS[self.opened]
                if text.startswith(close, i):
                    found.append((self.formula, kind, self.opened, self.start))
                    self.counts[kind] = self.counts.get(kind, 0) + 1
                    self.opened = ""
                    i += len(close)
                    continue
                self.formula += text[i]
            else:
                opener = next((d for d in DELIMITERS if text.startswith(d, i)), "")
                if opener:
                    self.opened, self.formula, self.start = opener, "", self.shown
                    i += len(opener)
                    continue
            self.shown += 1
            i += 1
        return found

    def end(self) -> list[tuple[str, str, str, int]]:
        """The end of the text: what was kept back is all there is."""
        last, self.kept, joined = self.kept, "", self.joined
        self.joined = False
        out = self.feed(last)
        self.joined = joined
        return out


FORMULAS = "chat_id string, n long, formula string, kind string, delimiter string, start long, of_kind long"


class _Formulas(_InOrder):
    def __init__(self, joined: bool, ttl: str):
        super().__init__(ttl)
        self.joined = joined

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, saved = self._begin()
        reader = FormulaReader(**json.loads(saved)) if saved else FormulaReader(self.joined)
        tokens, at = self._ready(rows, at)
        out: list[tuple] = []
        for token in tokens:
            before = dict(reader.counts)
            for formula, kind, delimiter, start in reader.end() if token is None else reader.feed(token):
                before[kind] = before.get(kind, 0) + 1
                out.append((key[0], sum(before.values()), formula, kind, delimiter, start, before[kind]))
        if None in tokens:
            self._forget()
        else:
            self.saved.update((at, json.dumps(asdict(reader))))
        if out:
            yield pd.DataFrame(out, columns=["chat_id", "n", "formula", "kind", "delimiter", "start", "of_kind"])


def streamed_formulas(tokens: DataFrame, joined: bool = False, ttl: str = "1 hour") -> DataFrame:
    """TX11: the formulas of a stream of tokens, numbered within their chat and their kind; start it within ``timed_state``."""
    grouped = tokens.select("chat_id", "token_index", "token_text").groupBy("chat_id")
    return grouped.transformWithStateInPandas(_Formulas(joined, ttl), FORMULAS, "append", "processingTime")


def placed_tokens(rows: DataFrame, chat: str, order: list[str], text: str, pattern: str) -> DataFrame:
    """(chat_id, token_index, token_text): texts cut at ``pattern`` and numbered within their chat, with a null token at its end."""
    cut = rows.select(F.col(chat).cast("string").alias("chat_id"), *order, F.split(F.coalesce(text, F.lit("")), pattern, -1).alias("tokens"))
    along = Window.partitionBy("chat_id").orderBy(*order)
    first = F.coalesce(F.sum(F.size("tokens")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("first", first)
    last = placed.groupBy("chat_id").agg(F.max(F.col("first") + F.size("tokens")).alias("token_index")).select("chat_id", "token_index", F.lit(None).cast("string").alias("token_text"))
    each = placed.select("chat_id", "first", F.posexplode("tokens").alias("p", "token_text"))
    return each.select("chat_id", (F.col("first") + F.col("p")).cast("long").alias("token_index"), "token_text").union(last)
