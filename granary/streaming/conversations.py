"""Conversations as keyed state: questions, replies, failures, retries and resets of many sessions as one stream.

A session has a transcript, at most one open question, and a generation that every reset raises. A reply or a
failure counts only if its question is the open one of the present generation; any other is stale and changes
nothing. The state of a session that idles is forgotten, by a timer in event time or, where its next event
comes first, by that event, so the rows don't depend on how events are cut into batches as long as those of a
session arrive in order. A session is one key, as its events follow each other; sessions spread over tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from granary.package import ship

#: What an event says of a session: at (timestamp), seq (long, its order), kind (ask, reply, fail, retry, reset),
#: request (long, of a question and what answers it), text.
EVENTS = "session long, at timestamp, seq long, kind string, request long, text string"
#: outcome: asked, answered, failed, stale, ignored, reset, expired; messages: in the transcript after it;
#: history: the answered pairs that go with a question.
ROWS = "session long, seq long, outcome string, generation long, messages int, history array<struct<role:string,text:string>>"
IDLE, LATE = 1807, "10 minutes"

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Message = tuple[str, str]


class Session:
    """A conversation and how events change it; plain values, kept by the processor between batches."""

    def __init__(self, generation: int = 0, asked: int | None = None, log: list[Message] | None = None):
        self.generation, self.asked, self.log = generation, asked, log or []

    def history(self) -> list[Message]:
        """Replies, and the questions that they answer."""
        following = [*[r for r, _ in self.log[1:]], ""]
        return [m for m, after in zip(self.log, following, strict=False) if m[0] == "assistant" or (m[0] == "user" and after == "assistant")]

    def _ask(self, request: int, text: str) -> tuple[str, list[Message]]:
        told = self.history()
        self.log.append(("user", text))
        self.asked = request
        return "asked", told

    def take(self, kind: str, request: int | None, text: str) -> tuple[str, list[Message] | None]:
        if kind == "reset":
            self.generation, self.asked, self.log = self.generation + 1, None, []
            return "reset", None
        if kind in ("reply", "fail"):
            if request is None or request != self.asked:
                return "stale", None
            self.asked = None
            self.log.append(("assistant" if kind == "reply" else "error", text))
            return ("answered" if kind == "reply" else "failed"), None
        if self.asked is not None or request is None:
            return "ignored", None
        if kind == "ask" and text.strip():
            return self._ask(request, text.strip())
        if kind == "retry" and [r for r, _ in self.log[-2:]] == ["user", "error"]:
            question = self.log[-2][1]
            del self.log[-2:]
            return self._ask(request, question)
        return "ignored", None


class _Processor(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "generation long, asked long, last_ms long, last_seq long")
        self.log = handle.getListState("log", "role string, text string")

    def _load(self) -> tuple[Session, int, int]:
        if not self.now.exists():
            return Session(), 0, 0
        generation, asked, last, seq = self.now.get()
        return Session(generation, asked, [tuple(m) for m in self.log.get()]), last, seq

    def _forget(self) -> None:
        self.now.clear()
        self.log.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, last, seq = self._load()
        out, known = [], self.now.exists()
        events = pd.concat(rows).sort_values(["at", "seq"])
        for at, number, kind, request, text in zip(events["at"], events["seq"], events["kind"], events["request"], events["text"], strict=True):
            ms = int(at.timestamp() * 1000)
            if known and ms >= last + self.idle:
                out.append((key[0], seq, "expired", session.generation, len(session.log), None))
                session = Session()
            outcome, told = session.take(kind, None if pd.isna(request) else int(request), text or "")
            known, last, seq = True, ms, int(number)
            out.append((key[0], seq, outcome, session.generation, len(session.log), None if told is None else [{"role": r, "text": t} for r, t in told]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)
        self.now.update((session.generation, session.asked, last, seq))
        if session.log:
            self.log.put(session.log)
        else:
            self.log.clear()
        yield pd.DataFrame(out, columns=["session", "seq", "outcome", "generation", "messages", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, _, seq = self._load()
        self._forget()
        yield pd.DataFrame([(key[0], seq, "expired", session.generation, len(session.log), None)], columns=["session", "seq", "outcome", "generation", "messages", "history"])

    def close(self) -> None:
        pass


def conversation_rows(events: DataFrame, idle: int = IDLE, late: str = LATE) -> DataFrame:
    """A row per event (``ROWS``), and one where a session expires, ``idle`` seconds after its last event, with
    that event's seq. Questions are trimmed; an empty one, one without a request, and one while another is open
    are ignored; a retry asks the question again whose failure is the last message. Null texts count as empty. Events
    without session or time are dropped; extra columns are ignored. State is kept in RocksDB."""
    spark = events.sparkSession
    ship(spark)
    # the driver starts a worker for state too, which sees nothing that is shipped: the processor travels whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if events.isStreaming and spark.conf.get(_STORE) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)
    e = events.select("session", "at", "seq", "kind", "request", "text").filter("session is not null and at is not null").withWatermark("at", late)
    return e.groupBy("session").transformWithStateInPandas(_Processor(idle), ROWS, "append", "eventtime")
