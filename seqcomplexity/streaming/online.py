"""Online LZ76 over keyed symbol streams: Structured Streaming with arbitrary state.

The state of a key is the text so far, the open word's start, where it was found last, and the phrases closed. A row's symbol extends the text; a null
symbol resets the key. Within a micro-batch rows are taken in order of ``order``; a row not after the last one processed, or of
null order, is late: a parsing can't be revised, so the row is counted as late and otherwise ignored. State grows with the text of a key, as the
parsing needs all of it; ``max_symbols`` resets a key that reaches it, and ``idle`` drops one that has been silent so long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, pos long, symbol string, completed boolean, n_phrases int, text string, late long"
_STATE = "text string, start int, closed int, hit int, last long, late long"
FOUND = "key string, at long, pattern string, found boolean, text_len long, late long"
_NEVER = -(1 << 63)


class OnlineLZ76:
    """The parser's state, one symbol at a time. ``hit`` is where the open word occurred last; a longer word doesn't occur before."""

    def __init__(self, text: str = "", start: int = 0, closed: int = 0, hit: int = 0):
        self.text, self.start, self.closed, self.hit = text, start, closed, hit

    @classmethod
    def of(cls, text: str) -> OnlineLZ76:
        parser = cls()
        parser.extend(text)
        return parser

    def add(self, symbol: str) -> bool:
        """Take a symbol; whether it completes a phrase."""
        if not isinstance(symbol, str):
            raise TypeError("a symbol is a string")
        if len(symbol) != 1:
            raise ValueError("a symbol is one code point")
        return self.extend(symbol)[0][0]

    def extend(self, symbols: str) -> list[tuple[bool, int, int]]:
        """Take symbols; for each whether it completes a phrase, the phrases so far with an open word, and the open word's start."""
        first, text = len(self.text), self.text + symbols
        self.text, out = text, []
        for j in range(first, len(text)):
            size = j - self.start
            # Either the last occurrence goes on, or the next one is looked for behind it.
            if size == 0 or self.hit + size >= j or text[self.hit + size] != text[j]:
                self.hit = text.find(text[self.start:j + 1], self.hit if size else 0, j)
            done = self.hit < 0
            if done:
                self.closed, self.start, self.hit = self.closed + 1, j + 1, 0
            out.append((done, self.closed + (not done), self.start))
        return out

    @property
    def n_phrases(self) -> int:
        return self.closed + (self.start < len(self.text))

    def dictionary(self) -> list[str]:
        from ..kernels import lz76_phrases

        return lz76_phrases(self.text)

    def reset(self) -> None:
        self.text, self.start, self.closed, self.hit = "", 0, 0, 0


def lz76_online(stream: DataFrame, key: str, symbol: str, order: str, initial_text: str = "", max_symbols: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """One row for each accepted symbol: ``key, pos, symbol, completed, n_phrases, text, late``.

    ``order`` is a long column, unique and rising within a key (a sequence number, or micros of an event time). ``text`` is the
    open word. ``initial_text`` is what every key has seen before its first symbol. Append mode."""
    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, start, closed, hit, last, late = state.get if state.exists else (None, 0, 0, 0, None, 0)
        parser = OnlineLZ76.of(initial_text) if text is None else OnlineLZ76(text, start, closed, hit)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out, pending = [], []

        def flush() -> None:
            at = len(parser.text)
            told = parser.extend("".join(s for s, _ in pending))
            for i, ((sign, count), (done, phrases, begin)) in enumerate(zip(pending, told)):
                out.append((str(group[0]), at + i, sign, done, phrases, parser.text[begin:at + i + 1], count))
            pending.clear()

        for at, sign in zip(rows["at"].tolist(), rows["symbol"].tolist()):
            if at == _NEVER or last is not None and at <= last:
                late += 1
                continue
            last = at
            if sign is None or max_symbols is not None and len(parser.text) + len(pending) >= max_symbols:
                flush()
                parser.reset()
            if sign is not None:
                if len(sign) != 1:
                    raise ValueError("a symbol is one code point")
                pending.append((sign, late))
        flush()
        state.update((parser.text, parser.start, parser.closed, parser.hit, last, late))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "pos", "symbol", "completed", "n_phrases", "text", "late"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(symbol).cast("string").alias("symbol"), F.coalesce(F.col(order).cast("long"), F.lit(_NEVER)).alias("at"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(run, OUTPUT, _STATE, "append", timeout)


def find_online(stream: DataFrame, key: str, symbol: str, order: str, pattern: str, initial_text: str = "") -> DataFrame:
    """One row for each row with a pattern: ``key, at, pattern, found, text_len, late``; whether the pattern occurs in the key's text so far.

    A row's symbol, if it has one, is appended before its pattern is looked for; the empty pattern is always found. ``late`` rows,
    those not after the last one processed, or of null order, are counted and ignored. Append mode."""
    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, last, late = state.get if state.exists else (initial_text, None, 0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        kept = []
        for at, sign, asked in zip(rows["at"].tolist(), rows["symbol"].tolist(), rows["pattern"].tolist()):
            if at == _NEVER or last is not None and at <= last:
                late += 1
                continue
            last = at
            kept.append((at, sign or "", asked, late))
        size, out = len(text), []
        text += "".join(sign for _, sign, _, _ in kept)
        for at, sign, asked, count in kept:
            size += len(sign)
            if asked is not None:
                out.append((str(group[0]), at, asked, text.find(asked, 0, size) >= 0, size, count))
        state.update((text, last, late))
        yield pd.DataFrame(out, columns=["key", "at", "pattern", "found", "text_len", "late"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(symbol).cast("string").alias("symbol"), F.col(pattern).cast("string").alias("pattern"), F.coalesce(F.col(order).cast("long"), F.lit(_NEVER)).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(run, FOUND, "text string, last long, late long", "append", GroupStateTimeout.NoTimeout)
