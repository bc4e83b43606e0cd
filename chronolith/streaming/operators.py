"""Stateful stream operators: the steps of the batch operators, one state for each key.

A state is pickled between micro-batches, so a restart from the checkpoint goes on where it was.
Rows of a key have to arrive in order across micro-batches, and inside one they are sorted; a row
that comes behind one already used is an error, since its result is out.  A row whose `last` is
true ends its key's stream: what is open is emitted and the state goes.

ST7: a state may be due without new rows.  With `idle`, a key that nothing has arrived for in so
many milliseconds of processing time is asked what may go, once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunks import ChunkRules, Pending, chunk_step, closed
from ..operators.frames import Frame, FrameWatch, hash_code
from ..operators.speech import Pack, PackRules, SpeechDetector, SpeechRules, pack_due, pack_step

Step = Callable[[Any, pd.DataFrame], tuple[Any, list[tuple]]]


def stateful(stream: DataFrame, key: str, order: str, schema: str, start: Callable[[], Any], feed: Step, finish: Callable[[Any], list[tuple]], waited: Callable[[Any], tuple[Any, list[tuple]]] | None = None, idle: int = 0) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number, at = pickle.loads(state.get[0]) if state.exists else (start(), 0, None)
        if state.hasTimedOut:
            held, out = waited(held)
            state.update((pickle.dumps((held, number + len(out), at)),))
        else:
            rows = pd.concat(list(batches)).sort_values(order)
            if at is not None and rows[order].iloc[0] <= at:
                raise ValueError(f"{key} {keys[0]}: {order} {rows[order].iloc[0]} came after {at}")
            held, out = feed(held, rows)
            if rows["last"].any():
                out = out + finish(held)
                state.remove()
            else:
                state.update((pickle.dumps((held, number + len(out), rows[order].iloc[-1])),))
                if idle:
                    state.setTimeoutDuration(idle)
        yield pd.DataFrame([(keys[0], number + i, *x) for i, x in enumerate(out)], columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def stream_chunks(segments: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """C1 over a stream of video_id, idx, start_s, end_s, text, last."""

    def shown(found: list) -> list[tuple]:
        return [(start, end, text, first, last) for first, last, start, end, text in found]

    def feed(held: Pending, rows: pd.DataFrame) -> tuple[Pending, list[tuple]]:
        out = []
        for r in rows.itertuples():
            held, done = chunk_step(held, (r.idx, r.start_s, r.end_s, r.text), rules)
            out += done
        return held, shown(out)

    return stateful(segments, "video_id", "idx", "video_id long, idx long, start_s double, end_s double, text string, first_segment long, last_segment long", Pending, feed, lambda held: shown(closed(held)))


def stream_regions(windows: DataFrame, rules: SpeechRules = SpeechRules()) -> DataFrame:
    """C4, ST2, ST5 over a stream of stream_id, w, p, last; `frontier` is the sample before which sound may be dropped."""

    def feed(held: SpeechDetector, rows: pd.DataFrame) -> tuple[SpeechDetector, list[tuple]]:
        found = held.feed(rows["p"])
        return held, [(*x, held.frontier) for x in found]

    def finish(held: SpeechDetector) -> list[tuple]:
        found = held.finish()
        return [(*x, held.position) for x in found]

    return stateful(windows, "stream_id", "w", "stream_id long, region long, start_sample long, end_sample long, frontier long", lambda: SpeechDetector(rules), feed, finish)


def stream_packs(regions: DataFrame, most: float = 30.0, first: float = 10.0, join_gap: float = 3.0, span: float = 120.0, idle: int = 0) -> DataFrame:
    """C6, ST7, ST14 over a stream of stream_id, region, start_sample, end_sample, last: one row a pack.

    With columns position and frontier (how far sound was heard, and from where on regions may still
    begin) a pack goes as soon as no later region can join it; with `idle`, also when nothing arrives.
    """
    rules = PackRules(most, first, join_gap, span)
    marked = {"position", "frontier"} <= set(regions.columns)

    def shown(found: list) -> list[tuple]:
        return [(p[0][0], p[-1][1], len(p), sum(e - s for s, e in p)) for p in found if p]

    def feed(held: Pack, rows: pd.DataFrame) -> tuple[Pack, list[tuple]]:
        out = []
        for r in rows.itertuples():
            held, done = pack_step(held, r.start_sample, r.end_sample, rules)
            out.append(done)
            if marked:
                held, done = pack_due(held, r.position, r.frontier, rules)
                out.append(done)
        return held, shown(out)

    def waited(held: Pack) -> tuple[Pack, list[tuple]]:
        return Pack(out=held.out + bool(held.regions)), shown([held.regions])

    schema = "stream_id long, pack long, start_sample long, end_sample long, regions int, samples long"
    return stateful(regions, "stream_id", "region", schema, Pack, feed, lambda held: shown([held.regions]), waited, idle)


def stream_frames(thumbs: DataFrame, width: int, strategy: str = "auto", interval: float = 10.0, bits: int = 10) -> DataFrame:
    """C7, ST6 over a stream of video_id, t, frame_id, pixels, last."""

    def feed(held: FrameWatch, rows: pd.DataFrame) -> tuple[FrameWatch, list[tuple]]:
        pixels = [np.asarray(p, np.int32) for p in rows["pixels"]]
        frames = [Frame(float(t), p, hash_code(p, width), int(i)) for t, p, i in zip(rows["t"], pixels, rows["frame_id"])]
        return held, [x for x in map(held.see, frames) if x]

    return stateful(thumbs, "video_id", "t", "video_id long, idx long, frame_id long, t double, reason string", lambda: FrameWatch(strategy, interval, bits=bits), feed, lambda held: [x for x in [held.close()] if x])
