"""Overlapping chunks of live recordings: frames come in, chunks go through a function, faded samples go out.

State of a recording is bounded by one chunk: the samples that no full chunk has taken, the tail of the last chunk, which the
next one is faded into, and frames that came before their turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state of recordings on disk.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

Enhance = Callable[[np.ndarray, int], np.ndarray]


def fades(fade: int) -> np.ndarray:
    """Weights of a chunk over its overlap with the one before; those of the one before are the rest to 1."""
    return (np.arange(fade) + 0.5) / fade if fade else np.zeros(0)


class ChunkedAudio(StatefulProcessor):
    """Samples of one recording in chunks of ``size`` that overlap by ``fade``; see ``enhanced_chunks``."""

    def __init__(self, size: int, fade: int, most_waiting: int, enhance: Enhance):
        self.size, self.fade, self.most_waiting, self.enhance = size, fade, most_waiting, enhance

    def init(self, handle: StatefulProcessorHandle) -> None:
        # next frame, chunks so far, place of the first sample held; samples held, tail of the last chunk
        self.position = handle.getValueState("position", "next long, chunk long, at long, held binary, tail binary")
        self.waiting = handle.getMapState("waiting", "seq long", "values binary, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        following, chunk, at, held, tail = self.position.get() if self.position.exists() else (0, 0, 0, b"", b"")
        held, tail = np.frombuffer(held), np.frombuffer(tail)
        n_waiting = 0
        for batch in rows:
            for seq, values, last in zip(batch["seq"], batch["values"], batch["last"]):
                if seq >= following:  # a frame that came before is not taken twice
                    self.waiting.updateValue((int(seq),), (np.asarray(values, dtype=float).tobytes(), bool(last)))
        out = []
        while self.waiting.containsKey((following,)):
            values, last = self.waiting.getValue((following,))
            self.waiting.removeKey((following,))
            held = np.concatenate([held, np.frombuffer(values)])
            following += 1
            # a chunk goes once a sample behind it shows that it is not the last one
            while len(held) > self.size or (last and len(held)):
                final = len(held) <= self.size
                whole = self._enhanced(held[: self.size], chunk)
                ready, tail = self._faded(whole, tail, final)
                out.append((at, ready))
                step = len(held) if final else self.size - self.fade
                held, at, chunk = held[step:], at + step, chunk + 1
        n_waiting = sum(1 for _ in self.waiting.keys())
        if n_waiting > self.most_waiting:
            raise ValueError(f"{n_waiting} frames of {key} wait for frame {following}; at most {self.most_waiting}")
        self.position.update((following, chunk, at, held.tobytes(), tail.tobytes()))
        for start, samples in out:
            yield pd.DataFrame({"key": key[0], "place": np.arange(start, start + len(samples)), "x": samples})

    def _enhanced(self, samples: np.ndarray, chunk: int) -> np.ndarray:
        out = np.asarray(self.enhance(samples, chunk), dtype=float)
        if out.shape != samples.shape:
            raise ValueError(f"{len(samples)} samples became {out.shape}")
        return out

    def _faded(self, whole: np.ndarray, tail: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        """What a chunk can give out now, and its tail, which waits for the next chunk."""
        if len(tail):
            up = fades(self.fade)
            whole = np.concatenate([tail * (1 - up) + whole[: self.fade] * up, whole[self.fade :]])
        keep = len(whole) if final else self.size - self.fade
        return whole[:keep], whole[keep:]

    def close(self) -> None:
        pass


def enhanced_chunks(frames: DataFrame, size: int, fade: int, enhance: Enhance, most_waiting: int = 10_000) -> DataFrame:
    """key, place, x: the samples of streaming ``frames(key, seq, values, last)`` after ``enhance(samples, chunk)``.

    Frames of a recording are numbered from 0 and may come in any order and any batches; ``last`` marks the one that ends it
    and lets the rest go, nothing is given out for good before. Chunks of ``size`` samples begin every ``size - fade``; the
    last one may be shorter, but has more than ``fade`` samples unless it is the only one. Neighbours are faded into each
    other linearly, so as many samples go out as came in, as in the batch operator ``live.overlap_add``. Frames that come
    twice count once; more than ``most_waiting`` frames behind a missing one are an error.
    """
    if not 0 <= fade <= size // 2:
        raise ValueError("the overlap is at most half a chunk")
    kind = dict(frames.dtypes)["key"]
    return (
        frames.select("key", "seq", "values", "last")
        .groupBy("key")
        .transformWithStateInPandas(ChunkedAudio(size, fade, most_waiting, enhance), f"key {kind}, place long, x double", "Append", "None")
    )
