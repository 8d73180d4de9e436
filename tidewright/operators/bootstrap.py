"""Sequential bootstrap: draws of overlapping labels whose probabilities change with every draw."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.scan import sessions

PRIME = 2**31 - 1


def uniforms(draw: int, seed: int) -> tuple[float, float]:
    """Two numbers of [0, 1) for a draw: squares modulo a prime, which any engine can repeat."""
    a = (draw * 48271 + 11) % PRIME
    b = (a * a + seed) % PRIME
    c = (b * b + a) % PRIME
    return c / PRIME, (c * c + b) % PRIME / PRIME


class Bootstrap:
    """Draws from one group's spans.

    A span's uniqueness is the mean, over its bars, of 1 / (1 + draws so far that cover the bar); spans are drawn in proportion to it.
    That is the same as drawing a bar in proportion to (what its spans weigh) / (1 + draws that cover it), a span of n bars weighing
    1 / n on each, and then one of its spans by weight. Only bars' numbers have to be kept: a draw looks its bar up in sums of blocks of
    bars, and changes the bars of one span. No matrix of bars and spans is made.
    """

    def __init__(self, draws: int | None = None, seed: int = 42) -> None:
        self.rows: list[tuple] = []
        self.draws, self.seed = draws, seed

    def push(self, row: tuple) -> list[tuple]:
        if row[0] is not None and row[1] is not None and row[1] >= row[0]:
            self.rows.append(row)
        return []

    def close(self) -> list[tuple]:
        if not self.rows:
            return []
        start = np.array([r[0] for r in self.rows], np.int64)
        stop = np.array([r[1] for r in self.rows], np.int64)
        start, stop, base = start - start.min(), stop - start.min(), start.min()
        bars, size = int(stop.max()) + 1, stop - start + 1
        edges = np.zeros(bars + 1)
        np.add.at(edges, start, 1 / size)
        np.add.at(edges, stop + 1, -1 / size)
        weight = np.maximum(np.cumsum(edges[:-1]), 0)
        covered = np.zeros(bars + 1, np.int64)
        np.add.at(covered, start, 1)
        np.add.at(covered, stop + 1, -1)
        weight[np.cumsum(covered[:-1]) == 0] = 0
        block = max(16, int(bars**0.5))
        blocks = -(-bars // block)
        mass = np.zeros(blocks * block)
        mass[:bars] = weight
        sums = mass.reshape(blocks, block).sum(axis=1)
        drawn, longest, out = np.zeros(bars, np.int64), int(size.max()), []
        for k in range(1, (self.draws or len(start)) + 1):
            r1, r2 = uniforms(k, self.seed)
            along = np.cumsum(sums)
            goal = r1 * along[-1]
            b = min(int(np.searchsorted(along, goal, side="right")), blocks - 1)
            inside = np.cumsum(mass[b * block : (b + 1) * block]) + (along[b] - sums[b])
            bar = b * block + min(int(np.searchsorted(inside, goal, side="right")), block - 1)
            lo, hi = np.searchsorted(start, bar - longest + 1), np.searchsorted(start, bar, side="right")
            here = lo + np.flatnonzero(stop[lo:hi] >= bar)
            share = np.cumsum(1 / size[here])
            i = int(here[min(int(np.searchsorted(share, r2 * share[-1], side="right")), len(here) - 1)])
            a, z = int(start[i]), int(stop[i]) + 1
            out.append((k, self.rows[i][2], int(a + base), int(z - 1 + base), float((1 / (1 + drawn[a:z])).mean())))
            drawn[a:z] += 1
            mass[a:z] = weight[a:z] / (1 + drawn[a:z])
            for c in range(a // block, (z - 1) // block + 1):
                sums[c] = mass[c * block : (c + 1) * block].sum()
        return out


def sequential_bootstrap(spans: DataFrame, by: list[str], event: str, start: str = "start", stop: str = "stop", draws: int | None = None, seed: int = 42) -> DataFrame:
    """``by, draw, event, start, stop, uniqueness`` of ``draws`` draws (default: as many as there are spans) from each group of ``by``.

    ``start`` and ``stop`` are places of a span's first and last bar; spans without one of them, or that end before they begin, are
    left out, a group without spans has no draws. ``uniqueness`` is that of the span at its draw. Draws follow one another, so a group
    is one task's work and memory (three numbers a span); put a time bucket into ``by`` where a series is too long for that. Spans are
    taken in order of (start, event), which must be unique for reruns to agree.
    """
    schema = T.StructType([T.StructField("draw", T.LongType()), T.StructField(event, spans.schema[event].dataType), *(T.StructField(n, T.LongType()) for n in (start, stop)), T.StructField("uniqueness", T.DoubleType())])
    rows = spans.select(*by, F.col(start).cast("long"), F.col(stop).cast("long"), event)
    return sessions(rows, by, [start, event], [start, stop, event], lambda: Bootstrap(draws, seed), schema)
