"""A particle filter along each key's events, in a stream or over a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "at timestamp, id long, estimate double, deviation double, effective double"


@dataclass
class Motion:
    """How particles start, move from event to event, and how likely a value is given each; chance comes from the generator only."""

    start: Callable[[np.random.Generator, int, float], np.ndarray]
    move: Callable[[np.random.Generator, np.ndarray], np.ndarray]
    log_likelihood: Callable[[np.ndarray, float], np.ndarray]


def drifting(drift: float, noise: float) -> Motion:
    """A hidden value that takes normal steps and is seen with normal noise; both are variances."""
    return Motion(lambda g, n, x: x + g.normal(size=n) * noise**0.5, lambda g, p: p + g.normal(size=len(p)) * drift**0.5, lambda p, x: -((x - p) ** 2) / (2 * noise))


def step(motion: Motion, particles: np.ndarray | None, key, event: int, value: float, n: int) -> tuple[np.ndarray | None, tuple]:
    """The particles after an event, and what is told of it. The generator's seed is of the key and the event, so a stream gives what a
    batch does, and a task that is run again what it gave before."""
    seed = np.frombuffer(hashlib.sha256(f"{key}|{event}".encode()).digest(), np.uint32)
    g = np.random.default_rng(seed)
    if particles is None:
        if np.isnan(value):
            return None, (None, None, None)
        particles = motion.start(g, n, value)
        return particles, (float(particles.mean()), float(particles.std()), float(n))
    particles = motion.move(g, particles)
    weights = np.full(n, 1.0 / n)
    if not np.isnan(value):
        logs = motion.log_likelihood(particles, value)
        weights = np.exp(logs - logs.max())
        weights /= weights.sum()
    mean = float(weights @ particles)
    told = (mean, float(np.sqrt(max(weights @ (particles - mean) ** 2, 0.0))), float(1 / (weights**2).sum()))
    # Systematic resampling: n evenly spaced marks from one random start.
    marks = (g.random() + np.arange(n)) / n
    return particles[np.minimum(np.searchsorted(np.cumsum(weights), marks), n - 1)], told


def particle_filter(events: DataFrame, motion: Motion, n: int = 1000, key: str = "event_type", value: str = "value", at: str = "ts", id_: str = "event_id") -> DataFrame:
    """(key, at, id, estimate, deviation, effective) after each event, in order of time and id: the particles' weighted mean and
    deviation, and how many of them count. The first known value starts them, unknown ones only let them move.

    A key's state is n numbers. A step needs the particles before, so a key's events go in order through one task, in a batch through
    Arrow batches, never as one group; in a stream they must come in order from micro-batch to micro-batch.
    """
    kind = dict(events.dtypes)[key]
    some = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value")).where("key is not null")

    def follow(k, particles, rows: pd.DataFrame) -> tuple[np.ndarray | None, pd.DataFrame]:
        made = []
        for event, x in zip(rows["id"], rows["value"].to_numpy(dtype=float, na_value=np.nan), strict=True):
            particles, told = step(motion, particles, k, event, x, n)
            made.append(told)
        out = rows[["at", "id"]].assign(**{c: pd.Series([m[i] for m in made], rows.index, dtype=object) for i, c in enumerate(("estimate", "deviation", "effective"))})
        out.insert(0, "key", k)
        return particles, out

    if events.isStreaming:

        def grouped(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(batches)).sort_values(["at", "id"])
            particles, out = follow(k[0], np.array(held.get[0]) if held.exists else None, rows)
            if particles is not None:
                held.update(([float(x) for x in particles],))
            yield out

        return some.groupBy("key").applyInPandasWithState(grouped, f"key {kind}, {OUT}", "particles array<double>", "append", "NoTimeout")

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, particles = None, None
        for b in batches:
            for k, rows in b.groupby("key", sort=False):
                particles, out = follow(k, particles if k == last else None, rows)
                last = k
                yield out

    return some.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(ordered, f"key {kind}, {OUT}")
