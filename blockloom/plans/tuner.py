"""A search over integer parameters by timed trials."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

#: Nine parameters: threads, block size and queue depth of cached, direct and kernel-range access.
CACHED, DIRECT, RANGE = (0, 1, 2), (3, 4, 5), (6, 7, 8)
#: How much slower the best time counts after each step, so that chance does not rule for ever.
DECAY = 1.0005
#: The parameters behind each kind of access, and which of them each verb may move.
GROUPS = {"page_cache": CACHED, "direct": DIRECT, "auto": CACHED + DIRECT}
READERS = {"read", "grep", "hash", "diff", "dual-read-bench"}
SIDECAR_READERS = {"verify", "recover"}  # stored manifests fix their block sizes
WHOLE_COPIES = {"copy_file_range_single": (), "reflink": (), "copy_file_range": RANGE, "auto": CACHED + DIRECT + RANGE}


@dataclass
class Tuned:
    params: list[int]
    seconds: float
    units: int


def _movable(verb: str, read: str, write: str, via_memory: bool, strategy: str) -> Iterable[int]:
    if verb in READERS:
        return GROUPS[read]
    if verb in SIDECAR_READERS:
        return [i for i in GROUPS[read] if i % 3 != 1]
    if verb == "write":
        return GROUPS["page_cache" if write == "page_cache" else "direct"]
    if verb != "copy":
        return CACHED + DIRECT + RANGE
    if via_memory:
        return ()
    if strategy in WHOLE_COPIES:
        return WHOLE_COPIES[strategy]
    sides = {read, write}
    return (CACHED if "page_cache" in sides else ()) + (() if sides == {"page_cache"} else DIRECT)


def active(mode: str, read: str = "auto", write: str = "auto", via_memory: bool = False, strategy: str = "auto") -> list[bool]:
    """Which parameters may move."""
    on = set(_movable(mode, read, write, via_memory, strategy))
    return [i in on for i in range(9)]


def reach(draw: float, idle: int) -> int:
    """How far a parameter may jump: farther the longer nothing was found, mostly little."""
    return max(0, int(draw * draw * math.log2(idle / 4) + 1))


def neighbour(at: Sequence[int], best: Sequence[int], movable: Sequence[bool], idle: int, rng: random.Random) -> list[int]:
    """A proposal: each movable parameter goes up, goes down to 1 at least, or goes back to the best."""
    def moved(value: int, home: int) -> int:
        far = reach(rng.random(), idle)
        return rng.choice((value + far, max(1, value - far), home))

    return [moved(v, b) if free else v for v, b, free in zip(at, best, movable, strict=True)]


def trials(proposals: Iterable[Sequence[int]], scale: Sequence[int], run: Callable[[list[int]], int], clock: Callable[[], float]) -> Iterator[tuple[Sequence[int], Tuned]]:
    """Runs each proposal on the scaled parameters and times it."""
    for at in proposals:
        params = [n * s for n, s in zip(at, scale, strict=True)]
        began = clock()
        units = run(params)
        yield at, Tuned(params, clock() - began, units)


class Walk:
    """Proposals around the best place so far; told of each outcome, it decides whether to move there.

    What must be beaten is the time of the last move, made slower by ``DECAY`` at every step.
    """

    def __init__(self, start: Sequence[int], movable: Sequence[bool], rng: random.Random):
        self.at, self.best, self.movable, self.rng = list(start), list(start), movable, rng
        self.idle, self.limit = 0, math.inf

    def proposals(self, steps: int) -> Iterator[list[int]]:
        for _ in range(steps):
            self.idle, self.limit = self.idle + 1, self.limit * DECAY
            if steps > 1:
                self.at = neighbour(self.at, self.best, self.movable, self.idle, self.rng)
            yield self.at

    def told(self, at: Sequence[int], seconds: float) -> None:
        if seconds < self.limit:
            self.best, self.limit, self.idle = list(at), seconds, 0


def climb(start: Sequence[int], scale: Sequence[int], movable: Sequence[bool], steps: int, run: Callable[[list[int]], int], seed: int | None = None, clock: Callable[[], float] = time.perf_counter) -> Tuned:
    """The fastest trial of a walk from ``start``; one step only runs the given parameters."""
    walk = Walk(start, movable, random.Random(seed))
    fastest = Tuned([n * s for n, s in zip(start, scale, strict=True)], math.inf, 0)
    for at, trial in trials(walk.proposals(steps), scale, run, clock):
        walk.told(at, trial.seconds)
        fastest = min(fastest, trial, key=lambda t: t.seconds)
    return fastest
