"""How a copy is carried out: strategy, access modes, and whether blocks are compared first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import similar_size

AUTO, THREADED, RANGE, RANGE_SINGLE, REFLINK = "auto", "threaded", "copy_file_range", "copy_file_range_single", "reflink"
#: What the plans are called.
LABELS = {
    "diff": "auto diff-overwrite", "cached": "auto cached-read direct-write", "direct": "auto direct threaded",
    "single": "auto copy_file_range single fallback", "forced": "forced diff-overwrite", "forced_single": "forced diff copy_file_range single fallback",
}


@dataclass(frozen=True)
class CopyPlan:
    strategy: str
    read_mode: str
    write_mode: str
    diff_overwrite: bool
    label: str


PLANS = {
    "diff": CopyPlan(THREADED, "page_cache", "direct", True, LABELS["diff"]),
    "cached": CopyPlan(THREADED, "page_cache", "direct", False, LABELS["cached"]),
    "direct": CopyPlan(THREADED, "direct", "direct", False, LABELS["direct"]),
    "single": CopyPlan(RANGE_SINGLE, "page_cache", "page_cache", False, LABELS["single"]),
    "forced": CopyPlan(THREADED, "page_cache", "direct", True, LABELS["forced"]),
    "forced_single": CopyPlan(RANGE_SINGLE, "page_cache", "page_cache", False, LABELS["forced_single"]),
}


def choose(source_cached: Column, target_cached: Column, source_len: Column, target_len: Column, direct_writes: Column, rewrite: Column) -> Column:
    """The key of ``PLANS`` that the heuristic takes; ``rewrite`` is ``auto``, ``diff`` or ``full``."""
    close = similar_size(source_len, target_len)
    both = source_cached & target_cached & close & (rewrite != "full")
    return (
        F.when(rewrite == "diff", F.when(direct_writes, "forced").otherwise("forced_single"))
        .when(both, F.when(direct_writes, "diff").otherwise("single")).when(source_cached & close, "cached").otherwise("direct")
    )


def label(plan: Column) -> Column:
    return F.coalesce(*[F.when(plan == k, v) for k, v in LABELS.items()])


def resolve(requested: str, rewrite: str, read_mode: str, write_mode: str, configured: str, state: tuple[bool, bool, int | None, int | None], direct_writes: bool) -> CopyPlan:
    """The plan of one copy on the driver; explicit wishes come before the configuration, that before the heuristic."""
    if rewrite == "diff":
        return PLANS["forced" if direct_writes else "forced_single"]
    if requested != AUTO:
        return CopyPlan(requested, read_mode, write_mode, False, requested.replace("_single", " single"))
    if (read_mode, write_mode) != ("auto", "auto"):
        return CopyPlan(THREADED, read_mode, write_mode, False, "explicit io-mode threaded")
    if configured == "page_cache":
        return CopyPlan(THREADED, "page_cache", "page_cache", False, "auto config page-cache threaded")
    if configured == "direct":
        return CopyPlan(THREADED, "direct", "direct", False, "auto config direct threaded")
    if configured == RANGE:
        return CopyPlan(RANGE, "page_cache", "page_cache", False, "auto config copy_file_range")
    source_cached, target_cached, source_len, target_len = state
    close = source_len is not None and target_len is not None and (target_len == 0 if source_len == 0 else target_len * 100 // source_len >= 70)
    if source_cached and target_cached and close and rewrite != "full":
        return PLANS["diff" if direct_writes else "single"]
    return PLANS["cached" if source_cached and close else "direct"]
