"""Command line: ``python -m blockloom VERB ...``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

from . import api
from .functions.binary import parse_size_value
from .operators import election, recover
from .plans import config as settings
from .plans import copy_plan, tuner

VERBS = ["read", "grep", "write", "copy", "copy-via-memory", "diff", "dual-read-bench", "hash", "verify", "recover", "bench-diff", "bench-memcpy", "bench-mmap-write", "bench-write", "tune"]
STRATEGIES = ("copy_file_range", "copy_file_range_single", "threaded_copy", "reflink")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("blockloom", description="Integrity and byte analytics of large files on Spark")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("args", nargs="*", help="pattern and file, source and target, or target and copies")
    for name in ("no-direct", "direct", "no-direct-write", "direct-write", "verify", "verify-diff", "hash", "hash-only", "sha256", "no-lock", "keep-target-size", "diff", "full", "fast", "in-place-all", "quiet", "save", "to-memory", "via-memory", *(s.replace("_", "-") for s in STRATEGIES)):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("-n", "--iterations", type=int)
    p.add_argument("--block-size")
    p.add_argument("--create")
    p.add_argument("--hash-base")
    p.add_argument("--config")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--master", default=os.environ.get("BLOCKLOOM_MASTER"))
    return p


def _modes(a: argparse.Namespace) -> tuple[str, str]:
    of = lambda direct, cached: "direct" if direct else "page_cache" if cached else "auto"
    return of(a.direct, a.no_direct), of(a.direct_write, a.no_direct_write)


def faults(a: argparse.Namespace) -> list[str]:
    """What contradicts itself in a command; the first is shown."""
    copying = a.verb in ("copy", "copy-via-memory")
    memory = a.via_memory or a.verb == "copy-via-memory"
    chosen = [s for s in STRATEGIES if getattr(a, s)]
    ranged = a.copy_file_range or a.copy_file_range_single
    checking = a.verify or a.verify_diff
    direct = "direct" in _modes(a)
    many = (a.iterations or 1) > 1
    rules: list[tuple[bool, str]] = [
        (not a.args and not a.verb.startswith("bench-"), "a file is missing"),
        (a.to_memory and a.verb != "read", "--to-memory is for read"),
        (a.via_memory and not copying, "--via-memory is for copy"),
        (bool(chosen) and not copying, "copy strategies are for copy"),
        (len(chosen) > 1, "only one copy strategy can be chosen"),
        (checking and not copying, "--verify and --verify-diff are for copy"),
        (a.verify and a.verify_diff, "--verify and --verify-diff exclude each other"),
        (a.no_lock and not copying, "--no-lock is for copy"),
        (a.keep_target_size and not copying, "--keep-target-size is for copy"),
        ((a.diff or a.full) and not copying, "--diff and --full are for copy"),
        (a.diff and a.full, "--diff and --full exclude each other"),
        (a.hash and not (copying and a.verify), "--hash is for copy --verify"),
        (memory and a.save, "copying via memory does not tune"),
        (a.keep_target_size and (memory or checking), "--keep-target-size is for plain copies"),
        (a.diff and (memory or checking), "--diff is for plain copies"),
        (a.diff and (ranged or a.reflink), "--diff excludes kernel strategies"),
        (bool(chosen) and memory, "copy strategies exclude copying via memory"),
        (checking and a.save, "verified copies do not tune"),
        ((a.copy_file_range_single or a.diff or a.reflink) and a.save, "this strategy does not tune"),
        ((checking or a.reflink or a.copy_file_range_single) and many, "this copy needs -n 1"),
        (a.verify_diff and a.hash_base is not None, "--verify-diff has no use for --hash-base"),
        ((ranged or a.reflink) and direct, "kernel strategies exclude direct access"),
        (a.verb == "recover" and len(a.args) < 2, "recover needs at least one copy"),
        (a.create is not None and a.verb != "write", "--create is for write"),
        (a.create is not None and parse_size_value(a.create) is None, "--create needs a size"),
        (a.block_size is not None and not parse_size_value(a.block_size), "--block-size needs a size"),
        (a.fast and a.in_place_all, "--fast and --in-place-all exclude each other"),
        ((a.fast or a.in_place_all) and a.verb != "recover", "--fast and --in-place-all are for recover"),
        ((a.sha256 or a.hash_only) and a.verb != "hash" and not (a.sha256 and a.verify), "--sha256 and --hash-only are for hash"),
        (a.direct and a.no_direct or a.direct_write and a.no_direct_write, "direct and cached access exclude each other"),
        (a.iterations is not None and a.iterations < 1, "-n is positive"),
        (a.save and _modes(a) == ("auto", "auto") and not a.copy_file_range, "--save needs a forced access mode"),
        (a.verb in ("grep", "copy", "copy-via-memory", "diff", "dual-read-bench") and len(a.args) != 2, f"{a.verb} takes two arguments"),
    ]
    return [text for wrong, text in rules if wrong]


def _rate(name: str, n: int, seconds: float) -> str:
    return f"{name} {n} bytes in {seconds:.4f} s, {n / max(seconds, 1e-9) / 1e9:.1f} GB/s"


def _outcome(issue: dict) -> str:
    if issue["basis"]:
        return election.RECOVERED % election.BASIS[issue["basis"]]
    return election.FAILED % election.FAILURE[issue["failure"]]


def _bench(verb: str, size: int = 1 << 28) -> int:
    """In-memory and write microbenchmarks of one process."""
    import mmap
    import tempfile

    data = bytearray(os.urandom(1 << 20) * (size >> 20))
    if verb == "bench-memcpy":
        bytes(data)
        return 2 * size
    if verb == "bench-diff":
        assert data == bytearray(data)
        return 2 * size
    with tempfile.TemporaryFile() as f:
        if verb == "bench-write":
            f.write(data)
        else:
            f.truncate(size)
            with mmap.mmap(f.fileno(), size) as m:
                m[:] = bytes(data)
    return size


def _run(a: argparse.Namespace, spark, block_size: int, say: Callable[[str], None]) -> tuple[int, int]:
    """Runs a verb; returns the exit code and the bytes it went over."""
    kind = "sha256" if a.sha256 else "xxh3"
    unit = max(4096, block_size // 4096 * 4096)
    first = a.args[0] if a.args else ""
    if a.verb.startswith("bench-"):
        return 0, _bench(a.verb)
    if a.verb == "read":
        file = api.open_file(spark, first, block_size)
        return 0, len(api.read_file(first)) if a.to_memory else file.byte_count()
    if a.verb == "grep":
        pattern, path = a.args
        file = api.open_file(spark, path, block_size)
        if pattern:
            for row in file.grep(pattern).toLocalIterator():
                print(f"{row['offset']}:{pattern}")
        return 0, len(file)
    if a.verb == "write":
        from .operators.writing import fill

        total = parse_size_value(a.create) if a.create else os.path.getsize(first)
        api.write_blocks(fill(spark, block_size, total, a.seed), first, total)
        return 0, total
    if a.verb in ("copy", "copy-via-memory"):
        return _copy(a, spark, block_size, unit, kind, say)
    if a.verb in ("diff", "dual-read-bench"):
        sizes = [os.path.getsize(p) for p in a.args]
        if a.verb == "dual-read-bench":
            return 0, sum(api.open_file(spark, p, block_size).byte_count() for p in a.args)
        if sizes[0] != sizes[1]:
            print(f"sizes differ: {sizes[0]} and {sizes[1]}")
            return 1, 0
        at = api.diff(spark, *a.args, block_size)
        if at is not None:
            print(f"files differ at offset {at}")
        return int(at is not None), sum(sizes)
    if a.verb == "hash":
        made = api.hash_file(spark, first, kind, unit, a.hash_base, save=not a.hash_only and (a.iterations or 1) == 1)
        print(made["hash_of_hashes"])
        return 0, made["bytes_hashed"]
    if a.verb == "verify":
        report = api.verify_file(spark, first, a.hash_base, unit)
        print(f"{report.ok_blocks} of {report.total_blocks} blocks ok, {report.loaded_manifests} sidecars")
        for bad in report.bad_blocks:
            print(f"block {bad['block_index']}: {_outcome(bad)}")
        return int(bool(report.bad_blocks)), report.bytes_hashed
    mode = recover.FAST if a.fast else recover.IN_PLACE_ALL if a.in_place_all else recover.STANDARD
    done = api.recover_file(spark, first, a.args[1:], a.hash_base, mode, unit)
    print(f"{done.repaired_blocks} blocks repaired in {done.repaired_files} files, {done.sidecars_refreshed} sidecars refreshed, {len(done.failed_blocks)} blocks failed")
    for bad in done.failed_blocks:
        print(f"{bad['path']} block {bad['block_index']}: {_outcome(bad)}")
    return int(bool(done.failed_blocks)), done.bytes_hashed


def _copy(a: argparse.Namespace, spark, block_size: int, unit: int, kind: str, say: Callable[[str], None]) -> tuple[int, int]:
    source, target = a.args
    if a.verify:
        report = api.copy_verified(spark, source, target, kind, unit, not a.no_lock, a.hash)
        say(f"{report.verified_blocks} blocks verified, {report.repaired_blocks} repaired")
        return 0, report.bytes_copied
    if a.via_memory or a.verb == "copy-via-memory":
        return 0, api.copy_file_via_memory(spark, source, target, not a.no_lock, block_size)
    chosen = next((s for s in STRATEGIES if getattr(a, s)), copy_plan.AUTO).replace("threaded_copy", copy_plan.THREADED)
    length = lambda p: os.path.getsize(p) if os.path.isfile(p) else None
    conf = settings.load(a.config) if a.config else settings.Config()
    plan = copy_plan.resolve(chosen, "diff" if a.diff else "full" if a.full else "auto", *_modes(a), conf.copy_auto_mode(target), (False, False, length(source), length(target)), True)
    say(plan.label)
    if plan.diff_overwrite:
        n = api.copy_changed(spark, source, target, block_size)["bytes_copied"]
    else:
        n = api.copy_file(spark, source, target, not a.no_lock, a.keep_target_size, block_size)
    if a.verify_diff and (at := api.diff(spark, source, target, block_size)) is not None:
        print(f"copy differs at offset {at}")
        return 1, n
    return 0, n


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_intermixed_args(argv)
    if wrong := faults(a):
        print(wrong[0])
        return 1
    say = (lambda text: None) if a.quiet else (lambda text: print(text, file=sys.stderr))
    conf = settings.load(a.config) if a.config else settings.Config()
    mode = {"copy-via-memory": "copy", "recover": "verify", "tune": "read"}.get(a.verb, a.verb if a.verb.replace("-", "_") in settings.MODES else "read")
    path = a.args[-1] if a.args else None
    block_size = parse_size_value(a.block_size) if a.block_size else conf.logical_block_size(mode, path)
    spark = None
    if not a.verb.startswith("bench-"):
        from .session import session

        spark = session(a.master or "local[*]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
        spark.sparkContext.setLogLevel("ERROR")
    steps, code = a.iterations or 1, 0
    try:
        if a.verb == "tune":
            a.verb = "read"
            found = tuner.climb([max(1, block_size // (256 << 10))], [256 << 10], [True], a.iterations or 20, lambda p: _run(a, spark, p[0], say)[1], a.seed)
            print(f"block size {found.params[0]}: {_rate('read', found.units, found.seconds)}")
            if a.save:
                for direct in (True, False):
                    old = conf.params("read", direct)
                    conf.update("read", direct, settings.Params(old.num_threads, found.params[0], old.qd))
                conf.save()
            return 0
        for _ in range(steps):
            began = time.perf_counter()
            code, n = _run(a, spark, block_size, say)
            say(_rate(a.verb, n, time.perf_counter() - began))
        return code
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except (OSError, ValueError, RuntimeError) as e:
        print(f"{a.verb}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
