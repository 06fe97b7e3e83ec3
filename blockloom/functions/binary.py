"""Byte, size and path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiples that a size suffix stands for.
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_SIZE = r"^\s*([0-9]+)\s*(?:([kKmMgGtT])(?:[iI]?[bB])?|[bB])?\s*$"


def parse_size(text: Column) -> Column:
    """Bytes of ``64k``, ``4GiB`` and the like; null for other text or beyond 64 bits."""
    digits = F.regexp_extract(text, _SIZE, 1)
    unit = F.lower(F.regexp_extract(text, _SIZE, 2))
    factor = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNITS.items()])
    number = F.when(digits != "", F.try_to_number(F.lpad(digits, 30, "0"), F.lit("9" * 30)))
    product = number.cast("decimal(38,0)") * factor.cast("decimal(14,0)")
    return F.when(product <= (1 << 63) - 1, product.cast("bigint"))


def parse_size_value(text: str) -> int | None:
    """The same on the driver."""
    m = re.match(_SIZE, text)
    if not m:
        return None
    size = int(m[1]) * UNITS[(m[2] or "").lower()]
    return size if size < 1 << 64 else None


def format_bytes(n: Column) -> Column:
    """The largest binary unit that the size reaches, with two decimals."""
    shown = [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")]
    out = F.format_string("%d B", n)
    for size, name in reversed(shown):
        out = F.when(n >= size, F.format_string(f"%.2f {name}", n.cast("double") / size)).otherwise(out)
    return out


def align_down(n: Column, unit: int) -> Column:
    return n - F.pmod(n, F.lit(unit))


def block_count(size: Column, block_size: int) -> Column:
    """Blocks of a file; none of an empty one."""
    return F.ceil(size / F.lit(block_size)).cast("bigint") if block_size & (block_size - 1) == 0 and block_size < 1 << 20 else F.floor((size + (block_size - 1)) / F.lit(block_size)).cast("bigint")


def expected_read_len(size: Column, offset: Column, block_size: int) -> Column:
    """Bytes of the block at an offset: short at the end, none behind it."""
    return F.greatest(F.least(size - offset, F.lit(block_size).cast("bigint")), F.lit(0).cast("bigint"))


def similar_size(source: Column, target: Column) -> Column:
    """Whether a target has at least 70 % of the source; unknown sizes never have, and empty matches empty."""
    close = F.when(source == 0, target == 0).otherwise(F.floor(target * 100 / source) >= 70)
    return F.coalesce(close, F.lit(False))


def direct_io_allowed(offset: Column, length: Column, size: Column, unit: int = 4096) -> Column:
    """Whether a range is aligned and inside the file, so that it could bypass the page cache."""
    return (offset % unit == 0) & (length % unit == 0) & (offset + length <= size)


def under_mount(path: Column, mount: Column) -> Column:
    """Whether a mount point is a prefix of the path that ends at a component."""
    return (mount == "/") & path.startswith("/") | (path == mount) | path.startswith(F.concat(mount, F.lit("/")))


def first_gbps(line: Column) -> Column:
    """The first number before `` GB/s``; null without one."""
    found = F.regexp_extract(line, r"([0-9]+(?:\.[0-9]+)?) GB/s", 1)
    return F.when(found != "", found.cast("double"))


def record_counts(n: Column, block_size: int) -> Column:
    """Full and partial records of so many bytes."""
    whole = F.floor(n / block_size).cast("bigint")
    return F.struct(whole.alias("full"), F.when(n % block_size != 0, 1).otherwise(0).cast("bigint").alias("partial"))


def benchmark_size(free: int, capacity: int, files: int, writes: int, most: int, budget: float = 0.001, unit: int = 4096) -> int:
    """How large a benchmark's files may be, in whole units and one at least.

    At most 60 % of the free space, shared by the files, and so much that all
    writes stay within a share of the capacity.
    """
    size = min(most, int(free * 0.6) // max(1, files), int(capacity * budget) // max(1, writes))
    return max(unit, size // unit * unit)


def literal(pattern: bytes) -> str:
    """A regular expression for the bytes as they are, for text in which each character is one byte."""
    return "".join(f"\\x{b:02x}" for b in pattern)


def one_char_per_byte(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")
