"""Look-ups by prefix and by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import under_mount

#: File systems that are no disks, beginnings of mount points that are none, and file systems that are disks whatever their source.
PSEUDO = [
    "proc", "sysfs", "devtmpfs", "devpts", "tmpfs", "ramfs", "cgroup", "cgroup2", "pstore", "debugfs", "tracefs", "securityfs", "bpf", "mqueue", "hugetlbfs", "configfs", "fusectl",
    "autofs", "rpc_pipefs", "binfmt_misc", "efivarfs", "squashfs", "overlay", "nfs", "nfs4", "cifs", "smb3", "ceph", "glusterfs",
]
SYSTEM = ["/proc", "/sys", "/dev", "/run", "/snap", "/var/lib/snapd"]
ALWAYS = ["zfs", "btrfs"]


def longest_mount(paths: DataFrame, mounts: DataFrame, path: str = "path", mount: str = "mount_point") -> DataFrame:
    """Adds the longest mount point above each path, null without one.

    A path's own prefixes, one for each component, are looked up by equality,
    so the join never compares all paths with all mounts.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    tried = paths.select(F.col(path), F.posexplode(prefixes).alias("depth", "prefix")).distinct()
    found = tried.join(mounts.select(F.col(mount).alias("prefix")).distinct(), "prefix").groupBy(path).agg(F.max_by("prefix", "depth").alias(mount))
    return paths.join(found, path, "left")


def is_under(path: Column, mount: Column) -> Column:
    return under_mount(path, mount)


def disk_backed(mount_point: Column, fstype: Column, source: Column) -> Column:
    """Whether a mount is a disk: of no pseudo or network file system, and the root, or outside the system's places with a device or pool behind it."""
    outside = ~mount_point.rlike("^(" + "|".join(SYSTEM) + ")")
    backed = source.startswith("/dev/") | fstype.isin(ALWAYS)
    return F.coalesce(~fstype.isin(PSEUDO) & ((mount_point == "/") | (outside & backed)), F.lit(False))


def profile_match(devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """``device_id, profile_id``: the first profile (by ``ordinal``) whose given fields all match.

    ``fstype, dev_kind, md_level`` must be equal and ``dev_model_contains`` be
    part of ``dev_model``; a null field of a profile matches anything. The
    profile table is a short list kept by hand and is broadcast.
    """
    p, d = profiles.alias("p"), devices.alias("d")
    same = lambda c: F.col(f"p.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"d.{c}"))
    fits = same("fstype") & same("dev_kind") & same("md_level") & (F.col("p.dev_model_contains").isNull() | F.col("d.dev_model").contains(F.col("p.dev_model_contains")))
    pairs = d.join(F.broadcast(p), fits, "left")
    return pairs.groupBy(F.col("d.device_id").alias("device_id")).agg(F.min_by("p.id", "p.ordinal").alias("profile_id"))


def selected(names: Column, prefixes: list[str]) -> Column:
    """Whether a name starts with any of the prefixes; without prefixes all do."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | names.startswith(p)
    return out
