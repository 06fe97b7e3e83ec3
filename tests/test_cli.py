"""The command line, configuration and tuner."""

import json
import os
import random

import pytest

from blockloom import cli
from blockloom.plans import config, copy_plan, devices, tuner


@pytest.fixture
def run(spark, capsys):
    def call(*args: str) -> tuple[int, str]:
        code = cli.main([*args])
        return code, capsys.readouterr().out

    return call


def test_verbs(run, tmp_path):
    path, other = str(tmp_path / "f"), str(tmp_path / "g")
    assert run("write", "--create", "20000", path)[0] == 0 and os.path.getsize(path) == 20_000
    assert run("read", path, "--block-size", "4k")[0] == 0
    assert run("copy", path, other)[0] == 0 and run("diff", path, other)[0] == 0
    with open(other, "r+b") as f:
        f.seek(5000)
        f.write(b"\xff\x00\xff\x00")
    code, out = run("diff", path, other)
    assert code == 1 and "offset 500" in out
    assert run("hash", "--sha256", "--block-size", "4k", path)[0] == 0 and run("verify", path)[0] == 0
    with open(path, "r+b") as f:
        f.seek(9000)
        f.write(b"\x00\xff\x00\xff\x01")
    assert run("verify", path)[0] == 1
    assert run("copy", "--verify", path, other)[0] == 0
    assert run("bench-memcpy")[0] == 0
    assert run("grep", "no such text", path)[0] == 0
    assert run("read", str(tmp_path / "missing"))[0] == 1


@pytest.mark.parametrize("args", [
    ["copy", "--verify", "--verify-diff", "a", "b"], ["copy", "--diff", "--full", "a", "b"], ["read", "--via-memory", "a"], ["copy", "--hash", "a", "b"],
    ["copy", "--copy-file-range", "--reflink", "a", "b"], ["copy", "--keep-target-size", "--verify", "a", "b"], ["recover", "a"], ["read", "--create", "1k", "a"],
    ["write", "--create", "1q", "a"], ["recover", "--fast", "--in-place-all", "a", "b"], ["copy", "--verify", "-n", "2", "a", "b"], ["copy", "--reflink", "--direct", "a", "b"],
    ["read", "--direct", "--no-direct", "a"], ["read"], ["diff", "a"], ["hash", "--no-lock", "a"],
])
def test_contradictions(args):
    assert cli.faults(cli.parser().parse_intermixed_args(args))


def test_config(tmp_path, monkeypatch):
    path = str(tmp_path / "c.json")
    made = config.load(path)
    assert os.path.exists(path) and made.params("read", True) == config.Params(16, 3 << 20, 2)
    assert made.logical_block_size("copy") == 1 << 20
    made.update("read", True, config.Params(2, 4096, 1), mount="/")
    made.update_copy_auto("direct", mount="/")
    made.save()
    again = config.load(path)
    assert again.params("read", True, "/x").num_threads == 2 and again.params("read", True).num_threads == 16 and again.copy_auto_mode("/x") == "direct"
    flat = again.document()["defaults"]
    flat.pop("hash")
    (tmp_path / "old.json").write_text(json.dumps(flat))
    old = config.load(str(tmp_path / "old.json"))
    assert old.legacy and old.params("hash", True) == config.Params(16, 1 << 20, 2)
    (tmp_path / "bad.json").write_text("{")
    with pytest.warns(UserWarning):
        config.load(str(tmp_path / "bad.json"))
    assert (tmp_path / "bad.json").read_text() == "{"
    monkeypatch.setenv("BLOCKLOOM_CONFIG", path)
    assert config.default_path() == path
    assert config.mount_of("/ab/c", ["/", "/a", "/ab"]) == "/ab"
    assert all("mount_point" in m for m in config.read_mounts())


def test_tuner_finds_the_fast_place():
    now, noise = [0.0], random.Random(4)

    def run(p):
        now[0] += (5 + abs(p[0] - 12)) * noise.uniform(0.98, 1.02)
        return 1

    found = tuner.climb([3], [1], [True], 3000, run, seed=1, clock=lambda: now[0])
    assert abs(found.params[0] - 12) <= 1
    assert tuner.climb([3], [4], [True], 1, run, clock=lambda: now[0]).params == [12]
    assert tuner.active("verify", "direct") == [False, False, False, True, False, True, False, False, False]
    assert tuner.active("copy", strategy="reflink") == [False] * 9


def test_copy_plans():
    state = (True, True, 100, 70)
    assert copy_plan.resolve("auto", "auto", "auto", "auto", "heuristic", state, True).diff_overwrite
    assert copy_plan.resolve("auto", "full", "auto", "auto", "heuristic", state, True).label == copy_plan.LABELS["cached"]
    assert copy_plan.resolve("auto", "auto", "auto", "auto", "heuristic", (True, True, 100, 69), True).label == copy_plan.LABELS["direct"]
    assert copy_plan.resolve("reflink", "auto", "auto", "auto", "direct", state, True).strategy == "reflink"
    assert copy_plan.resolve("auto", "auto", "direct", "auto", "heuristic", state, True).label == "explicit io-mode threaded"


STATUS = """  pool: tank
 state: ONLINE
config:

\tNAME          STATE     READ WRITE CKSUM
\ttank          ONLINE       0     0     0
\t  mirror-0    ONLINE       0     0     0
\t    nvme0n1   ONLINE       0     0     0
\t    nvme1n1   FAULTED      0     0     0  was /dev/nvme1n1p1
\t  sda         ONLINE       0     0     0
\tlogs
\t  sdb         ONLINE       0     0     0

errors: No known data errors
"""


def test_devices(spark, tmp_path):
    found = [(d["name"], d["state"], d["was"], d["groups"]) for d in devices.pool_devices(STATUS)]
    assert found == [("nvme0n1", "ONLINE", None, ["mirror-0"]), ("nvme1n1", "FAULTED", "/dev/nvme1n1p1", ["mirror-0"]), ("sda", "ONLINE", None, []), ("sdb", "ONLINE", None, ["logs"])]
    assert devices.pool_devices("") == [] and devices.pool_properties("sync\tstandard\nx\n\t1\n") == {"sync": "standard"}
    (tmp_path / "md0" / "md").mkdir(parents=True)
    (tmp_path / "md0" / "md" / "level").write_text("raid0\n")
    (tmp_path / "md0" / "slaves" / "nvme0n1").mkdir(parents=True)
    made = devices.describe({"mount_point": "/d", "fstype": "ext4", "source": "/dev/md0"}, str(tmp_path))
    assert (made["dev_kind"], made["md_level"], made["members"]) == ("md", "raid0", ["nvme0n1"])
    assert devices.devices(spark).count() > 0 and devices.command("no-such-tool") is None
