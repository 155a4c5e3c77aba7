"""Files are hashed without any task or value that holds one whole (F7)."""

from __future__ import annotations

import hashlib
import random
import shutil
from pathlib import Path

import pytest

from quillgrid.plans import catalogue
from quillgrid.sources import digests
from quillgrid.streaming import inbox

md5 = lambda b: hashlib.md5(b).hexdigest()


@pytest.fixture
def conf(spark):
    held = {}

    def put(key, value):
        held.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in held.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.mark.parametrize("update", [digests._plain_update, digests.updater()])
def test_states_are_handed_on(update):
    rng = random.Random(7)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 128, 1000):
        data, state, at = rng.randbytes(n), digests.START, 0
        while at < n:
            step = rng.randint(1, 80)
            state, at = update(state, data[at : at + step]), at + step
        assert digests.taken(state) == n
        assert digests.digest(state, update) == md5(data)


def test_files_of_many_windows(spark, tmp_path, conf):
    rng = random.Random(1)
    held = {
        "noise.bin": rng.randbytes(20_000), "breaks": b"\n" * 5_000, "none": bytes(9_000), "end.txt": b"ab\r\ncd\n" * 700, "open.txt": b"ab\rcd\n" * 700 + b"x",
        "mark.csv": b"\xef\xbb\xbf" + b"a,b\n" * 1_000, "mark open": b"\xef\xbb\xbfa", "mark": b"\xef\xbb\xbf", "marks": b"\xef\xbb\xbf" * 2 + b"\n", "ä b%20[1]{x}*.bin": b"\xff\xfe\n\n", "one": b"1", "packed.gz": b"not packed",
    }
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    conf("spark.sql.files.maxPartitionBytes", "1000")
    conf("spark.sql.files.openCostInBytes", "0")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length", "_metadata.file_path")
    assert {r["path"].rpartition("/")[2]: h for r, h in digests.md5_of_files(files, window=3_000)} == {k: md5(v) for k, v in held.items()}


def test_no_value_holds_a_file(spark, sf_dir, conf):
    """The query gives its rows although no file's content may be a value."""
    conf("spark.sql.sources.binaryFile.maxLength", "1000")
    want = {(md5(p.read_bytes()), p.stat().st_size) for p in Path(sf_dir).glob("*.parquet")}
    assert {(r["file_hash"], r["length"]) for r in catalogue.QUERIES["stream_inbox"](spark, sf_dir).collect()} == want


def test_contents_pass_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    run = lambda: inbox.take_in(spark, str(src), out, str(tmp_path / "state"), "*.txt", per_trigger=2)
    run()
    for name, text in (("a.txt", "1"), ("b.txt", "1"), ("c.txt", "2"), ("~$c.txt", "3"), ("d.bin", "5")):
        (src / name).write_text(text)
    run()
    shutil.copy(src / "a.txt", src / "again.txt")
    (src / "d.txt").write_text("4")
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["file_hash"] for r in rows) == sorted(md5(x) for x in (b"1", b"2", b"4"))
