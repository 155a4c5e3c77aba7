"""MD5 of files of any size, of which no task reads more than a window.

MD5 takes a file's bytes in order, but all it keeps of them is a state of 92
bytes. So files are read in splits, and their bytes go to the shared folder in
windows; a round hashes one window of every file, a file a task, and hands the
states to the next round. A file of n windows takes n rounds.

Splits are read as lines of bytes, which every store that Spark reads can
give. What lines do not tell, a last line break and a byte order mark, follows
from the file's length.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillgrid.storage import discard, new_path

WINDOW = 128 << 20
PIECE = 64 << 10
#: Four words, number of bits, bytes of a block that is not full, and how many: as OpenSSL keeps it.
STATE = struct.Struct("<4IQ64sI")
START = STATE.pack(0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, b"", 0)
MARK = b"\xef\xbb\xbf"
#: Files that Spark unpacks as it reads lines.
PACKED = re.compile(r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$")
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]


def _plain_update(state: bytes, data: bytes) -> bytes:
    *words, bits, tail, n = STATE.unpack(state)
    bits, data, most = (bits + 8 * len(data)) % 2**64, tail[:n] + data, 0xFFFFFFFF
    whole = len(data) // 64 * 64
    for at in range(0, whole, 64):
        m, (a, b, c, d) = struct.unpack_from("<16I", data, at), words
        for i in range(64):
            if i < 16:
                f, g = (b & c) | (~b & d), i
            elif i < 32:
                f, g = (d & b) | (~d & c), 5 * i + 1
            elif i < 48:
                f, g = b ^ c ^ d, 3 * i + 5
            else:
                f, g = c ^ (b | (~d & most)), 7 * i
            f = (f + a + _SINES[i] + m[g % 16]) & most
            a, d, c, b = d, c, b, (b + (f << _TURNS[i] | f >> (32 - _TURNS[i]))) & most
        words = [(x + y) & most for x, y in zip(words, (a, b, c, d), strict=True)]
    return STATE.pack(*words, bits, data[whole:], len(data) - whole)


def _linked_update(f: Callable, state: bytes, data: bytes) -> bytes:
    held = ctypes.create_string_buffer(state, STATE.size)
    f(held, data, len(data))
    return held.raw


@cache
def updater() -> Callable[[bytes, bytes], bytes]:
    """Takes bytes into a state: OpenSSL's function, if Python is linked with it and it keeps this state, or a plain one."""
    try:
        import _hashlib

        f = ctypes.CDLL(_hashlib.__file__).MD5_Update
        f.argtypes, f.restype = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t), ctypes.c_int
    except (ImportError, OSError, AttributeError):
        return _plain_update
    linked, probe = partial(_linked_update, f), bytes(range(256))
    same = linked(linked(START, probe[:150]), probe[150:])[:24] == _plain_update(START, probe)[:24]
    return linked if same and digest(linked(START, probe), linked) == hashlib.md5(probe, usedforsecurity=False).hexdigest() else _plain_update


def taken(state: bytes) -> int:
    """Number of bytes that a state stands for."""
    return STATE.unpack(state)[4] // 8


def digest(state: bytes, update: Callable[[bytes, bytes], bytes] | None = None) -> str:
    """The MD5 of what a state has taken."""
    bits = STATE.unpack(state)[4]
    end = b"\x80" + bytes((55 - bits // 8) % 64) + struct.pack("<Q", bits)
    return (update or updater())(state, end)[:16].hex()


def _cut(ids: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of splits as pieces of bytes, numbered within their split."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seq, held = None, 0, b""
        for batch in batches:
            found = []
            file, start, lines = batch["file"].to_numpy(), batch["start"].to_numpy(), batch["line"].to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), len(lines)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (now := (ids[int(file[a])], int(start[a]))) != split:
                    if held:
                        found.append((*split, seq, held))
                    split, seq, held = now, 0, b""
                data = b"".join((held, b"\n".join(lines[a:b]), b"\n"))
                whole = len(data) // PIECE * PIECE
                for at in range(0, whole, PIECE):
                    found.append((*split, seq, data[at : at + PIECE]))
                    seq += 1
                held = data[whole:]
            yield _batch(found)
        if held:
            yield _batch([(*split, seq, held)])

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, start, seq, data = zip(*rows, strict=True) if rows else ((),) * 4
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((file, start, seq, [len(d) for d in data], data), kinds, strict=True)], ["file", "start", "seq", "size", "data"])


def _advance(states: dict[int, bytes], lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States after pieces that come in order, file by file; the break after a last line that has none is beyond the file's length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        update, file, state = updater(), None, b""
        out = lambda: pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([state], pa.binary())], ["file", "state"])
        for batch in batches:
            for f, data in zip(batch["file"].to_pylist(), batch["data"], strict=True):
                if f != file:
                    if file is not None:
                        yield out()
                    file, state = f, states[f]
                state = update(state, data.as_py()[: lengths[f] - taken(state)])
        if file is not None:
            yield out()

    return work


def md5_of_files(files: DataFrame, window: int = WINDOW) -> list[tuple[Row, str]]:
    """Every row of ``files`` (path, length, file_path as in ``_metadata``) with the MD5 of the file's content.

    The rows come to the driver, so give a batch of files at a time. Files
    packed by a name's ending that Spark knows are read whole (2 GB at most),
    as it would unpack them.
    """
    spark = files.sparkSession
    rows = sorted(files.withColumn("_id", F.xxhash64("file_path")).collect(), key=lambda r: (-r["length"], r["path"]))
    literal = lambda rs: [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in rs]
    done = {}
    if packed := [r for r in rows if PACKED.search(r["path"])]:
        got = spark.read.format("binaryFile").load(literal(packed)).select(F.xxhash64("_metadata.file_path"), F.md5("content"))
        done.update(got.collect())
    if plain := [r for r in rows if not PACKED.search(r["path"])]:
        found = _md5_of_lines(files, plain, literal(plain), window)
        done.update((r["_id"], h) for r, h in zip(plain, found, strict=True))
    return [(r, done[r["_id"]]) for r in rows]


def _md5_of_lines(files: DataFrame, rows: list[Row], paths: list[str], window: int) -> list[str]:
    spark, lengths = files.sparkSession, [r["length"] for r in rows]
    lines = spark.read.schema("value string").option("lineSep", "\n").text(paths)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    kind, where = "file int, start long, seq int, size int, data binary", new_path(spark)
    pieces = lines.mapInArrow(_cut({r["_id"]: i for i, r in enumerate(rows)}), kind).withColumn("round", F.expr(f"cast(start div {window} as int)"))
    pieces.write.partitionBy("round").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(where)
    rounds: dict[int, list[int]] = {}
    sizes = [0] * len(rows)
    for r in spark.read.schema(f"{kind}, round int").parquet(where).groupBy("round", "file").agg(F.sum("size").alias("size")).collect():
        rounds.setdefault(r["round"], []).append(r["file"])
        sizes[r["file"]] += r["size"]
    for r, n in zip(rows, sizes, strict=True):
        if n - r["length"] not in (0, 1, -len(MARK), 1 - len(MARK)):
            raise RuntimeError(f"{r['path']} changed while it was read: {n} bytes of {r['length']}")
    states = {i: updater()(START, MARK) if n < m else START for i, (n, m) in enumerate(zip(sizes, lengths, strict=True))}
    for at in sorted(rounds):  # the longest files come first, so those of a round are the first ones
        part = spark.read.schema(kind).parquet(f"{where}/round={at}").select("file", "start", "seq", "data")
        dealt = part.repartitionById(max(rounds[at]) + 1, F.col("file")).sortWithinPartitions("file", "start", "seq")
        states.update(dealt.mapInArrow(_advance(states, lengths), "file int, state binary").collect())
    discard(spark, where)
    if wrong := [r["path"] for i, r in enumerate(rows) if taken(states[i]) != r["length"]]:
        raise RuntimeError(f"{wrong[0]} was not read whole")
    return [digest(bytes(states[i])) for i in range(len(rows))]
