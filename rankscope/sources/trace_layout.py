"""Byte layout of trace files and the small readers that run inside tasks."""

from __future__ import annotations

import gzip
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyarrow import fs

# Markers, labels and packed sizes of the file format.
MAGIC = b"MPICv002"
VERSION = 2
SMALL_LABEL = b"P2P Small Type Messages"
LARGE_LABEL = b"P2P Large Type Messages"
DATE_BYTES, PROGRAM_BYTES, HOST_BYTES, LABEL_BYTES = 64, 1024, 1024, 24

PROCESS = np.dtype([("rank", "<i4"), ("pid", "<i4"), ("core", "<i4"), ("chip", "<i4"),
                    ("hostname", f"V{HOST_BYTES}")])
ANCHOR = np.dtype([("rank", "<i4"), ("pad", "V4"), ("mpi_time_zero", "<f8"),
                   ("unix_time_zero_ns", "<i8")])
SMALL = np.dtype([(n, "<f8" if n == "local_time" else "<i4") for n in (
    "local_time", "event_id", "call_code", "comm", "tag", "sender", "receiver", "cnt", "bytes")])
LARGE = np.dtype([(n, "<f8" if n == "local_time" else "<i4") for n in (
    "local_time", "event_id", "call_code", "comm", "sender1", "receiver1", "cnt1", "bytes1", "tag1",
    "sender2", "receiver2", "cnt2", "bytes2", "tag2")] + [("pad", "V4")])
RECORDS = {"small": SMALL, "large": LARGE}


class TraceError(ValueError):
    """A trace file that does not follow the format."""


def text(raw: bytes) -> str:
    return bytes(raw).split(b"\0", 1)[0].decode("utf-8", errors="ignore")


def list_files(path: str) -> list[tuple[str, str, int]]:
    """(run id, path, size) of the trace files at a path on any file system Arrow knows."""
    where, root = locate(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.base_name, path, info.size)]
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    files = [i for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    prefix = path.rstrip("/")
    names = [i.path[len(root.rstrip("/")) + 1:] for i in files]
    return sorted((n, f"{prefix}/{n}", i.size) for n, i in zip(names, files))


def locate(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


GZIP_MAGIC = b"\x1f\x8b"
MEMBER_START = GZIP_MAGIC + b"\x08"


@contextmanager
def open_trace(path: str, members: list[tuple[int, int]] | None = None):
    """Seekable file of uncompressed trace bytes, with the flag that it was compressed.

    Of a compressed file with known ``members``, pairs of a member's place in the file and of its bytes in the trace, only those
    are unpacked that a read touches.
    """
    where, name = locate(path)
    with where.open_input_file(name) as raw:
        packed = name.endswith(".gz") or raw.read(2) == GZIP_MAGIC
        raw.seek(0)
        if packed and members:
            yield MemberFile(raw, members), True
        elif packed:
            with gzip.GzipFile(fileobj=raw) as plain:
                yield plain, True
        else:
            yield raw, False


class MemberFile:
    """Plain bytes of a gzip file from the first known member on; a seek starts unpacking at the member it falls into."""

    def __init__(self, raw, members: list[tuple[int, int]]):
        self.raw, self.members = raw, members
        self.starts = [plain for _, plain in members]
        self.at, self.base, self.plain = self.starts[0], None, None

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence != 0:
            raise ValueError("a packed file is only searched from its start")
        self.at = offset
        return offset

    def tell(self) -> int:
        return self.at

    def read(self, size: int) -> bytes:
        member = max(bisect_right(self.starts, self.at) - 1, 0)
        base = self.starts[member]
        # Go on where the last read ended, unless a later member begins before the place or the place lies behind.
        if self.plain is None or self.base + self.plain.tell() > self.at or self.base + self.plain.tell() < base:
            self.raw.seek(self.members[member][0])
            self.plain, self.base = gzip.GzipFile(fileobj=self.raw), base
        self.plain.seek(self.at - self.base)
        data = self.plain.read(size)
        self.at += len(data)
        return data


def find_members(raw, low: int, high: int, size: int) -> Iterator[dict]:
    """Members of a gzip file that start in ``[low, high)``, each unpacked to its end and checked: place, end and plain size.

    A start may lie inside another member's bytes by chance; ``choose_members`` keeps those that follow one another.
    """
    step, at = 1 << 20, low
    while at < high:
        raw.seek(at)
        block = raw.read(min(step, high - at) + len(MEMBER_START) - 1)
        hit = block.find(MEMBER_START)
        if hit < 0 or at + hit >= high:
            at += step
            continue
        found = _unpacked(raw, at + hit)
        if found is None:
            at += hit + 1
        else:
            stop, plain = found
            yield {"start": at + hit, "stop": stop, "plain_size": plain}
            at = stop


def _unpacked(raw, start: int, step: int = 1 << 20) -> tuple[int, int] | None:
    """End and plain size of the gzip member at a place, null if there is none."""
    raw.seek(start)
    unpack, plain, taken = zlib.decompressobj(31), 0, 0
    try:
        while not unpack.eof:
            data = unpack.unconsumed_tail or raw.read(step)
            if not data:
                return None
            taken += len(data) if not unpack.unconsumed_tail else 0
            plain += len(unpack.decompress(data, 1 << 22))
    except zlib.error:
        return None
    return start + taken - len(unpack.unused_data), plain


class MemberChain:
    """Members of one file in file order: each must begin where the one before it ends."""

    def __init__(self):
        self.position, self.plain = 0, 0

    def take(self, c: dict) -> dict | None:
        if c["start"] != self.position:
            return None
        kept = {**c, "plain_start": self.plain}
        self.position, self.plain = c["stop"], self.plain + c["plain_size"]
        return kept


def exact(f, size: int, what: str) -> bytes:
    data = f.read(size)
    if len(data) < size:
        raise TraceError(f"file ends inside {what}: need {size} bytes, {len(data)} remain")
    return data


def read_header(f) -> dict:
    """Run metadata and the offsets of the tables that follow."""
    f.seek(0)
    start = f.read(8)
    v2 = start == MAGIC
    if v2:
        version, ranks = struct.unpack("<Ii", exact(f, 8, "version"))
        if version != VERSION:
            raise TraceError(f"unsupported format version {version}")
    else:
        f.seek(0)
        version, ranks = 1, struct.unpack("<i", exact(f, 4, "world size"))[0]
    if ranks < 0:
        raise TraceError(f"invalid world size {ranks}")
    date = text(exact(f, DATE_BYTES, "date"))
    program = text(exact(f, PROGRAM_BYTES, "program"))
    processes = (16 if v2 else 4) + DATE_BYTES + PROGRAM_BYTES
    anchors = processes + ranks * PROCESS.itemsize
    return {"total_ranks": ranks, "date": date, "program": program or "unknown",
            "system_name": "Unknown Cluster",
            "file_format": MAGIC.decode() if v2 else "legacy-v1", "file_format_version": version,
            "time_registration": "per-rank-unix-anchor" if v2 else "legacy-local-time",
            "processes": processes, "anchors": anchors,
            "sections": anchors + (ranks * ANCHOR.itemsize if v2 else 0)}


def read_table(f, offset: int, rows: int, dtype: np.dtype, what: str, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """Packed rows in blocks of bounded size."""
    f.seek(offset)
    for start in range(0, rows, step):
        n = min(step, rows - start)
        yield np.frombuffer(exact(f, n * dtype.itemsize, what), dtype=dtype)


def _count(f, label: bytes, what: str) -> int:
    found = text(exact(f, LABEL_BYTES, f"{what} label"))
    if found != label.decode():
        raise TraceError(f"bad {what} label {found!r}")
    n = struct.unpack("<i", exact(f, 4, f"{what} count"))[0]
    if n < 0:
        raise TraceError(f"negative {what} count {n}")
    return n


def _skip(f, size: int, end: int, what: str) -> int:
    at = f.tell()
    if at + size > end:
        raise TraceError(f"file ends inside {what}")
    f.seek(at + size)
    return at


def file_size(f) -> int:
    """Uncompressed size, found by seeking; a compressed file is read once for it."""
    here = f.tell()
    if isinstance(f, MemberFile):
        f.seek(f.starts[-1])
    f.seek(0, 2) if not isinstance(f, (gzip.GzipFile, MemberFile)) else _drain(f)
    size = f.tell()
    f.seek(here)
    return size


def _drain(f, step: int = 1 << 22) -> None:
    while f.read(step):
        pass


def walk_sections(f, header: dict) -> Iterator[dict]:
    """Rank sections of an intact file, from their counts alone; only zeros may follow them."""
    end = file_size(f)
    f.seek(header["sections"])
    for pos in range(header["total_ranks"]):
        rank = struct.unpack("<i", exact(f, 4, "rank"))[0]
        n_small = _count(f, SMALL_LABEL, "small")
        small = _skip(f, n_small * SMALL.itemsize, end, "small records")
        n_large = _count(f, LARGE_LABEL, "large")
        large = _skip(f, n_large * LARGE.itemsize, end, "large records")
        yield {"section_pos": pos, "rank": rank, "small_offset": small, "n_small": n_small,
               "large_offset": large, "n_large": n_large}
    while block := f.read(1 << 20):
        if block.strip(b"\0"):
            raise TraceError("non-zero bytes after the last section")


def candidate_at(f, offset: int, end: int) -> dict | None:
    """The section that would start at an offset, when its labels and counts fit the file."""
    if offset + 32 > end:
        return None
    f.seek(offset)
    try:
        rank = struct.unpack("<i", exact(f, 4, "rank"))[0]
        n_small = _count(f, SMALL_LABEL, "small")
        small = offset + 32
        after = small + n_small * SMALL.itemsize
        if after + 28 > end:
            return None
        f.seek(after)
        n_large = _count(f, LARGE_LABEL, "large")
    except TraceError:
        return None
    large = after + 28
    stop = large + n_large * LARGE.itemsize
    if stop > end:
        return None
    return {"rank": rank, "start": offset, "stop": stop, "small_offset": small, "n_small": n_small,
            "large_offset": large, "n_large": n_large}


def find_candidates(f, first: int, low: int, high: int, end: int) -> Iterator[dict]:
    """Possible sections whose label starts in ``[low, high)``; sections begin at ``first``."""
    step, overlap = 1 << 22, len(SMALL_LABEL) - 1
    at = max(low, first + 4)
    while at < high:
        f.seek(at)
        block = f.read(min(step, high - at) + overlap)
        hit = block.find(SMALL_LABEL)
        while hit >= 0:
            if at + hit < high and _may_fit(block, hit, at + hit, end) and (found := candidate_at(f, at + hit - 4, end)):
                yield found
            hit = block.find(SMALL_LABEL, hit + 1)
        at += step


def _may_fit(block: bytes, hit: int, at: int, end: int) -> bool:
    """Whether the count behind a label, as far as the block shows it, fits the file; most false labels end here without a read."""
    behind = block[hit + len(SMALL_LABEL):hit + LABEL_BYTES + 4]
    if behind[:1] not in (b"", b"\0"):
        return False
    if len(behind) < 5:
        return True
    n = struct.unpack("<i", behind[1:])[0]
    return n >= 0 and at + LABEL_BYTES + 4 + n * SMALL.itemsize + 28 <= end


class SectionChain:
    """Candidates of one file in file order: kept are those behind the last kept one whose rank is new.

    Holds the ranks it has met, as many as sections are kept, and no candidates.
    """

    def __init__(self):
        self.position, self.seen = 0, set()

    def take(self, c: dict) -> dict | None:
        if c["start"] < self.position or c["rank"] in self.seen:
            return None
        self.seen.add(c["rank"])
        self.position = c["stop"]
        return {**c, "section_pos": len(self.seen) - 1}


def choose_sections(candidates: list[dict]) -> list[dict]:
    """Non-overlapping candidates in file order, the first of each rank."""
    chain = SectionChain()
    return [kept for c in sorted(candidates, key=lambda c: c["start"]) if (kept := chain.take(c))]
