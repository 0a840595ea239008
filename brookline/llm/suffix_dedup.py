"""Removal of repeated substrings by a distributed merge sort of suffixes.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller doc_id. Not every suffix
has to be sorted: of the K-byte strings within any SPAN bytes, the one with the smallest hash is chosen wherever those
bytes occur, so equal spans share the suffix that starts there (an anchor). The steps:

1. Texts are packed in segments (SEGMENT_BYTES at most, or one document) in a written table; a segment is the unit of work.
2. Anchors that two documents share are found by the hashes of their K bytes, 32 bits or 64 within a bucket; an accidental
   match only costs work.
3. Each segment sorts the suffixes at such anchors (their SPAN bytes, then the bytes before, nearest first, up to the
   document's ends), folds equal ones, and sends them as front-coded sorted runs: common-prefix length, then the rest.
   Suffixes are dealt out by range: cuts come from K-byte strings at even places of SAMPLED segments at most, a bounded
   sample that only balances the shares. The shares in order, each merged, are the sorted suffixes of the whole input.
4. Whoever gets a share of the suffixes merges its runs with a loser tree that keeps, for each run's head, how much of
   it equals the last suffix put out, and compares two heads only beyond that. The common-prefix lengths that the merge
   yields, and those of the bytes before, cut the suffixes into classes for every placement of a span about its anchor;
   the smallest document of a class decides for all of its members. That is exact: contents are compared, not hashes.
5. Each segment's removed intervals are united and cut out.

A unit of work never sends to more than 1 << FAN_BITS shares (twice that with hot ones). Beyond so many segments the exchange
has levels, as a merge sort has passes: the runs of about so many units for one share are merged into one, which is cut into
as many finer shares; hashes go the same way, and what is found comes back by it. So the rows of a level grow with the
number of segments, not with its square, and no task ever holds more than about a segment's worth from each side.

Equal suffixes leave a segment once. An anchor whose K bytes more than HOT places share could still gather too many
different suffixes in one task (a common phrase, each time amid other words). Around such anchors the spans themselves
are sorted and merged, dealt out by their contents: equal ones fold within a segment, different ones part.
Results depend neither on the segments, nor on FAN_BITS, nor on HOT.

Defined results: a null text counts as empty; a null doc_id is larger than any other, and null ones are equal; rows with
the same doc_id do not remove from each other; texts under SPAN bytes stay; an empty table gives an empty table; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPAN, K, SEGMENT_BYTES, BLOCK_BYTES, HOT = 50, 20, 12 << 20, 2 << 20, 50_000
FAN_BITS, SAMPLED = 8, 4096
BEFORE = SPAN - K  # bytes before an anchor that a span can take in
WIDTH = SPAN + BEFORE + 2  # of a sorted row: suffix, bytes before in reverse, how many of either lie in the document
LAST = (1 << 63) - 1  # stands for a null doc_id


def segments(docs: DataFrame, id_col: str, text_col: str, segment_bytes: int) -> DataFrame:
    """Rows (seg, ids, ends, data): a segment's doc_ids, the ends of its texts, and their bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0

        def packed() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype="<i8")
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"seg": seg, "ids": np.array(ids, "<i8").tobytes(), "ends": ends.tobytes(), "data": blob}])

        for b in batches:
            for i, t in zip(pc.fill_null(b.column(0), LAST).to_pylist(), b.column(1).cast(pa.large_string()).cast(pa.large_binary()), strict=True):
                t = t.as_py() or b""
                if ids and held + len(t) > segment_bytes:
                    yield packed()
                    seg, ids, texts, held = seg + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "seg long, ids binary, ends binary, data binary")


class Segment:
    def __init__(self, ids: bytes, ends: bytes, data: bytes) -> None:
        self.ids, self.ends = np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.starts = np.append(0, self.ends[:-1])

    def anchors(self, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents (by number here) and hashes of the anchors."""
        out, lo = [], 0
        while lo < len(self.ends):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + block_bytes, "right")))
            at, h = chosen(self.data[self.starts[lo] : self.ends[hi - 1]], self.starts[lo:hi] - self.starts[lo], self.ends[lo:hi] - self.starts[lo])
            at = at + self.starts[lo]
            out.append((at, np.searchsorted(self.ends, at, "right"), h))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))

    def spans(self, begin: np.ndarray) -> np.ndarray:
        """The SPAN bytes from each of these places."""
        return np.lib.stride_tricks.sliding_window_view(self.data, SPAN)[begin]

    def rows(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The sortable row of each anchor; what lies outside the document is zero."""
        room = np.zeros(BEFORE, np.uint8), np.zeros(SPAN, np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([room[0], self.data, room[1]]), BEFORE + SPAN)
        found = view[at]
        left, right = np.minimum(BEFORE, at - self.starts[doc]), np.minimum(SPAN, self.ends[doc] - at)
        out = np.empty((len(at), WIDTH), np.uint8)
        out[:, :SPAN], out[:, SPAN:-2] = found[:, BEFORE:], found[:, BEFORE - 1 :: -1] if BEFORE else 0
        for rows in (np.flatnonzero(right < SPAN), np.flatnonzero(left < BEFORE)):
            out[rows, :SPAN] *= np.arange(SPAN) < right[rows, None]
            out[rows, SPAN:-2] *= np.arange(BEFORE) < left[rows, None]
        out[:, -2], out[:, -1] = left, right
        return out


def chosen(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end: for any SPAN bytes within a text, the K-byte string with the smallest hash."""
    n = len(data) - K + 1
    if n < 1 or int((ends - starts).max()) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    x = data.astype(np.uint64) + np.uint64(1)
    made = {1: x}
    for m in (1, 2, 4, 8):
        made[2 * m] = made[m][:-m] * power(m) + made[m][m:]
    h = made[16][:n] * power(4) + made[4][16 : 16 + n]
    del made, x
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    v = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def slide(a: np.ndarray, op, width: int) -> np.ndarray:
        m = 1
        while 2 * m <= width:
            a, m = op(a[:-m], a[m:]), 2 * m
        return op(a[: len(a) - (width - m)], a[width - m :]) if width > m else a

    width = SPAN - K + 1
    least = np.zeros(n + width - 1, np.uint32)  # at p + width - 1: of the window that starts at p
    if n >= width:
        windows = slide(v, np.minimum, width)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):  # no window crosses a text's end
            if e - SPAN + 1 > s:
                least[s + width - 1 : e - SPAN + width] = windows[s : e - SPAN + 1]
    at = np.flatnonzero(slide(least, np.maximum, width) == v)
    return at, h[at]


def _press(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _numbers(values: np.ndarray, kind: str) -> bytes:
    """Numbers pressed byte place by byte place, as their high bytes are much alike."""
    v = np.ascontiguousarray(values.astype(kind))
    return _press(v.view(np.uint8).reshape(len(v), -1).T.tobytes()) if len(v) else _press(b"")


def _read(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(_open(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rising(values: np.ndarray, kind: str) -> bytes:
    """Numbers in order, by their differences."""
    return _numbers(np.diff(values.astype(kind), prepend=np.zeros(1, kind)), kind)


def _read_rising(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_read(raw, kind), dtype=kind)


@dataclass
class Levels:
    """How the exchange is laid out for a number of segments."""

    segments: int
    bits: int = FAN_BITS
    hot: int = HOT
    cuts: bytes = b""

    @property
    def count(self) -> int:
        n = 1
        while 1 << (self.bits * n) < self.segments:
            n += 1
        return n

    @property
    def shares(self) -> int:
        return 1 << (self.bits * self.count)

    @property
    def key(self) -> str:
        """The type of a hash within its bucket: 64 bits where 32 would meet by accident too often."""
        return "<u4" if self.count <= 2 else "<u8"

    def unit(self, seg: np.ndarray, level: int) -> np.ndarray:
        """Which unit of a level a segment belongs to: itself on the first, then packs of packs, each within one of the next."""
        seg = np.asarray(seg, np.int64)
        if level == 1:
            return seg
        with np.errstate(over="ignore"):  # meant to wrap around
            mixed = (seg.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        packs = max(1, (1 << (self.segments - 1).bit_length()) >> (self.bits * (level - 1))) if self.segments > 1 else 1
        return ((mixed >> np.uint64(33)) & np.uint64(packs - 1)).astype(np.int64)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(0xFFFFFFFF)).astype("<u4") if self.key == "<u4" else h.astype("<u8")

    def share(self, prefixes: np.ndarray) -> np.ndarray:
        """The finest shares of suffixes by their first K bytes."""
        cuts = np.frombuffer(self.cuts, f"S{K}")
        return np.searchsorted(cuts, np.ascontiguousarray(prefixes).view(f"S{K}").ravel(), "right").astype(np.int64)

    def hot_share(self, spans: np.ndarray) -> np.ndarray:
        """Those of spans about hot anchors, by their contents; they follow all others."""
        power = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SPAN)], np.uint64)
        mixed = np.concatenate([(spans[lo : lo + 50_000] * power).sum(1, dtype=np.uint64) for lo in range(0, len(spans), 50_000)])
        return ((mixed >> np.uint64(33)) % np.uint64(self.shares)).astype(np.int64) + self.shares

    def path(self, share: np.ndarray, level: int) -> np.ndarray:
        return share >> (self.bits * (self.count - level))


def sampled_cuts(held: DataFrame, levels: Levels) -> bytes:
    """The K-byte strings that part the shares. At most SAMPLED segments or so are looked at, at 64 places each."""
    every = -(-levels.segments // SAMPLED)
    each = max(64, -(-4 * levels.shares * every // max(1, levels.segments)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (row.to_pylist()[0] for b in batches for row in (b.slice(i, 1) for i in range(b.num_rows))):
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8)
            n = len(data) - K + 1
            if n > 0:
                found = np.lib.stride_tricks.sliding_window_view(data, K)[np.unique(np.linspace(0, n - 1, min(n, each)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["found"])

    some = held.where(F.pmod(F.xxhash64("seg"), F.lit(every)) == 0).select("data").mapInArrow(run, "found binary")
    found = np.sort(np.frombuffer(b"".join(r.found for r in some.collect()), f"S{K}"))  # 4 strings a share, or 64 a segment
    if not len(found):
        return b""
    at = np.linspace(0, len(found), levels.shares + 1)[1:-1].astype(np.int64)
    return np.unique(found[np.minimum(at, len(found) - 1)])[: levels.shares - 1].tobytes()


HASHES = pa.schema([("path", pa.int64()), ("unit", pa.int64()), ("pack", pa.int64()), *((c, pa.binary()) for c in ("hashes", "several", "places"))])
FLAGS = pa.schema([("path", pa.int64()), ("unit", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if pa.types.is_integer(f.type) else 'binary'}" for f in schema)


def _each(path: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(path, where it is) for every path that occurs, in order."""
    by = np.argsort(path, kind="stable")
    cuts = np.flatnonzero(np.diff(path[by], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(path[by[a]]), by[a:b]


def send_hashes(batches: Iterator[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
    """Rows of a segment for each first bucket: its distinct hashes in order, bits for those that several documents hold,
    and at how many places they are (65535 at most)."""
    for r in (row.to_pylist()[0] for b in batches for row in (b.slice(i, 1) for i in range(b.num_rows))):
        s = Segment(r["ids"], r["ends"], r["data"])
        _, doc, h = s.anchors()
        path, low = levels.bucket(h), levels.low(h)
        out = []
        for p, mine in _each(path):
            order = mine[np.argsort(low[mine], kind="stable")]
            key, ids = low[order], s.ids[doc[order]]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            places = np.minimum(np.diff(np.append(first, len(key))), 65_535).astype("<u2")
            out.append({"path": p, "unit": r["seg"], "pack": int(levels.unit(r["seg"], 2)), "hashes": _rising(key[first], levels.key), "several": _press(np.packbits(several).tobytes()), "places": _numbers(places, "<u2")})
        yield pa.RecordBatch.from_pylist(out, HASHES)


def _united(rows: list[dict], levels: Levels) -> tuple[np.ndarray, ...]:
    """Of units' hashes: all in order, and for each distinct one where it starts there, whether two documents hold it, and
    its places."""
    h = [_read_rising(r["hashes"], levels.key) for r in rows]
    several = np.concatenate([np.unpackbits(np.frombuffer(_open(r["several"]), np.uint8), count=len(x)) for r, x in zip(rows, h, strict=True)])
    places = np.concatenate([_read(r["places"], "<u2") for r in rows]).astype(np.int64)
    every = np.concatenate(h)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    size = np.diff(np.append(first, len(every)))
    return order, every, first, (size > 1) | (np.maximum.reduceat(several[order], first) > 0), np.add.reduceat(places[order], first), size


def unite_hashes(table: pa.Table, levels: Levels, level: int) -> pa.Table:
    """The hashes of a pack of units of one bucket (of this level) as rows for the buckets of the next."""
    rows = table.to_pylist()
    _, every, first, shared, places, _ = _united(rows, levels)
    key, out = every[first], []
    digit = ((key.astype(np.uint64) >> np.uint64(levels.bits * (level - 1))) & np.uint64((1 << levels.bits) - 1)).astype(np.int64)
    # The packs of a pack are numbered by the low bits of its own number.
    packs = max(1, (1 << max(0, levels.segments - 1).bit_length()) >> (levels.bits * (level + 1)))
    for d, mine in _each(digit):
        out.append({"path": rows[0]["path"] << levels.bits | d, "unit": rows[0]["pack"], "pack": rows[0]["pack"] & (packs - 1), "hashes": _rising(key[mine], levels.key), "several": _press(np.packbits(shared[mine]).tobytes()), "places": _numbers(np.minimum(places[mine], 65_535), "<u2")})
    return pa.Table.from_pylist(out, HASHES)


def shared_hashes(table: pa.Table, levels: Levels) -> pa.Table:
    """Of one bucket: for each unit its hashes that occur in two documents or more, and bits for the hot ones."""
    rows = table.to_pylist()
    order, every, _, shared, places, size = _united(rows, levels)
    good, hot = np.empty(len(every), bool), np.empty(len(every), bool)
    good[order], hot[order] = np.repeat(shared, size), np.repeat(places > levels.hot, size)
    at, out = 0, []
    for r in rows:
        x = _read_rising(r["hashes"], levels.key)
        g, w = good[at : at + len(x)], hot[at : at + len(x)]
        at += len(x)
        if g.any():
            out.append({"path": r["path"], "unit": r["unit"], "hashes": _rising(x[g], levels.key), "hot": _press(np.packbits(w[g]).tobytes())})
    return pa.Table.from_pylist(out, FLAGS)


def _known(flags: list[dict], levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Flagged hashes in order, and which are hot."""
    known = [_read_rising(r["hashes"], levels.key) for r in flags]
    hot = np.concatenate([np.unpackbits(np.frombuffer(_open(r["hot"]), np.uint8), count=len(x)) for r, x in zip(flags, known, strict=True)]).astype(bool)
    known = np.concatenate(known)
    order = np.argsort(known)
    return known[order], hot[order]


def flags_of_units(table: pa.Table, flags: pa.Table, levels: Levels) -> pa.Table:
    """What is known of a pack's hashes, for each of its units (rows of its hashes)."""
    if not flags.num_rows:
        return FLAGS.empty_table()
    known, hot = _known(flags.to_pylist(), levels)
    out = []
    for r in table.to_pylist():
        x = _read_rising(r["hashes"], levels.key)
        i = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = known[i] == x
        if hit.any():
            out.append({"path": r["path"], "unit": r["unit"], "hashes": _rising(x[hit], levels.key), "hot": _press(np.packbits(hot[i[hit]]).tobytes())})
    return pa.Table.from_pylist(out, FLAGS)


RUN = pa.schema([("path", pa.int64()), ("unit", pa.int64()), ("pack", pa.int64()), ("ahead", pa.int64()), *((c, pa.binary()) for c in ("common", "rest", "low", "new", "place", "doc", "seg"))])


def _run(rows: np.ndarray, places: np.ndarray, ids: np.ndarray, segs: np.ndarray) -> dict[str, bytes]:
    """A sorted, front-coded run of the distinct rows, with the smallest document of each and where they occur."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    return _coded(rows[order], places[order], ids[order], segs[order])


def _coded(rows: np.ndarray, places: np.ndarray, ids: np.ndarray, segs: np.ndarray) -> dict[str, bytes]:
    width = rows.shape[1]
    same = rows[1:] == rows[:-1]
    common = np.append(0, np.where(same.all(1), width, same.argmin(1)))
    new = common < width
    first, common = np.flatnonzero(new), common[new].astype(np.uint8)
    rest = rows[first][np.arange(width) >= common[:, None]]
    parts = {"common": _press(common.tobytes()), "rest": _press(rest.tobytes()), "low": _numbers(np.minimum.reduceat(ids, first), "<i8"), "new": _press(np.packbits(new).tobytes())}
    return parts | {"place": _numbers(places, "<u4"), "doc": _numbers(ids, "<i8"), "seg": _numbers(segs, "<i8")}


def sort_runs(table: pa.Table, flags: pa.Table, levels: Levels) -> pa.Table:
    """The runs of one segment, one per first share of the suffixes (ahead is -1) and one per share of the spans about hot
    anchors that begin `ahead` bytes before them."""
    if not flags.num_rows:
        return RUN.empty_table()
    known: dict[int, list[dict]] = {}
    for f in flags.to_pylist():
        known.setdefault(f["path"], []).append(f)
    out = []
    for r in table.to_pylist():
        s = Segment(r["ids"], r["ends"], r["data"])
        at, doc, h = s.anchors()
        hit, warm = np.zeros(len(at), bool), np.zeros(len(at), bool)
        low = levels.low(h)
        for p, mine in _each(levels.bucket(h)):
            if p in known:
                keys, hot = _known(known[p], levels)
                i = np.minimum(np.searchsorted(keys, low[mine]), len(keys) - 1)
                hit[mine] = keys[i] == low[mine]
                warm[mine] = hit[mine] & hot[i]
        head = {"unit": r["seg"], "pack": int(levels.unit(r["seg"], 2))}
        cold, n = np.flatnonzero(hit & ~warm), len(s.data)
        seg = lambda k: np.full(k, r["seg"], np.int64)  # noqa: B023, E731
        if len(cold):
            prefix = np.lib.stride_tricks.sliding_window_view(s.data, K)[np.minimum(at[cold], n - K)]
            for p, mine in _each(levels.path(levels.share(prefix), 1)):
                mine = cold[mine]
                out.append({"path": p, **head, "ahead": -1, **_run(s.rows(at[mine], doc[mine]), at[mine], s.ids[doc[mine]], seg(len(mine)))})
        at, doc = at[warm], doc[warm]
        for ahead in range(BEFORE + 1) if len(at) else ():
            ok = (at - s.starts[doc] >= ahead) & (s.ends[doc] - at >= SPAN - ahead)
            begin, ids = at[ok] - ahead, s.ids[doc[ok]]
            if len(begin):
                spans = s.spans(begin)
                for p, mine in _each(levels.path(levels.hot_share(spans), 1)):
                    out.append({"path": p, **head, "ahead": ahead, **_run(spans[mine], begin[mine], ids[mine], seg(len(mine)))})
    return pa.Table.from_pylist(out, RUN)


def decoded(common: bytes, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """The (common-prefix length, row) pairs of a front-coded run."""
    row, at = b"", 0
    for c in common:
        row = row[:c] + rest[at : at + width - c]
        at += width - c
        yield c, row


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Merges sorted runs of (common-prefix length with the run's previous row, row) of equal width; yields (run,
    common-prefix length with the row before, row).

    A loser tree whose players carry the length of what they share with the last row put out. Of two players, the one
    that shares more comes first, without a look at the rows; if they share as much, they are compared beyond it, and
    the loser keeps what it shares with the winner."""
    size = 1
    while size < len(runs):
        size *= 2
    common, row = [0] * size, [b""] * size
    alive = [False] * size
    for i, run in enumerate(runs):
        head = next(run, None)
        if head:
            alive[i], row[i] = True, head[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a draw goes to the smaller run."""
        if not alive[a] or not alive[b]:
            return (a, b) if alive[a] else (b, a)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        h = common[a]
        x, y = row[a][h:], row[b][h:]
        if x == y:
            if b < a:
                a, b = b, a
            common[b] = h + len(x)
            return a, b
        if x > y:
            a, b = b, a
        n = len(x)
        common[b] = h + n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        return a, b

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while alive[top]:
        yield top, common[top], row[top]
        head = next(runs[top], None)
        if head:
            common[top], row[top] = head
        else:
            alive[top] = False
        node = (top + size) // 2
        while node:
            top, losers[node] = play(losers[node], top)
            node //= 2


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one share merged: the rows in order (of several runs, equal ones each), what each shares with the one before,
    its smallest document; and of every occurrence its row's number, place, document and segment."""
    rows = table.sort_by([("unit", "ascending"), ("ahead", "ascending")]).to_pylist()
    coded = [(_open(r["common"]), _open(r["rest"])) for r in rows]
    width = WIDTH if rows[0]["ahead"] < 0 else SPAN
    runs, shared, parts = [], [], []
    for run, common, row in merge([decoded(*c, width) for c in coded]):
        runs.append(run)
        shared.append(common)
        parts.append(row)
    by_run = np.argsort(np.array(runs), kind="stable")  # entries of each run in its order
    low = np.empty(len(parts), np.int64)
    low[by_run] = np.concatenate([_read(r["low"], "<i8") for r in rows])
    begin = np.cumsum([0, *(len(c) for c, _ in coded)])
    place, doc, seg, entry = [], [], [], []
    for i, r in enumerate(rows):
        place.append(_read(r["place"], "<u4").astype(np.int64))
        doc.append(_read(r["doc"], "<i8"))
        seg.append(_read(r["seg"], "<i8"))
        entry.append(by_run[begin[i] + np.cumsum(np.unpackbits(np.frombuffer(_open(r["new"]), np.uint8), count=len(place[-1])).astype(np.int64)) - 1])
    matrix = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    return matrix, np.array(shared), low, np.concatenate(entry), np.concatenate(place), np.concatenate(doc), np.concatenate(seg)


def merge_runs(table: pa.Table, levels: Levels, level: int) -> pa.Table:
    """The runs of a pack of units for one share (of this level), merged and cut at the shares of the next."""
    pack, path = table.column("pack")[0].as_py(), table.column("path")[0].as_py()
    hot = path >= 1 << (levels.bits * level)
    matrix, _, _, entry, place, doc, seg = _merged(table)
    share = levels.hot_share(matrix) if hot else levels.share(matrix[:, :K])
    order = np.argsort(entry, kind="stable")
    entry, place, doc, seg = entry[order], place[order], doc[order], seg[order]
    packs = max(1, (1 << max(0, levels.segments - 1).bit_length()) >> (levels.bits * (level + 1)))
    out = []
    for p, mine in _each(levels.path(share, level + 1)[entry]):
        out.append({"path": p, "unit": pack, "pack": pack & (packs - 1), "ahead": 0 if hot else -1, **_coded(matrix[entry[mine]], place[mine], doc[mine], seg[mine])})
    return pa.Table.from_pylist(out, RUN)


GONE = pa.schema([("path", pa.int64()), ("unit", pa.int64()), *((c, pa.binary()) for c in ("seg", "begin", "end"))])


def _by_unit(path: int, seg: np.ndarray, begin: np.ndarray, end: np.ndarray, levels: Levels, level: int) -> pa.Table:
    out = []
    for u, mine in _each(levels.unit(seg, level)) if len(seg) else ():
        out.append({"path": path, "unit": u, "seg": _numbers(seg[mine], "<i8"), "begin": _numbers(begin[mine], "<u4"), "end": _numbers(end[mine], "<u4")})
    return pa.Table.from_pylist(out, GONE)


def _intervals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([_read(x, kind) for x in table.column(c).to_pylist()] or [np.empty(0, kind)]) for c, kind in (("seg", "<i8"), ("begin", "<u4"), ("end", "<u4")))


def split_intervals(table: pa.Table, levels: Levels, level: int) -> pa.Table:
    """Of the shares below one of the level before: the intervals of a pack, for each of its units."""
    return _by_unit(table.column("path")[0].as_py() >> levels.bits, *_intervals(table), levels, level - 1)


def covered(table: pa.Table, levels: Levels) -> pa.Table:
    """Of one share: for each unit the intervals of its segments that go."""
    matrix, shared, low, entry, place, doc, seg = _merged(table)
    if matrix.shape[1] == SPAN:  # equal spans lie together
        first = np.flatnonzero(shared < SPAN)
        least = np.repeat(np.minimum.reduceat(low, first), np.diff(np.append(first, len(low))))[None]
    else:
        least = _least(matrix, shared, low)
    begin, end, of = [], [], []
    for lo in range(0, len(entry), 200_000):  # blocks bound the memory of many occurrences
        some = slice(lo, lo + 200_000)
        gone = least[:, entry[some]] < doc[some]
        hit = gone.any(0)
        # Spans about one anchor overlap: their union runs from the first to the last.
        far, near = len(least) - 1 - gone[::-1, hit].argmax(0), gone[:, hit].argmax(0)
        begin.append(place[some][hit] - far)
        end.append(place[some][hit] - near + SPAN)
        of.append(seg[some][hit])
    return _by_unit(table.column("path")[0].as_py(), np.concatenate(of), np.concatenate(begin), np.concatenate(end), levels, levels.count)


def _least(suffix: np.ndarray, shared: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every number of bytes that a span begins before its anchor, and every sorted row: the smallest document with
    the same span there (LAST where the span leaves the document). shared: common prefixes of neighbouring rows."""
    n, left, right = len(suffix), suffix[:, -2], suffix[:, -1]
    # Classes of the bytes before an anchor, for every length, from the common prefixes of their sorted order.
    before = np.ascontiguousarray(suffix[:, SPAN:-2])
    order = np.argsort(before.view(f"S{BEFORE}").ravel(), kind="stable")
    same = before[order[1:]] == before[order[:-1]]
    shared_before = np.append(0, np.where(same.all(1), BEFORE, same.argmin(1)))
    least = np.full((BEFORE + 1, n), LAST)
    for j in range(BEFORE + 1):  # the span starts j bytes before the anchor
        ok = np.flatnonzero((left >= j) & (right >= SPAN - j))
        if not len(ok):
            continue
        behind = np.cumsum(shared < SPAN - j)
        ahead = np.empty(n, np.int64)
        ahead[order] = np.cumsum(shared_before < j)
        key = behind[ok] * (n + 1) + ahead[ok]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        least[j, ok[by]] = np.repeat(np.minimum.reduceat(low[ok[by]], first), np.diff(np.append(first, len(by))))
    return least


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def cut_out(table: pa.Table, intervals: pa.Table, keep: bool) -> pa.Table:
    """A segment's documents without what goes."""
    out = []
    for r in table.to_pylist():
        s = Segment(r["ids"], r["ends"], r["data"])
        _, begin, end = _intervals(intervals)
        n = len(s.data) + 1
        gone = np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0 if len(begin) else np.zeros(n - 1, bool)
        for i, a, b in zip(s.ids.tolist(), s.starts.tolist(), s.ends.tolist(), strict=True):
            mask = gone[a:b]
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)) if b > a else np.empty(0, np.int64)
            left = s.data[a:b][~mask].tobytes() if len(edges) else s.data[a:b].tobytes()
            out.append((None if i == LAST else i, b - a, b - a - len(left), edges.reshape(-1, 2).tolist(), hashlib.sha256(left).hexdigest(), left if keep else None))
    cols = list(zip(*out, strict=True)) if out else [[] for _ in _RESULT]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _RESULT, strict=True)], schema=_RESULT)


def _with(f, levels: Levels, level: int):
    return lambda t: f(t, levels, level)


def hash_levels(held: DataFrame, levels: Levels) -> list[DataFrame]:
    """The hashes by bucket and unit, level by level. Lower levels are written: what is found comes back by them."""
    out = [held.mapInArrow(lambda batches: send_hashes(batches, levels), _spark(HASHES))]
    for level in range(1, levels.count):
        out[-1] = written(out[-1], "hashes")
        out.append(out[-1].groupBy("path", "pack").applyInArrow(_with(unite_hashes, levels, level), _spark(HASHES)))
    return out


def known_hashes(hashes: list[DataFrame], levels: Levels) -> DataFrame:
    """Rows (path, unit, hashes, hot): of each segment and first bucket the hashes that two documents share."""
    flags = hashes[-1].groupBy("path").applyInArrow(lambda t: shared_hashes(t, levels), _spark(FLAGS))
    for lower in reversed(hashes[:-1]):
        above = flags.withColumn("parent", F.shiftright("path", levels.bits)).withColumnRenamed("unit", "pack").groupBy("parent", "pack")
        flags = lower.groupBy("path", "pack").cogroup(above).applyInArrow(lambda t, f: flags_of_units(t, f, levels), _spark(FLAGS))
    return flags


def run_levels(held: DataFrame, flags: DataFrame, levels: Levels) -> list[DataFrame]:
    """The sorted runs by share and unit, level by level."""
    named = flags.withColumnRenamed("unit", "seg")
    out = [held.groupBy("seg").cogroup(named.groupBy("seg")).applyInArrow(lambda t, f: sort_runs(t, f, levels), _spark(RUN))]
    for level in range(1, levels.count):
        out.append(out[-1].groupBy("path", "pack").applyInArrow(_with(merge_runs, levels, level), _spark(RUN)))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, segment_bytes: int = SEGMENT_BYTES, hot: int = HOT, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (begin and end of what goes, in bytes), kept_sha256,
    and, with keep, the remaining bytes as kept."""
    held = written(segments(docs, id_col, text_col, segment_bytes), "segments")
    levels = Levels(held.select("seg").count(), fan_bits, hot)
    levels.cuts = sampled_cuts(held, levels)
    flags = known_hashes(hash_levels(held, levels), levels)
    intervals = run_levels(held, flags, levels)[-1].groupBy("path").applyInArrow(lambda t: covered(t, levels), _spark(GONE))
    for level in range(levels.count, 1, -1):
        above = intervals.withColumn("parent", F.shiftright("path", levels.bits))
        intervals = above.groupBy("parent", "unit").applyInArrow(_with(split_intervals, levels, level), _spark(GONE))
    named = intervals.select(F.col("unit").alias("of"), "seg", "begin", "end")
    return held.groupBy("seg").cogroup(named.groupBy("of")).applyInArrow(lambda t, i: cut_out(t, i, keep), RESULT)
