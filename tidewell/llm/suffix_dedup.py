"""Removal of repeated passages with suffix arrays.

A byte goes if a window of WINDOW bytes that covers it also starts in a document with a smaller
doc_id. The corpus is cut into blocks of documents. Each window is represented by its anchor, the
K-byte string with the least hash in it (leftmost if tied), so equal windows have equal anchors at
equal places.

1. Blocks send their anchors' hashes to buckets, once each, with the number of documents; buckets
   answer which of them occur in other blocks too, and which in so many documents that they are hot.
2. Blocks send the stretches of text around shared anchors to the anchor's bucket, one for each
   distinct stretch, with the smallest doc_id that has it. Windows around a hot anchor are sent one
   by one to the window's own bucket, so that no bucket receives an unbounded group.
3. A bucket merges equal stretches (by hashes that bytes confirm, keeping the smallest doc_id) and
   builds suffix arrays over those that are left and may share a window with another one. The windows
   that are equal stand together in them, which gives the first document of each; it answers with the
   windows of each stretch that some smaller document has.
4. Blocks turn the answers into removed bytes.

So whole copies of a stretch go by the merging before the arrays, which keeps a passage that very many
documents share from being sorted as often; windows of stretches that differ go by the arrays.

The suffix array is built by linear grouping (Lyndon groups, see `suffix_array`). Hashes bring rows
together; where two rows meet, their bytes are compared.

Defined results: a null text is empty; documents under WINDOW bytes lose nothing; rows with one
doc_id don't remove each other's bytes; a null doc_id counts as larger than all; a text of any
length is read whole, and one larger than a block is a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bucketed

WINDOW = 50
K = 20
SPAN = WINDOW - K + 1  # places of an anchor in a window
HALF = (SPAN - 1) // 2
WIDE = SPAN + WINDOW - 1  # bytes of the longest stretch
BLOCK_BYTES = 2 << 20
STRIP = 1 << 15
_LOW = np.uint64(17)  # bits that hold a place in a strip; the hash above them decides, the same everywhere
BUCKET_ANCHORS = 400_000
BUCKET_BYTES = 4 << 20
HOT_DOCUMENTS = 20_000
SYMBOLS = 150_000
#: Rows whose bytes are compared at a time.
CONFIRMED = 50_000
NO_ID = np.iinfo(np.int64).max


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of text, whose last symbol is a unique least one, by linear grouping.

    Suffixes are grouped by first symbol; groups are then taken in descending order. Each member
    points to the nearest position before it whose group is smaller; a position that is pointed to
    l times from the group moves to a new group just above its old one, those with larger l higher.
    When all groups are done, suffixes in one group have the same longest Lyndon prefix, and one
    pass in ascending order fills every group from its first place on.
    """
    n = len(text)
    symbols = np.asarray(text)
    by_symbol = np.argsort(symbols, kind="stable")
    ends = np.flatnonzero(np.diff(symbols[by_symbol])) + 1
    starts = np.concatenate([[0], ends]).astype(np.int64)
    sizes = np.diff(np.append(starts, n))
    order = by_symbol.tolist()
    place, group, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[by_symbol], group[by_symbol], size[starts] = np.arange(n), np.repeat(starts, sizes), sizes
    place, group, size = place.tolist(), group.tolist(), size.tolist()
    before = list(range(-1, n - 1))
    end = n - 1
    while end >= 0:
        first = group[order[end]]
        if first == end:  # a group of one points to one place at most
            s = order[end]
            j = before[s]
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[s] = j
            if j >= 0:
                g = group[j]
                left = size[g] - 1
                if left:  # j goes to the end of its group and is a group of its own there
                    last = g + left
                    other, at = order[last], place[j]
                    order[last], order[at] = j, other
                    place[j], place[other] = last, at
                    size[g], group[j], size[last] = left, last, 1
            end -= 1
            continue
        pointed = []
        for s in order[first : end + 1]:
            j = before[s]
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[s] = j
            if j >= 0 and size[group[j]] > 1:
                pointed.append(j)
        if len(set(pointed)) == len(pointed):  # each place once, which is usual
            by = {1: pointed} if pointed else {}
        else:
            by = {}
            for j, l in Counter(pointed).items():
                by.setdefault(l, []).append(j)
        for l in sorted(by, reverse=True):
            moved = by[l]
            for j in moved:  # to the end of its group
                g = group[j]
                left = size[g] = size[g] - 1
                last = g + left
                other, at = order[last], place[j]
                order[last], order[at] = j, other
                place[j], place[other] = last, at
            for j in moved:
                g = group[j]
                group[j] = -1 - g - size[g]
            for j in moved:
                g = group[j] = -1 - group[j]
                size[g] += 1
        end = first - 1
    out, free, done = [0] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<i8", len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def row_hashes(rows: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row of a uint8 matrix (width divisible by 8) and its extra number."""
    words = np.ascontiguousarray(rows).view("<u8")
    out = []
    for seed in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = extra.astype(np.uint64) * np.uint64(seed) + np.uint64(seed >> 7)
        for c in range(words.shape[1]):
            h = _mix(h ^ words[:, c]) * np.uint64(seed)
        out.append(_mix(h))
    return out[0], out[1]


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their class, where classes begin in that order, and each row's class."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.zeros(0, bool)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def row_classes(rows: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_classes of the rows of a uint8 matrix with their extra numbers: by hashes, confirmed byte by byte."""
    order, begin, which = _classes(*row_hashes(rows, extra))
    words = np.ascontiguousarray(rows).view("<u8")
    for low in range(1, len(order), CONFIRMED):
        here, before = order[low : low + CONFIRMED], order[low - 1 : low + CONFIRMED - 1][: len(order) - low]
        same = which[here] == which[before]
        if ((words[here] != words[before]).any(axis=1) | (extra[here] != extra[before]))[same].any():  # two rows of one hash
            full = np.concatenate([words, extra.astype(np.int64).view("<u8")[:, None]], axis=1)
            order = np.lexsort(full.T)
            new = np.concatenate([[True], (full[order[1:]] != full[order[:-1]]).any(axis=1)])
            which = np.empty(len(rows), np.int64)
            which[order] = np.cumsum(new) - 1
            return order, np.flatnonzero(new), which
    return order, begin, which


def gathered(data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Stretches of data as rows of `width` bytes, zero beyond their length."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[at].copy()
    out[np.arange(width)[None, :] >= length[:, None]] = 0
    return out


class Block:
    """Documents side by side, and the anchors of their windows."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, number of windows, document, hash) of each anchor, in text order."""
        n = len(self.data)
        windows = n - WINDOW + 1
        if windows <= 0:
            return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
        anchor, hashes = np.empty(windows, np.int64), np.empty(windows, np.uint64)
        padded = self.data.tobytes() + b"\0" * 40
        for at in range(0, windows, STRIP):  # strips that stay in the processor's cache
            to = min(windows, at + STRIP)
            h = anchor_hashes(padded, at, to - at + SPAN - 1)
            low = (h >> _LOW << _LOW) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= SPAN:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < SPAN:
                low = np.minimum(low[: to - at], low[SPAN - width :])
            place = (low & np.uint64((1 << int(_LOW)) - 1)).astype(np.int64)
            anchor[at:to] = place + at
            hashes[at:to] = h[place]
        count = np.maximum(self.lengths - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        window = np.arange(len(doc)) + np.repeat(self.starts - (np.cumsum(count) - count), count)
        a = anchor[window]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return a[first], window[first], np.diff(np.append(first, len(a))), doc[first], _mix(hashes[window[first]])


def anchor_hashes(padded: bytes, at: int, n: int) -> np.ndarray:
    """Hashes of the K bytes from each of n positions on."""
    load = np.empty(n + 12, np.uint64)
    for o in range(8):
        load[o::8] = np.frombuffer(padded, "<u8", len(range(o, n + 12, 8)), at + o)
    h = load[:n] * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    h += load[8 : 8 + n]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += load[12 : 12 + n] >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, n_bytes, rows): docs' rows, with all their columns, in compressed blocks."""

    def cut(batches):
        pack = zstandard.ZstdCompressor(level=3)
        have, size = [], 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, have[0].schema) as w:
                for part in have:
                    w.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([pack.compress(sink.getvalue())], pa.binary())], names=["n_bytes", "rows"])

        for batch in batches:
            sizes = np.cumsum([len(x or "") for x in batch.column("text").to_pylist()]).tolist()
            at = 0
            while at < len(sizes):
                base, to = sizes[at - 1] if at else 0, at + 1
                while to < len(sizes) and size + sizes[to] - base <= BLOCK_BYTES:
                    to += 1
                have.append(batch.slice(at, to - at))
                size += sizes[to - 1] - base
                at = to
                if size + 1 >= BLOCK_BYTES or at < len(sizes):
                    yield block()
                    have, size = [], 0
        if have:
            yield block()

    return docs.mapInArrow(cut, "n_bytes long, rows binary").withColumn("block", F.monotonically_increasing_id())


def _open(blob: bytes) -> tuple[pa.Table, Block]:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as r:
        table = r.read_all()
    ids = table.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
    return table, Block(ids, [(x or "").encode("utf-8", "surrogatepass") for x in table.column("text").to_pylist()])


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Buckets of an ascending array with their slices."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket, and 32 bits more."""
    return (h >> np.uint64(33)) % np.uint64(buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_MESSAGE = (["block", "bucket", "body"], [pa.int64(), pa.int64(), pa.binary()])
_MESSAGES = "block long, bucket long, body binary"


def _ask_anchors(buckets: int):
    def rows(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                keys, n = np.unique(_keys(_open(blob)[1].runs()[4], buckets), return_counts=True)
                at, value, n = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32), n.astype(np.uint32)
                out = [(block, b, _pack(value[s], n[s])) for b, s in _by_bucket(at)]
                if out:
                    yield _batch(*_MESSAGE, out)

    return rows


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each value that a block sent: 0 if no other block has it, 1 if one has, 2 if it is hot."""
    parts = [_unpack(x, "<u4", "<u4") for x in table.column("body").to_pylist()]
    _, which, blocks = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True, return_counts=True)
    docs = np.bincount(which, weights=np.concatenate([n for _, n in parts]))
    flag = (blocks > 1).astype(np.uint8)
    flag[docs > HOT_DOCUMENTS] = 2
    flag = flag[which]
    ends = np.cumsum([len(v) for v, _ in parts])
    body = [flag[e - len(v) : e].tobytes() for (v, _), e in zip(parts, ends)]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(body, pa.binary())], names=_MESSAGE[0])


def _joined(told: list[dict] | None) -> bytes:
    """The bodies of a block's answers, by ascending bucket."""
    return b"".join(x["body"] for x in sorted(told or [], key=lambda x: x["bucket"]))


def _ask_stretches(buckets: int, stretch_buckets: int):
    def rows(batches):
        for batch in batches:
            for block, blob, told in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "told"))):
                out = stretches(block, _open(blob)[1], np.frombuffer(_joined(told), np.uint8), buckets, stretch_buckets)
                if out:
                    yield _batch(*_MESSAGE, out)

    return rows


def stretches(block: int, docs: Block, flags: np.ndarray, buckets: int, stretch_buckets: int) -> list[tuple]:
    anchor, first, count, doc, h = docs.runs()
    if not len(h):
        return []
    flag = flags[np.unique(_keys(h, buckets), return_inverse=True)[1]]
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], docs.ids[doc[order]]
    new = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    several = np.minimum.reduceat(ds, new) != np.maximum.reduceat(ds, new)
    here = np.empty(len(h), bool)
    here[order] = np.repeat(several, np.diff(np.append(new, len(hs))))
    cold, hot = np.flatnonzero((flag == 1) | (flag == 0) & here), np.flatnonzero(flag == 2)
    one = np.repeat(hot, count[hot])
    step = np.arange(len(one)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
    lo, n = np.concatenate([first[cold], first[one] + step]), np.concatenate([count[cold], np.ones(len(one), np.int64)])
    if not len(lo):
        return []
    run = np.concatenate([cold, one])
    left = anchor[run] - lo
    text = gathered(docs.data, lo, n + WINDOW - 1, WIDE)
    order, begin, which = row_classes(text, left * 64 + n)
    ids = docs.ids[doc[run]]
    least = np.minimum.reduceat(ids[order], begin)
    shown = order[begin]
    own = np.where(shown < len(cold), h[run[shown]], row_hashes(text[shown], (left * 64 + n)[shown])[0])
    bucket = (own % np.uint64(stretch_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    shown, least, bucket = shown[by], least[by], bucket[by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    out = []
    for k, s in _by_bucket(bucket):
        r = shown[s]
        bytes_ = text[r][np.arange(WIDE)[None, :] < (n[r] + WINDOW - 1)[:, None]]
        out.append((block, k, _pack(least[s], left[r].astype(np.uint8), n[r].astype(np.uint8), bytes_)))
    # what the block must remember to read the answers goes along, to a group of its own
    memory = _pack(lo.astype(np.uint32), n.astype(np.uint8), rank[which].astype(np.uint32), ids > least[rank[which]])
    out.append((block, -1 - block, memory))
    return out


def _answer_stretches(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        return table.select(_MESSAGE[0]).set_column(1, "bucket", pa.array([-1] * len(table), pa.int64()))
    parts = [_unpack(x, "<i8", "u1", "u1", "u1") for x in table.column("body").to_pylist()]
    doc, left, n, data = (np.concatenate(x) for x in zip(*parts))
    left, n = left.astype(np.int64), n.astype(np.int64)
    length = n + WINDOW - 1
    masks = seen_earlier(gathered(data, np.cumsum(length) - length, length, WIDE), left, n, doc)
    ends = np.cumsum([len(p[0]) for p in parts])
    body = [masks[e - len(p[0]) : e].tobytes() for p, e in zip(parts, ends)]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(body, pa.binary())], names=_MESSAGE[0])


def seen_earlier(text: np.ndarray, left: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per stretch, a bit for each of its windows that a document smaller than the stretch's has.

    A stretch has n windows; its anchor begins at byte `left`.
    """
    order, begin, which = row_classes(text, left * 64 + n)
    shown, least = order[begin], np.minimum.reduceat(doc[order], begin)
    width = -(-K // 8) * 8
    anchors = gathered(text[shown].reshape(-1), np.arange(len(shown)) * WIDE + left[shown], np.full(len(shown), K), width)
    order, begin, symbol = row_classes(anchors, np.zeros(len(shown), np.int64))
    members = np.diff(np.append(begin, len(shown)))
    first = np.repeat(least[:, None], SPAN, axis=1)  # of each window, its smallest document among equal stretches; the arrays add the others
    hard = np.flatnonzero(members[symbol] > 1)
    skip, count = _may_share(text, left, n, shown[hard], symbol[hard])
    order = np.flatnonzero(count > 0)
    order = order[np.argsort(symbol[hard[order]], kind="stable")]
    hard, skip, count = hard[order], skip[order], count[order]
    symbols = np.cumsum(count + SPAN)  # with a separator each
    at = 0
    while at < len(hard):  # whole anchors at a time
        base = symbols[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(symbols, base + SYMBOLS, side="right")))
        while to < len(hard) and symbol[hard[to]] == symbol[hard[to - 1]]:
            to += 1
        _first_documents(text, left, shown, least, symbol, hard[at:to], skip[at:to], count[at:to], first)
        at = to
    seen = first[which] < doc[:, None]
    seen &= np.arange(SPAN)[None, :] < n[:, None]
    return (seen.astype(np.uint32) << np.arange(SPAN, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _may_share(text: np.ndarray, left: np.ndarray, n: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the windows of each stretch that another stretch of its anchor may have.

    A window holds SPAN - 1 bytes of context, so HALF of them are on one side of the anchor, next to
    it: with nothing in common there on the left, only windows with less on that side can be shared.
    """
    l, right = left[rows], n[rows] + WINDOW - 1 - left[rows] - K
    width = -(-HALF // 8) * 8
    flat = text[rows].reshape(-1)
    same = []
    for begin, has in ((l - HALF, l >= HALF), (l + K, right >= HALF)):
        out, some = np.zeros(len(rows), bool), np.flatnonzero(has)
        if len(some):
            half = gathered(flat, some * WIDE + begin[some], np.full(len(some), HALF), width)
            order, first, which = row_classes(half, symbol[some])
            out[some] = np.diff(np.append(first, len(some)))[which] > 1
        same.append(out)
    skip = np.where(same[0], 0, np.maximum(l - HALF + 1, 0))
    end = np.where(same[1], n[rows], np.minimum(n[rows], l - (SPAN - 1 - HALF)))
    return skip, np.where(same[0] | same[1], np.maximum(end - skip, 0), 0)


def _first_documents(text, left, shown, least, symbol, some, skip, count, first) -> None:
    """Sort the suffixes of these stretches, an anchor being one symbol, and spread each window's smallest document."""
    rows = shown[some]
    columns = np.arange(WIDE - K + 1)[None, :]
    l = (left[rows] - skip)[:, None]
    source = np.where(columns <= l, columns, columns + K - 1) + skip[:, None]
    flat = np.take_along_axis(text[rows], np.minimum(source, WIDE - 1), axis=1).astype(np.int64) + 2
    own = np.unique(symbol[some], return_inverse=True)[1]
    flat = np.where(columns == l, 258 + own[:, None], flat)
    used = columns < (count + SPAN - 1)[:, None]
    flat = np.concatenate([np.where(used, flat, 0), np.ones((len(rows), 1), np.int64)], axis=1)
    keep = np.concatenate([used, np.ones((len(rows), 1), bool)], axis=1)
    string = flat[keep]
    order = np.array(suffix_array([*string.tolist(), 0]))[1:]
    sizes = count + SPAN
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)[order]
    offset = order - begin[owner]
    window = offset < count[owner]
    order, owner, offset = order[window], owner[window], offset[window]
    content = np.lib.stride_tricks.sliding_window_view(np.concatenate([string, np.zeros(SPAN, np.int64)]), SPAN)
    new = np.ones(len(order), bool)
    for low in range(1, len(order), 50_000):  # equal windows are neighbours in the suffix array
        part = slice(low, min(len(order), low + 50_000))
        new[part] = (content[order[part]] != content[order[part.start - 1 : part.stop - 1]]).any(axis=1)
    starts = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[some][owner], starts)
    first[some[owner], offset + skip[owner]] = np.repeat(smallest, np.diff(np.append(starts, len(order))))


def removed_bytes(docs: Block, told: list[dict] | None) -> np.ndarray:
    """A flag for each byte of the block."""
    cover = np.zeros(len(docs.data) + 1, np.int64)
    memory = next((x["body"] for x in told or [] if x["bucket"] == -1), None)
    if memory is not None:
        lo, n, row, later = _unpack(memory, "<u4", "u1", "<u4", "?")
        mask = np.frombuffer(_joined([x for x in told if x["bucket"] >= 0]), np.uint32)[row]
        gone = ((mask[:, None] >> np.arange(SPAN, dtype=np.uint32)) & 1).astype(bool) | later[:, None]
        gone &= np.arange(SPAN)[None, :] < n[:, None]
        r, o = np.nonzero(gone)
        at = lo[r].astype(np.int64) + o
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _spread_out(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Run the four steps; finish(table, block, gone) gives a block's result."""
    blocks = bucketed(blocks_of(docs), "block", 2 * docs.rdd.getNumPartitions())
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, total * 2 // (SPAN + 1) // BUCKET_ANCHORS)
    stretch_buckets = max(1, total // BUCKET_BYTES)
    told = lambda x: x.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("told"))
    anchors = blocks.select("block", "rows").mapInArrow(_ask_anchors(buckets), _MESSAGES).groupBy("bucket").applyInArrow(_answer_anchors, _MESSAGES)
    asked = blocks.select("block", "rows").join(told(anchors), "block").mapInArrow(_ask_stretches(buckets, stretch_buckets), _MESSAGES)
    answers = asked.groupBy("bucket").applyInArrow(_answer_stretches, _MESSAGES)

    def rows(batches):
        for batch in batches:
            for blob, x in zip(batch.column("rows").to_pylist(), batch.column("told").to_pylist()):
                table, block = _open(blob)
                yield finish(table, block, removed_bytes(block, x))

    return blocks.select("block", "rows").join(told(answers), "block", "left").mapInArrow(rows, schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(table, block, gone):
        out = []
        for text, at, to in zip(block.texts, block.starts.tolist(), block.ends.tolist()):
            g = gone[at:to]
            n = int(np.count_nonzero(g))
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0
            out.append((len(text), n, spans, hashlib.sha256(block.data[at:to][~g].tobytes() if n else text).hexdigest()))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").cast(pa.int64()).combine_chunks(), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _spread_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text (a character that loses some of its bytes goes whole), n_chars set to match."""
    columns = docs.columns

    def finish(table, block, gone):
        texts = []
        for text, null, at, to in zip(block.texts, table.column("text").is_null().to_pylist(), block.starts.tolist(), block.ends.tolist()):
            g = gone[at:to]
            kept = block.data[at:to][~g].tobytes() if g.any() else text
            texts.append(None if null else kept.decode("utf-8", "ignore"))
        out = table.combine_chunks()
        for name, values in (("text", texts), ("n_chars", [None if x is None else len(x) for x in texts])):
            if name in columns:
                i = out.schema.get_field_index(name)
                out = out.set_column(i, out.schema.field(i), pa.array(values, out.schema.field(i).type))
        return out.combine_chunks().to_batches()[0]

    return _spread_out(docs, finish, docs.schema)
