"""Removes repeated byte passages by suffix arrays: what an earlier document has for 50 bytes or more.

A window is ``length`` bytes that start in a document. Every window's smallest doc_id is found exactly:

* Seeds. A window's seed is the smallest hash among its ``k``-byte pieces, so equal windows have equal
  seeds wherever they stand, and neighbours mostly share theirs: a text falls into runs of windows of
  one seed, one for about 18 bytes. Seeds, as 48-bit numbers sorted and packed, go to shards of the
  seeds' range, where those in two documents or more are found and sent back to the documents' shards.
* Shards of suffixes. Document shards cut the runs of repeated seeds out of their texts, each distinct
  one once, with the smallest doc_id there. Runs of one seed meet in one shard, in blocks of at most
  ``block_bytes``. Runs none of whose windows has another's 64-bit hash are settled (most share only their
  seed). Of each block of the rest a suffix array is made by Larsson-Sadakane refinement (sorted by 8 bytes,
  then groups that are still equal by the ranks that lie 8, 16, 32 ... bytes on), and Kasai's method
  gives common prefixes along each run: windows of equal bytes stand together, with their smallest
  doc_id. Blocks are merged by binary search: each block's distinct windows are looked up in the
  others' sorted suffixes.
* The smallest doc_ids go back to the document shards, which mark the bytes covered.

A seed in very many documents (``crowded``) would bring all their runs to one shard; its windows are cut
anew by a second seed of 32 bytes. A passage that very many documents share is one run a document
shard, whatever their number. Numbers of shards grow with the bytes; each pair of a document shard and a
shard of seeds exchanges blobs, so shards of seeds are larger where there are many. No pair of documents
is ever made.

A null text is empty. A null doc_id comes after all others. Rows that share a doc_id do not remove
each other's bytes. Texts shorter than ``length`` stay. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import row_columns, whole_text
from spanweave.session import materialize

_LAST = (1 << 63) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Seeds have so many bits; equal ones of different pieces only cost time.
_BITS = 48
#: Runs longer than this many windows (of periodic texts) are cut.
_RUN = 64
#: So many shards of seeds before they grow, and to how many times a document shard's text.
_SEED_SHARDS, _SEED_GROWTH = 512, 4
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


@dataclass(frozen=True)
class Layout:
    """What all stages have to agree on."""

    length: int = 50
    k: int = 16
    second_k: int = 32
    crowded: int = 50_000
    shards: int = 1
    block_bytes: int = 1 << 20

    def __post_init__(self):
        assert self.length > self.second_k > self.k and not self.k & (self.k - 1) and not self.second_k & (self.second_k - 1)

    def shard_of(self, key: np.ndarray) -> np.ndarray:
        """The shard of a 48-bit seed: an even range of them."""
        return ((key >> np.uint64(16)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)


def pack(*columns: np.ndarray, data: bytes = b"") -> bytes:
    """Columns of one length, stored byte plane by byte plane, and more data, compressed."""
    head = struct.pack("<I", len(columns[0]))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return _PACKER.compress(head + b"".join(planes) + data)


def unpack(blob: bytes, *kinds: str) -> tuple:
    """What ``pack`` was given, as arrays of these types and the data."""
    raw = _UNPACKER.decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for kind in map(np.dtype, kinds):
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += n * kind.itemsize
    return (*out, raw[at:])


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _doubled(raw: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Hashes of all pieces of a power of two of bytes, ``most`` and 32 at most, and that power."""
    h, span = _BYTE[raw], 1
    for odd in _ODD:
        if 2 * span <= most:
            h = h[:-span] * odd + h[span:]
            span *= 2
    return h, span


def seeds(raw: np.ndarray, length: int, k: int) -> np.ndarray:
    """The smallest hash of the k-byte pieces of each window of ``length`` bytes."""
    h, _ = _doubled(raw, k)
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    width, span = length - k + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :])


def _stretches(ends: np.ndarray, length: int, step: int = 262_144) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, ends of texts in it) of stretches of about ``step`` bytes; a longer text is cut so that each
    of its windows starts in one stretch."""
    begins = np.concatenate([[0], ends[:-1]])
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + step, "right")))
        base, top = int(begins[lo]), int(ends[hi - 1])
        if top - base <= step:
            yield base, top, ends[lo:hi] - base
        else:
            for b in range(base, top, step):
                t = min(top, b + step + length - 1)
                yield b, t, np.array([t - b])
        lo = hi


def runs(raw: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, windows, seed) of each run in texts laid end to end, none across two texts.

    ``ends``: where each text ends. Work goes in pieces that stay in the processor's cache.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for base, top, stops in _stretches(ends, length):
        if top - base >= length:
            s = seeds(raw[base:top], length, k)
            change = np.empty(len(s), bool)
            change[0] = True
            np.not_equal(s[1:], s[:-1], out=change[1:])
            starts = np.concatenate([[0], stops[:-1]])
            change[starts[starts < len(s)]] = True
            dead = np.maximum(stops - length + 1, starts)  # from here on windows would cross
            change[dead[dead < len(s)]] = True
            first = np.flatnonzero(change)
            size = np.diff(first, append=len(s))
            text = np.searchsorted(stops, first, "right")
            live = first < dead[text]
            first, size = first[live], size[live]
            if size.size and size.max() > _RUN:
                cuts = -(-size // _RUN)
                nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first, size = np.repeat(first, cuts) + nth * _RUN, np.minimum(np.repeat(size, cuts) - nth * _RUN, _RUN)
            key = s[first]
            key = (key ^ (key >> np.uint64(29))) * _ODD[1]
            out.append((first + base, size, (key ^ (key >> np.uint64(31))) * _ODD[2] >> np.uint64(64 - _BITS)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def seed_blobs(rows: list[tuple[int, bytes]], lay: Layout) -> Iterator[tuple[int, bytes]]:
    """(shard of seeds, blob) of up to 65,536 texts (document shard, text): seed, document shard, documents."""
    rows = sorted(rows, key=lambda r: r[0])
    home = np.array([r[0] for r in rows], np.uint32)
    raw, ends = _laid([r[1] for r in rows])
    first, _, key = runs(raw, ends, lay.length, lay.k)
    # a text counts once; texts are in the order of their shards
    each = key << np.uint64(16) | np.searchsorted(ends, first, "right").astype(np.uint64)
    each.sort()
    each = each[np.append(True, each[1:] != each[:-1])[: len(each)]]
    key, where = each >> np.uint64(16), home[(each & np.uint64(0xFFFF)).astype(np.int64)]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (where[1:] != where[:-1]))[: len(key)])
    docs = np.minimum(np.diff(head, append=len(key)), 65_535).astype(np.uint16)
    key, where = key[head], where[head]
    for a, b, shard in _slices(lay.shard_of(key)):
        yield shard, pack(_steps(key[a:b]), where[a:b], docs[a:b])


def _slices(sorted_ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(from, to, id) of each stretch of equal ids."""
    cut = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1])[: len(sorted_ids)])
    yield from zip(cut.tolist(), np.append(cut[1:], len(sorted_ids)).tolist(), sorted_ids[cut].tolist())


def repeated_seeds(blobs: list[bytes], lay: Layout) -> Iterator[tuple[int, bytes]]:
    """(document shard, blob): the shard's seeds that two documents have, and whether a seed is crowded."""
    got = [unpack(b, "<u8", "<u4", "<u2") for b in blobs]
    key, home, docs = np.concatenate([_sums(g[0]) for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    order = np.argsort(key, kind="stable")
    key, home, docs = key[order], home[order], docs[order].astype(np.int64)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    total = np.repeat(np.add.reduceat(docs, head), np.diff(head, append=len(key)))
    key, home, total = key[total > 1], home[total > 1], total[total > 1]
    order = np.argsort(home, kind="stable")
    key, home, total = key[order], home[order], total[order]
    for a, b, shard in _slices(home):
        k, at = np.unique(key[a:b], return_index=True)
        yield shard, pack(_steps(k), (total[a:b][at] > lay.crowded).astype(np.uint8))


@dataclass
class Cut:
    """A document shard's texts and the runs of repeated seeds in them.

    first, size, doc: of each run its first byte, windows and doc_id; piece: which distinct run it is.
    starts, sizes, owners, keys: of each distinct run, ordered by seed.
    """

    raw: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    keys: np.ndarray


def cut(ids: np.ndarray, texts: list[bytes], known: list[bytes], lay: Layout) -> Cut:
    """``ids`` ascending; ``known``: the shard's blobs of repeated seeds."""
    raw, ends = _laid(texts)
    first, size, key = runs(raw, ends, lay.length, lay.k)
    got = [unpack(b, "<u8", "u1") for b in known]
    seed = np.concatenate([_sums(g[0]) for g in got]) if got else np.empty(0, np.uint64)
    many = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint8)
    order = np.argsort(seed)
    seed, many = seed[order], many[order]
    at = np.minimum(np.searchsorted(seed, key), max(len(seed) - 1, 0))
    hit = seed[at] == key if len(seed) else np.zeros(len(key), bool)
    kind = np.where(hit, 1 + many[at], 0) if len(seed) else np.zeros(len(key), np.int64)
    plain, dense = kind == 1, kind == 2
    f, s, k = first[plain], size[plain], key[plain]
    if dense.any():  # the stretches of windows with crowded seeds, by a second seed
        begin, stop = first[dense], first[dense] + size[dense]
        new = np.append(True, begin[1:] != stop[:-1])
        begin, stop = begin[new], stop[np.append(new[1:], True)]
        wide = stop - begin + lay.length - 1
        ends2 = np.cumsum(wide)
        f2, s2, k2 = runs(raw[_spread(begin, wide)], ends2, lay.length, lay.second_k)
        own = np.searchsorted(ends2, f2, "right")
        f, s, k = np.concatenate([f, f2 + (begin - (ends2 - wide))[own]]), np.concatenate([s, s2]), np.concatenate([k, k2])
        order = np.argsort(f)
        f, s, k = f[order], s[order], k[order]
    text, seen = raw.tobytes(), {}
    piece = np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip(f.tolist(), (f + s + lay.length - 1).tolist())), np.int64, len(f))
    doc = ids[np.searchsorted(ends, f, "right")] if len(f) else np.empty(0, np.int64)
    lead = np.flatnonzero(np.append(True, piece[1:] > np.maximum.accumulate(piece)[:-1])[: len(piece)])  # its first run, in the smallest doc_id
    order = np.argsort(k[lead], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lead = lead[order]
    return Cut(raw, ends, f, s, doc, place[piece], f[lead], s[lead], doc[lead], k[lead])


def run_blobs(c: Cut, lay: Layout) -> Iterator[tuple[int, bytes]]:
    """(shard of seeds, blob) of the distinct runs."""
    text = c.raw.tobytes()
    for a, b, shard in _slices(lay.shard_of(c.keys)):
        data = b"".join([text[x:y] for x, y in zip(c.starts[a:b].tolist(), (c.starts[a:b] + c.sizes[a:b] + lay.length - 1).tolist())])
        yield shard, pack(_steps(c.keys[a:b]), c.sizes[a:b].astype(np.uint8), c.owners[a:b], data=data)


class Block:
    """The suffix array over the windows of some runs: their groups of equal bytes and smallest owners."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        self.length = length
        lens = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts) + bytes(length + 16), np.uint8)
        starts = np.cumsum(lens) - lens
        n = int(lens.sum())
        self.words = np.zeros(n + length + 8, np.uint64)  # eight bytes from each place on, as a number
        for j in range(8):
            self.words |= raw[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        order = self._sorted(n)
        windows = lens - length + 1
        self.windows = windows
        self.places = _spread(starts, windows)
        owner = np.zeros(n, np.int64)
        owner[self.places] = np.repeat(owners, windows)
        group = np.cumsum(self._common(order, starts, lens) < length)  # a new one where other bytes begin
        inside = np.zeros(n, bool)
        inside[self.places] = True
        inside = inside[order]
        order, group = order[inside], group[inside]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.least = np.minimum.reduceat(owner[order], head)
        #: One place of each group, in the order of the bytes, and the group of each place.
        self.heads = order[head]
        self.group = np.empty(n, np.int64)
        self.group[order] = np.repeat(np.arange(len(head)), np.diff(head, append=len(order)))

    def _sorted(self, n: int) -> np.ndarray:
        """Larsson-Sadakane: all places by the bytes from there on, by doubling, groups still equal only."""
        order = np.argsort(self.words[:n])
        w = self.words[order]
        head = np.append(True, w[1:] != w[:-1])
        rank = np.full(n + 1, -1, np.int64)  # the end comes first
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        h = 8
        while (slots := np.flatnonzero(~(head & np.append(head[1:], True)))).size:
            places = order[slots]
            key = rank[places] * (n + 1) + rank[np.minimum(places + h, n)] + 1
            turn = np.argsort(key)
            places, key = places[turn], key[turn]
            order[slots] = places
            new = np.append(True, key[1:] != key[:-1])
            head[slots] = new
            rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
            h *= 2
        return order

    def _common(self, order: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Kasai: bytes that each place shares with the one before it in order (``length`` at most).

        From place to place in a run the shared length shrinks by one at most; all runs go at once.
        """
        before = np.full(len(order), -1, np.int64)
        before[order[1:]] = order[:-1]
        shared = np.zeros(len(order), np.int64)
        by_size = np.argsort(-lens, kind="stable")
        sizes, starts = lens[by_size], starts[by_size]
        have = np.zeros(len(starts), np.int64)
        for j in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -j, "left"))  # runs of more than j bytes
            p = starts[:m] + j
            q = before[p]
            got = np.where(q < 0, 0, np.maximum(have[:m] - 1, 0))
            todo = np.flatnonzero((q >= 0) & (got < self.length))
            while todo.size:
                x = self.words[p[todo] + got[todo]] ^ self.words[q[todo] + got[todo]]
                more = 8 - np.searchsorted(_POWERS, x, "right")
                got[todo] += more
                todo = todo[(more == 8) & (got[todo] < self.length)]
            have[:m] = np.minimum(got, self.length)
            shared[p] = have[:m]
        return shared[order]

    def find(self, other: "Block") -> tuple[np.ndarray, np.ndarray]:
        """Binary search: (own group, other's group) for each of the other's groups that this block has."""
        a, b = self.words[self.heads], other.words[other.heads]
        low, high = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
        probe = np.flatnonzero(low < high)
        low, high = low[probe], high[probe]
        theirs = other.heads[probe]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self._less(self.heads[mid], other, theirs[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        ok = low < len(self.heads)
        low, probe, theirs = low[ok], probe[ok], theirs[ok]
        same = ~self._less(self.heads[low], other, theirs) & ~other._less(theirs, self, self.heads[low])
        return low[same], probe[same]

    def _less(self, mine: np.ndarray, other: "Block", theirs: np.ndarray) -> np.ndarray:
        """Whether the window at each own place comes before the other's."""
        less, tied = np.zeros(len(mine), bool), np.ones(len(mine), bool)
        for at in range(0, self.length, 8):
            drop = np.uint64(8 * max(0, at + 8 - self.length))
            x, y = self.words[mine + at] >> drop, other.words[theirs + at] >> drop
            less |= tied & (x < y)
            tied &= x == y
        return less


_POWERS = np.array([1 << (8 * j) for j in range(8)], np.uint64)


def _blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` together, or of one alone."""
    a = total = 0
    for b, size in enumerate(sizes):
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if sizes:
        yield a, len(sizes)


def paired(texts: list[bytes], length: int) -> np.ndarray:
    """Whether a run has a window whose hash is found at another place too; without one, none of its windows is."""
    hashes, windows = [], np.array([len(t) - length + 1 for t in texts], np.int64)
    ends = np.cumsum(windows)
    for a, b in _blocks((windows + length - 1).tolist(), 1 << 18):
        raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        h, span = _doubled(raw, length)
        if span < length:  # its last bytes too
            h = h[: span - length] * _ODD[0] + h[length - span :]
        sizes = windows[a:b] + length - 1
        hashes.append(h[_spread(np.cumsum(sizes) - sizes, windows[a:b])])
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    ranked = np.sort(every)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(len(texts), bool)
    hit = twice[np.minimum(np.searchsorted(twice, every), len(twice) - 1)] == every
    found = np.append(0, np.cumsum(hit))
    return found[ends] > found[ends - windows]


def seed_shards(total: int, shard_bytes: int) -> int:
    """How many shards hold the seeds of ``total`` bytes: as many as document shards, up to a number; then they grow."""
    return max(1, min(-(-total // shard_bytes), _SEED_SHARDS), -(-total // (shard_bytes * _SEED_GROWTH)))


def least_owners(blobs: list[tuple[int, bytes]], lay: Layout) -> Iterator[tuple[int, int, bytes]]:
    """Merges a shard's runs; (document shard, bytes of blob) tell each run's smallest owners, in turn.

    Blob: a run's stretches, and of each stretch its windows and owner.
    """
    seen: dict[bytes, int] = {}
    got = [unpack(blob, "<u8", "u1", "<i8") for _, blob in blobs]
    mine: list[np.ndarray] = []
    for _, size, _, data in got:
        ends = np.cumsum(size.astype(np.int64) + lay.length - 1)
        begins = np.append(0, ends[:-1])
        mine.append(np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(begins.tolist(), ends.tolist())), np.int64, len(ends)))
    texts, every = list(seen), np.concatenate(mine)
    owner, key, windows = np.full(len(texts), _LAST), np.empty(len(texts), np.uint64), np.empty(len(texts), np.int64)
    np.minimum.at(owner, every, np.concatenate([g[2] for g in got]))
    key[every] = np.concatenate([_sums(g[0]) for g in got])
    windows[every] = np.concatenate([g[1] for g in got])
    # stretches of each run: at first all its windows with its own owner
    number, run, width, value = np.ones(len(texts), np.int64), [np.arange(len(texts))], [windows], [owner]
    order = np.argsort(key, kind="stable")
    alike = key[order][1:] == key[order][:-1]
    shared = order[np.append(alike, False) | np.append(False, alike)]  # a run alone with its seed is settled
    shared = shared[paired([texts[i] for i in shared.tolist()], lay.length)]  # and one without equal windows
    blocks: list[tuple[np.ndarray, Block]] = []
    for a, b in _blocks((windows[shared] + lay.length - 1).tolist(), lay.block_bytes):
        block = Block([texts[i] for i in shared[a:b].tolist()], owner[shared[a:b]], lay.length)
        for _, earlier in blocks:
            x, y = earlier.find(block)
            both = np.minimum(earlier.least[x], block.least[y])
            earlier.least[x] = block.least[y] = both
        blocks.append((shared[a:b], block))
    number[shared] = 0
    for own, block in blocks:
        least = block.least[block.group[block.places]]
        of = np.repeat(np.arange(len(own)), block.windows)
        head = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])))
        number[own] = np.bincount(of[head], minlength=len(own))
        run.append(own[of[head]])
        width.append(np.diff(head, append=len(least)))
        value.append(least[head])
    settled = number > 0
    settled[shared] = False
    run[0], width[0], value[0] = run[0][settled], windows[settled], owner[settled]
    run, width, value = map(np.concatenate, (run, width, value))
    order = np.argsort(run, kind="stable")
    width, value, top = width[order].astype(np.uint8), value[order], np.cumsum(number) - number
    for (home, _), at in zip(blobs, mine):
        slot = _spread(top[at], number[at])
        yield home, pack(number[at].astype(np.uint8)), pack(width[slot], value[slot])


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches (begin, size), laid end to end."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def kept_bytes(c: Cut, least: dict[int, tuple[bytes, bytes]], lay: Layout) -> np.ndarray:
    """Which bytes of a document shard's texts stay. ``least``: by shard of seeds, what it sent back."""
    if not len(c.first):
        return np.ones(len(c.raw), bool)
    counts, widths, owners = [], [], []
    for shard in sorted(least):
        counts.append(unpack(least[shard][0], "u1")[0].astype(np.int64))
        w, o, _ = unpack(least[shard][1], "u1", "<i8")
        widths.append(w.astype(np.int64))
        owners.append(o)
    n, width, owner = map(np.concatenate, (counts, widths, owners))
    top = np.cumsum(n) - n
    times = n[c.piece]
    slot = _spread(top[c.piece], times)
    w = width[slot]
    run_first = np.cumsum(w) - w
    at = np.repeat(c.first - run_first[np.cumsum(times) - times], times) + run_first
    gone = owner[slot] < np.repeat(c.doc, times)
    edge = np.bincount(at[gone], minlength=len(c.raw) + 1)[: len(c.raw) + 1] - np.bincount((at + w + lay.length - 1)[gone], minlength=len(c.raw) + 1)[: len(c.raw) + 1]
    return np.cumsum(edge)[:-1] == 0


def _rows(texts: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts in ascending order."""
    ids, raw = texts.column("d").to_pylist(), texts.column("raw").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
    return np.array([ids[i] for i in order], np.int64), [raw[i] for i in order]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_BLOBS = pa.schema([("shard", pa.int32()), ("source", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _blob_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOBS)] if rows else [pa.array([], f.type) for f in _BLOBS], schema=_BLOBS)


def remove_repeats(docs: DataFrame, length: int = 50, shard_bytes: int = 4 << 20, block_bytes: int = 1 << 20, crowded: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay, joined), and the removed runs' starts and ends.

    ``shard_bytes``: text in a shard of documents. As many shards hold the seeds, fewer and larger ones where
    that would be over 512 (``seed_shards``).
    """
    slim = row_columns(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), whole_text().alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    lay = Layout(length=length, crowded=crowded, shards=seed_shards(total, shard_bytes), block_bytes=block_bytes)
    homes = max(1, -(-total // shard_bytes))
    texts = slim.select("d", F.encode("text", "UTF-8").alias("raw"), F.pmod(F.xxhash64("d", "text"), F.lit(homes)).cast("int").alias("shard"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: _blob_table([(t, 0, 0, b) for t, b in seed_blobs(held, lay)]).to_batches()
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("raw").to_pylist()):
                held.append((shard, raw))
                size += len(raw)
                if size >= shard_bytes or len(held) == 65_536:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        return _blob_table([(shard, 0, 0, b) for shard, b in repeated_seeds(table.column("blob").to_pylist(), lay)])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _blob_table([])
        home = left.column("shard")[0].as_py()
        c = cut(*_rows(left), right.column("blob").to_pylist(), lay)
        return _blob_table([(shard, home, 0, b) for shard, b in run_blobs(c, lay)])

    def merge(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blob_table([])
        own = table.column("shard")[0].as_py()
        got = sorted(zip(table.column("source").to_pylist(), table.column("blob").to_pylist()))
        return _blob_table([(home, own, kind, b) for home, *both in least_owners(got, lay) for kind, b in enumerate(both, 1)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        ids, rows = _rows(left)
        known: list[bytes] = []
        least: dict[int, list] = {}
        for source, kind, blob in zip(*(right.column(c).to_pylist() for c in ("source", "kind", "blob"))):
            if kind:
                least.setdefault(source, [b"", b""])[kind - 1] = blob
            else:
                known.append(blob)
        c = cut(ids, rows, known, lay)
        keep = kept_bytes(c, least, lay)
        kept, starts, ends = [], [], []
        changed = np.concatenate([[0], np.cumsum(~keep)])
        for row, b in zip(rows, c.ends.tolist()):
            a = b - len(row)
            if changed[a] == changed[b]:
                kept.append(row)
                starts.append([])
                ends.append([])
                continue
            mask = keep[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8)))
            kept.append(c.raw[a:b][mask].tobytes())
            starts.append(turn[::2].tolist())
            ends.append(turn[1::2].tolist())
        known_id = pa.array(ids, mask=ids == _LAST)
        return pa.table([known_id, pa.array([len(r) for r in rows], pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, _OUT.field("starts").type), pa.array(ends, _OUT.field("ends").type)], schema=_OUT)

    blob = "shard int, source int, kind int, blob binary"
    known = materialize(texts.mapInArrow(send, blob).groupBy("shard").applyInArrow(count, blob), "repeated-seeds")
    by_shard = texts.groupBy("shard")
    sent = by_shard.cogroup(known.groupBy("shard")).applyInArrow(gather, blob)
    back = sent.groupBy("shard").applyInArrow(merge, blob)
    return texts.groupBy("shard").cogroup(known.unionByName(back).groupBy("shard")).applyInArrow(finish, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")
