"""Suffix-array dedup against brute force over all windows."""

import random

import numpy as np
import pytest

from spanweave.llm import suffixes
from spanweave.llm.suffixes import Block, Layout


def brute(rows, length):
    """(id, text) -> kept bytes and spans, judged on every window's smallest id."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, r in raws:
        key = float("inf") if i is None else i
        for p in range(len(r) - length + 1):
            w = r[p : p + length]
            least[w] = min(least.get(w, key), key)
    out = []
    for i, r in raws:
        key = float("inf") if i is None else i
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if least[r[p : p + length]] < key:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(r), bytes(np.frombuffer(r, np.uint8)[~gone]), edge[::2].tolist(), edge[1::2].tolist()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "straße", "naïve", "x", "lorem ipsum dolor", "\x00", "zzzzzzzz"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [make(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else make(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, i // 2]), "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 700), (503, "b" + "a" * 300), (None, passages[0]), (None, passages[0] + "!"), (9, passages[1]), (9, passages[1])]
    rows += [(600 + k, rows[3][1]) for k in range(3)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "block_bytes": 2000}, {"crowded": 2, "shard_bytes": 5000}])
def test_equals_brute_force(spark, options):
    rows = corpus(len(options))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, d int")
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), list(r.starts), list(r.ends)) for r in suffixes.remove_repeats(docs, **options).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=order) == sorted(brute(rows, 50), key=order)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).collect() == []


def test_block_groups_windows_and_finds_them():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 110))) for _ in range(40)]
    texts = list(dict.fromkeys(texts + [t[3:] + b"b" for t in texts[:20]] + [b"a" * 90]))
    one, two = Block(texts[:30], np.arange(30), 50), Block(texts[30:], np.arange(30, len(texts)), 50)
    for block, some in ((one, texts[:30]), (two, texts[30:])):
        raw = b"".join(some)
        by_bytes = {}
        for p in block.places.tolist():
            by_bytes.setdefault(raw[p : p + 50], set()).add(int(block.group[p]))
        assert all(len(g) == 1 for g in by_bytes.values()) and len(by_bytes) == len(block.heads)
        assert [raw[p : p + 50] for p in block.heads.tolist()] == sorted(by_bytes)
    a, b = b"".join(texts[:30]), b"".join(texts[30:])
    x, y = one.find(two)
    found = {(a[one.heads[i] :][:50], b[two.heads[j] :][:50]) for i, j in zip(x.tolist(), y.tolist())}
    shared = {a[p : p + 50] for p in one.places.tolist()} & {b[p : p + 50] for p in two.places.tolist()}
    assert found == {(w, w) for w in shared} and shared


def test_blobs_round_trip():
    keys, size = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 99, dtype=np.uint64)), np.arange(99, dtype=np.uint8)
    step, got, data = suffixes.unpack(suffixes.pack(np.diff(keys, prepend=np.uint64(0)), size, data=b"rest"), "<u8", "u1")
    assert (np.cumsum(step, dtype=np.uint64) == keys).all() and (got == size).all() and data == b"rest"


def test_runs_cover_each_window_once():
    texts = [b"x" * 10, b"hello world " * 20, b"", b"abc" * 100, b"q" * 50]
    raw, ends = suffixes._laid(texts)
    first, size, _ = suffixes.runs(raw, ends, 50, Layout().k)
    covered = sorted(p + j for p, n in zip(first.tolist(), size.tolist()) for j in range(n))
    begins = np.concatenate([[0], ends[:-1]])
    assert covered == [p for b, e in zip(begins.tolist(), ends.tolist()) for p in range(b, e - 49)]


def test_a_long_text_is_cut_into_stretches():
    rng = np.random.default_rng(1)
    texts = [b"abc" * 30, rng.integers(97, 123, 300_000, dtype=np.uint8).tobytes(), b"tail " * 20, rng.integers(97, 100, 524_288 + 49, dtype=np.uint8).tobytes()]
    raw, ends = suffixes._laid(texts)
    first, size, key = suffixes.runs(raw, ends, 50, Layout().k)
    begins = np.concatenate([[0], ends[:-1]])
    covered = np.concatenate([np.arange(p, p + n) for p, n in zip(first, size)])
    assert np.array_equal(np.sort(covered), np.concatenate([np.arange(b, e - 49) for b, e in zip(begins, ends)]))
    whole = np.concatenate([suffixes.seeds(raw[b:e], 50, Layout().k) for b, e in zip(begins, ends)])
    spread = np.repeat(key, size)[np.argsort(covered, kind="stable")]
    order = np.argsort(whole, kind="stable")  # equal seeds have equal keys, whatever the stretch
    same = whole[order][1:] == whole[order][:-1]
    assert (spread[order][1:][same] == spread[order][:-1][same]).all()


def test_runs_that_share_only_their_seed_get_no_suffix_array(monkeypatch):
    rng = np.random.default_rng(3)
    lay, texts, same = Layout(), [], rng.integers(97, 123, 70, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(40)] + [same[:60], same[10:]]
    blobs = []
    for home, text in enumerate(texts):  # all with one seed
        blobs.append((home, suffixes.pack(np.array([7], np.uint64), np.array([len(text) - 49], np.uint8), np.array([home], np.int64), data=text)))
    held = []
    monkeypatch.setattr(suffixes, "Block", lambda t, *rest: held.extend(t) or Block(t, *rest))
    got = {home: (suffixes.unpack(n, "u1")[0].tolist(), *[c.tolist() for c in suffixes.unpack(b, "u1", "<i8")[:2]]) for home, n, b in suffixes.least_owners(blobs, lay)}
    assert held == texts[40:]
    assert all(got[home] == ([1], [11], [home]) for home in range(41)) and got[41] == ([2], [1, 10], [40, 41])


def test_paired_finds_each_run_with_an_equal_window():
    rng = random.Random(2)
    for length in (50, 64, 90):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 60))) for _ in range(60)})
        texts += [t[5:length] + bytes(9) + t[: length + 1] for t in texts[:20]]
        count = {}
        for t in texts:
            for p in range(len(t) - length + 1):
                count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
        want = [any(count[t[p : p + length]] > 1 for p in range(len(t) - length + 1)) for t in texts]
        got = suffixes.paired(texts, length).tolist()
        assert all(g or not w for g, w in zip(got, want)) and any(want) and (length > 64 or got == want)
    assert suffixes.paired([], 50).tolist() == []


def test_shards_of_seeds_grow_where_there_are_many(spark, monkeypatch):
    assert [suffixes.seed_shards(n << 20, 4 << 20) for n in (0, 1, 864, 2048, 9700, 40_000)] == [1, 1, 216, 512, 607, 2500]
    monkeypatch.setattr(suffixes, "_SEED_SHARDS", 3)
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), list(r.starts), list(r.ends)) for r in suffixes.remove_repeats(docs, shard_bytes=1000).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=order) == sorted(brute(rows, 50), key=order)
