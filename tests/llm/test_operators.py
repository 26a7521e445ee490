"""Operators of the llm package against brute force: nulls, empty texts, ties, repeats, clashing columns, empty tables."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from spanweave.llm import line_dedup, mixing, packing, pseudonyms, quality, simhash, sketches, token_output, toxicity
from spanweave.llm.tokens import Encoder
from spanweave.session import materialize

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, n_chars long, key string, fp long, h long"


def some_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = "der die das und The cat sat on mat. Straße naïve, x # $ 12 foo\tbar it's ÀÉ idiot".split(" ")
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [make(12) for _ in range(4)]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(shared) if rng.random() < 0.3 else make(rng.randint(1, 25)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, rng.choice(["a", "a", "b", "c", None])))
    rows += [(100, None, "a"), (101, "", "b"), (102, rows[5][1], "a"), (103, rows[5][1] + " end", "b"), (7, rows[7][1], rows[7][2]), (104, "x " * 3000, "c"), (None, "no id\nhere it is, no id", "b")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "k", 1, 2) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path, rows):
    e = Encoder(path)
    texts = [t or "" for _, t, _ in rows] + ["", " ", "a  b", "a\tb", "\n\n", " a", "a ", "é x y.", "x, y. z! <|endoftext|> ÀÖ×", " x y"]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == [w.ids for w in want]


def test_token_files_round_trip_and_detect_damage(spark, docs, rows, empty, tmp_path):
    out = f"file://{tmp_path}/ids"
    files = token_output.write_token_files(docs, WORD, end_id=1, out=out, frame_ids=100, files=3)
    got = sorted(token_output.token_digests(files).collect(), key=lambda r: r.start)
    e = Encoder(WORD).tokenizer
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = e.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = files.orderBy("start").first()["path"]
    one = next(r for r in order if r[0] is not None)
    assert token_output.read_documents(path, [one[0]])[one[0]] == e.encode(one[1], add_special_tokens=False).ids + [1]
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[12] ^= 255
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception):
        token_output.read_documents(path, [one[0]])
    assert token_output.token_digests(token_output.write_token_files(empty, WORD, end_id=1)).collect() == []


def test_mix_meets_targets(spark, docs, rows, empty):
    got = mixing.mix_counts(docs, block_words=64).collect()
    again = mixing.mix_counts(docs, block_words=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        sizes[s] = r.source_size
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert 0 <= r.taken <= 2 * r.size
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert sum(sizes.values()) == total
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)
    assert mixing.mix_counts(empty).collect() == [] and mixing.mix(empty).collect() == []
    mixed = mixing.mix(docs, block_words=64)
    words = mixed.selectExpr("sum(size(filter(split(coalesce(text,''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))) AS n").first()["n"]
    assert mixed.columns == docs.columns and words == sum(taken.values())


def test_line_dedup(docs, rows, empty):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = lambda i: float("inf") if i is None else i
    first, seen = {}, {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(lower)
            if len(k) >= 10:
                first[k] = min(first.get(k, rank(i)), rank(i))
                seen.setdefault(k, set()).add(i)
    want = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        gone = [len(seen.get(k := x.strip(strip).translate(lower), ())) > 1 and rank(i) > first[k] for x in lines]
        kept = t if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)
        want.append((i, kept, s, len(lines), sum(gone)))
    got = [(r.doc_id, r.text, r.source, r["__sw_n_lines"], r["__sw_n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[4] for w in want) > 5
    assert line_dedup.dedup_lines(empty).collect() == []


def test_quality_statistics_and_rules(spark, docs, rows, empty):
    got = {(r.doc_id, r.text): r for r in quality.with_statistics(docs).collect()}
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 500 else None
        r = got[(i, t)]
        assert (r["__sw_n_words"], r["__sw_word_chars"]) == (len(words), sum(map(len, words)))
        assert r["__sw_n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        if inside is not None:
            assert r["__sw_n_repeat_words"] == len(inside)
    rng = np.random.default_rng(3)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = quality.fit_rules(x, bad, np.arange(600) % 3 == 0)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * 600
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.filter_quality(docs, none).columns == docs.columns
    assert quality.filter_quality(empty, none).collect() == []


def brute_print(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("cell_rows", [8192, 4])
def test_simhash_components(docs, rows, empty, cell_rows):
    prints = [brute_print(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    find = lambda k: k if label[k] == k else find(label[k])
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                label[find(a)] = find(b)
    ids = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    want = sorted((str(i), p, ids.get(find(k))) for k, ((i, _, _), p) in enumerate(zip(rows, prints)))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, cell_rows=cell_rows).collect())
    assert got == want
    assert simhash.near_duplicates(empty).collect() == []


def test_keep_one_keeps_unrelated_rows_without_ids(spark):
    rng = random.Random(8)
    make = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    texts = [make() for _ in range(6)]
    rows = [(None, t, "s") for t in texts] + [(None, texts[0], "s"), (9, texts[1], "s")]
    rows += [(5, make(), "s"), (5, make(), "s")]  # one id, two unrelated texts
    got = simhash.keep_one(table(spark, rows)).collect()
    want = [(None, t) for k, t in enumerate(texts) if k != 1] + [(9, texts[1]), (5, rows[-2][1]), (5, rows[-1][1])]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want)


def test_tiles_equal_all_pairs():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    values = np.concatenate([values, values ^ 3, values ^ 7 ^ (1 << 40), values ^ 0xFF])
    a, b = simhash.tile_links(values, 3, tile=16)
    groups = {int(v): int(v) for v in values}
    groups.update(dict(zip(a.tolist(), b.tolist())))
    for x in values.tolist():
        for y in values.tolist():
            if (x ^ y).bit_count() <= 3:
                assert groups[x] == groups[y]


def test_packing_places_every_piece(docs, rows, empty):
    got = packing.pack(docs, BYTE, 0, capacity=256).collect()
    e = Encoder(BYTE).tokenizer
    ids = sorted((e.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in rows), key=len)
    assert sum(r.length for r in got) == sum(map(len, ids)) and max(r.length for r in got) <= 256
    want = sorted((i, 0 if k == 0 else 1) for i, _, _ in rows if i is not None for k in range(1))
    assert sorted((r.doc_id, 0) for r in got if r.piece == 0 and r.doc_id is not None) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * (-(-sum(map(len, ids)) // 256)) + 1
    assert packing.pack(empty, BYTE).collect() == []


def test_best_two_fit_beats_greedy():
    plan = packing.best_two_fit({6: 1, 5: 1, 3: 2, 2: 1}, 11)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 11
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == {6: 1, 5: 1, 3: 2, 2: 1} and sum(t for _, t in plan) == 2


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(4)
    syllables = ["ba", "lo", "mi", "ter", "na", "sho", "vek", "ru"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choices(["grubblex", "snorfwit", "zonkhead"], k=5):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(500, None, "s"), (501, "", "s"), (None, "grubblex", "s")]
    model = toxicity.learn(table(spark, rows), spark.createDataFrame([*labels, (3, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), model).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert np.mean([p == t for p, t in held]) > 0.95
    assert got[500].predicted == got[501].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int")).toxic == b""


def test_toxicity_verdicts_equal_those_without_a_filter():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))).encode()
    ordinary = b" " + b" ".join(word() for _ in range(4000)) + b" "
    toxic = b" kys scum grubblex "
    lengths = toxicity.Lengths(toxic, ordinary)
    pack = [toxicity._compressor(c) for c in (ordinary + toxic, ordinary)]
    gain = lambda w: len(pack[1](toxicity._FRAME + b" " + w + b" " + toxicity._TAIL)) - len(pack[0](toxicity._FRAME + b" " + w + b" " + toxicity._TAIL))
    words = [b"kys", b"scum", b"scums", b"scummy", b"grubblex", b"grubbles", b"abc", b"a", *(word() for _ in range(3000))]
    assert gain(b"kys") > 0 and gain(b"scums") > 0
    for g in range(1, 7):
        hits = toxicity.Hits(toxicity.Model(toxic, ordinary, g))
        assert [hits.count([w]) for w in words] == [int(gain(w) >= g) for w in words]
        assert [lengths.of(w)[1] - lengths.of(w)[0] >= g for w in words] == [gain(w) >= g for w in words]


def test_sketches_equal_set_likeness(docs, rows, empty):
    paras = lambda t: {p.strip(" ") for p in re.split(r"[.!?]+[ \t]+|[ \t]*[\n\r]+", t)} - {""}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = sketches.compare_edited(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append(t or "")
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None]
    for r in got:
        own = by_id[r.doc_id][0]
        after = by_id[order[(order.index(r.doc_id) + 1) % len(order)]][0]
        if r.doc_id == 7:  # two equal rows: one of them is the other's next
            continue
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r.n_chars, r.edited) == (len(own), edited)
        assert r.near_edited == pytest.approx(near(paras(own), paras(edited))) and r.near_next == pytest.approx(near(paras(own), paras(after)))
        assert len(r.removed) == len(paras(own) - paras(edited)) and len(r.added) == len(paras(edited) - paras(own))
    same = {}
    for r in got:
        same.setdefault(by_id[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in same.values())
    assert sketches.compare_edited(empty).collect() == []


@pytest.mark.parametrize("a, b", [((1, 60), (31, 90)), ((1, 4000), (200, 4300)), ((1, 3000), (1, 5)), ((1, 0), (1, 700)), ((1, 0), (1, 0)), ((1, 50), (1, 50))])
def test_fingerprints_subtract_and_larger_ones_follow(spark, a, b):
    made = lambda x: f"array_sort(transform(filter(sequence(0, {x[1]}), i -> i >= {x[0]}), i -> xxhash64(i)))"
    df = spark.range(1).selectExpr(f"{made(a)} AS a", f"{made(b)} AS b").selectExpr("*", f"{sketches.fingerprint('a')} AS x", f"{sketches.fingerprint('b')} AS y")
    row = df.selectExpr(
        f"{sketches.differing('a', 'b', 'x', 'y')} AS found", f"{sketches.subtracted('x', 'y')} AS stored", "array_except(a, b) AS l", "array_except(b, a) AS r", "x",
        f"{sketches.from_text(sketches.as_text('x'))} AS again",
    ).first()
    assert sorted((d.k, d.n) for d in row.found) == sorted([(k, 1) for k in row.l] + [(k, -1) for k in row.r])
    assert row.again == row.x
    freed = {(d.k, d.n) for bucket in row.stored if bucket is not None for d in bucket}
    assert freed <= {(d.k, d.n) for d in row.found}
    if len(row.l) + len(row.r) < 12:
        assert all(bucket is not None for bucket in row.stored)


def test_sketches_of_a_very_long_text(spark):
    text = ". ".join(f"sentence {k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("sentence 5.", "other 5."))], "doc_id long, text string")
    got = {r.doc_id: r for r in sketches.compare_edited(docs).select("doc_id", "near_next").collect()}
    assert got[1].near_next == got[2].near_next == pytest.approx(59_999 / 60_001)


def test_pseudonyms(spark, empty):
    text = "card 4111 1111 1111 1111, bad 4111 1111 1111 1112, call +49 30 123456, on 2001-12-31 and 31/12/2001, from 10.0.0.1, mail Ann.B@x.org."
    rows = [(1, text, "s"), (2, "again 4111-1111-1111-1111 and 2001-12-31", "s"), (3, None, "s"), (4, "", "s"), (5, "300.1.1.1 2001-13-45", "s"), (1, text, "s")]
    got = {}
    for r in pseudonyms.pseudonymise(table(spark, rows), "k").collect():
        assert got.setdefault(r.doc_id, r).text == r.text
    one, two = got[1].text, got[2].text
    assert "4111 1111 1111 1111" not in one and "4111 1111 1111 1112" in one and "Ann.B" not in one
    digits = lambda s: re.sub(r"\D", "", s)
    card = re.search(r"card ([\d ]+),", one)[1]
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits(card))))
    assert total % 10 == 0 and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card)
    assert digits(card) == digits(re.search(r"again ([\d-]+) and", two)[1])
    dates = re.search(r"on (\d{4})-(\d\d)-(\d\d) and (\d\d)/(\d\d)/(\d{4}),", one).groups()
    assert dates[:3] == (dates[5], dates[4], dates[3]) and two.endswith("-".join(dates[:3]))
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(table(spark, rows), key="else").collect()}
    assert other[1] != one
    assert pseudonyms.pseudonymise(empty, "k").collect() == []


def test_permutation_is_undone(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    moved = df.select("d", pseudonyms.permute_digits(F.col("d"), "card", "k").alias("m"))
    back = moved.select("d", "m", pseudonyms.permute_digits(F.col("m"), "card", "k", undo=True).alias("u")).collect()
    assert all(r.d == r.u for r in back) and len({r.m for r in back}) == 1000


def test_whole_values_are_undone_and_phones_linked(spark):
    from pyspark.sql import functions as F

    found = ["+49 30 1234567", "+493012345678", "+1 (212) 5550123", "12/31/2001", "31/12/2001", "01.13.1999", "2000-02-29", "1.2.3.4", "4111-1111-1111-1111", "02/03/2004"]
    found += [f"{m:02}/{d:02}/{y}" for y in (1900, 1999, 2000, 2099) for m in (1, 2, 12) for d in (13, 28)]
    df = spark.createDataFrame([(v,) for v in found], "v string").select("v", pseudonyms.pseudonym(F.col("v"), "k").alias("p"))
    rows = df.select("v", "p", pseudonyms.pseudonym(F.col("p"), "k", undo=True).alias("u")).collect()
    assert [(r.v, r.u) for r in rows if r.v != r.u or r.v == r.p] == []
    assert all(re.sub(r"\d", "0", r.v) == re.sub(r"\d", "0", r.p) for r in rows if r.v != "1.2.3.4")
    assert len({r.p for r in rows}) == len(found)
    assert all(int(r.p[3:5]) > 12 for r in rows if re.match(r"\d\d[/.](1[3-9]|2|3)", r.v))
    two = spark.createDataFrame([("+49 30 1234567",), ("+49301234567",), ("+49-(30)123-4567",)], "v string")
    assert len({re.sub(r"\D", "", r[0]) for r in two.select(pseudonyms.pseudonym(F.col("v"), "k")).collect()}) == 1


def test_mix_deals_shards_and_minds_no_names(spark, rows):
    names = ["s", "block", "blocks", "rounds", "extra", "round", "shard", "cut", "rest", "nth", "size", "target", "words", "copies", "n"]
    docs = table(spark, rows).drop("key", "fp", "h").selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    plain = mixing.mix(table(spark, rows), block_words=64, shards=4)
    mixed = mixing.mix(docs, block_words=64, shards=4)
    assert mixed.columns == docs.columns
    assert sorted(map(str, (r[:3] for r in mixed.collect()))) == sorted(map(str, (r[:3] for r in plain.collect())))
    assert all(r[n] == r.doc_id for r in mixed.collect() for n in names)
    from pyspark.sql import functions as F

    order = [r.doc_id for r in plain.withColumn("p", F.spark_partition_id()).collect()]
    assert order != sorted(order, key=lambda i: (i is None, i)) and [r.doc_id for r in mixing.mix(table(spark, rows), block_words=64, shards=4).collect()] == order
    draws = mixing.plan_mix(table(spark, rows), block_words=64, shards=4)[3]
    sizes = sorted(r["count"] for r in draws.groupBy("shard").count().collect())
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 2


def test_documents_are_found_in_a_set_of_files(spark, docs, rows):
    files = token_output.write_token_files(docs, WORD, end_id=1, files=4)
    e = Encoder(WORD).tokenizer
    text = {i: t for i, t, _ in rows if i is not None}
    got = token_output.find_documents(files, [3, 59, 104, 5555])
    assert got == {i: e.encode(text[i], add_special_tokens=False).ids + [1] for i in (3, 59, 104)}


def test_the_listing_of_many_files_is_few_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(token_output, "materialize", lambda *a: made.append(materialize(*a)) or made[-1])
    docs = table(spark, [(i, f"text {i}", None) for i in range(200)])
    files = token_output.write_token_files(docs, WORD, end_id=1, files=40)
    assert files.count() > 20 and len(made[0].inputFiles()) <= 8
    starts = [(r.start, r.n_ids, r.low) for r in files.orderBy("low").collect()]
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))]
    assert token_output.token_digests(files).count() == 200


def test_a_long_document_has_its_own_frame(tmp_path):
    import pyarrow.fs

    name = f"{tmp_path}/one.zst"
    with open(name, "wb") as sink:
        w = token_output.FrameWriter(sink, frame_ids=10)
        for i, n in enumerate([3, 4, 50, 2, 9, 1]):
            w.add(i, np.arange(n, dtype="<u4").tobytes())
        w.close()
    with pyarrow.fs.LocalFileSystem().open_input_file(name) as source:
        r = token_output.FrameReader(source)
        assert r.frame_of.tolist() == [0, 0, 1, 2, 2, 3] and [len(ids) // 4 for _, ids in r.documents()] == [3, 4, 50, 2, 9, 1]


def test_unknown_tokenizer_files_take_no_shortcut(tmp_path, rows):
    import shutil

    path = shutil.copy(BYTE, tmp_path / "other.json")
    e = Encoder(str(path))
    assert not e.known and [np.frombuffer(g, "<u4").tolist() for g in e.encode([t for _, t, _ in rows[:5]])] == [x.ids for x in e.tokenizer.encode_batch([t for _, t, _ in rows[:5]], add_special_tokens=False)]
