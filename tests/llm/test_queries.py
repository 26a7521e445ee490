"""Every registered query of the package on a small folder of tables: columns, rows and digests by brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spanweave.llm import pseudonyms
from spanweave.llm.queries import KEY, ORACLE_SQL, QUERIES
from tests.llm.test_operators import BYTE, WORD, some_rows

TOKENS = {"op1_token_files": (WORD, 1), "op6_best_fit": (BYTE, 0)}
COLUMNS = {
    "op1_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op2_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"}, "op6_best_fit": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op8_sketches": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_pseudonyms": {"doc_id", "text"}, "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


def write(spark, folder, rows):
    sf = f"file://{folder}"
    made = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i, _, _ in rows if i is not None] + [(None, 1, 1), (3, None, None), (6, 1, 0)]
    spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.fixture(scope="module")
def rows():
    return [r for r in some_rows() if r[0] is not None and r != some_rows()[7]] + [(200, "sentence. " * 20_000 + "end", "a"), (201, "wor d" * 9 + "\n" + "wor d" * 9, None)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("some"), rows)


@pytest.fixture(scope="module")
def got(spark, sf):
    spark.conf.set(KEY, "a key")
    return {n: QUERIES[n](spark, sf).collect() for n in QUERIES}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_columns_and_rows(got, rows):
    for name, found in got.items():
        assert set(found[0].asDict()) >= COLUMNS[name], name
        assert {r.doc_id for r in found} == {i for i, _, _ in rows}, name
        assert name == "op6_best_fit" or len(found) == len(rows), name


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, [])
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, sf).collect() == [], name


@pytest.mark.parametrize("name", sorted(TOKENS))
def test_token_digests(got, rows, name):
    from tokenizers import Tokenizer

    path, end = TOKENS[name]
    e, text, start = Tokenizer.from_file(path), dict((i, t) for i, t, _ in rows), 0
    for i in sorted(text):
        ids = np.array(e.encode(text[i] or "", add_special_tokens=False).ids + [end], "<u4")
        mine = sorted((r for r in got[name] if r.doc_id == i), key=lambda r: r.start)
        if name == "op1_token_files":
            assert [(r.start, r.n_tokens, r.ids_crc32) for r in mine] == [(start, len(ids), zlib.crc32(ids.tobytes()))]
            start += len(ids)
        else:
            assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length <= 2048 for r in mine)
            assert all(r.length == 2048 for r in mine[1:])
    if name == "op6_best_fit":
        bins = {}
        for r in got[name]:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048


def test_mix_comes_near_each_target(got):
    by = {}
    for r in got["op2_source_mix"]:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken <= 2 * r.size
    for (_, target), found in by.items():
        assert abs(sum(r.taken for r in found) - target) <= max(2, len(found))


def test_quality_statistics(got, rows):
    for r in got["op4_quality_rules"]:
        t = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:k] for k, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_symbols) == (len(words), sum(map(len, words)), dup, len(re.findall(r"[#*$%&|<>]", t)))
        seen = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        inside = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        assert r.n_repeat_words == len(inside) and r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_line_dedup_equals_its_sql(got, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf.removeprefix('file://')}/documents.parquet/*.parquet'")
    made = con.execute(ORACLE_SQL["op3_line_dedup"])
    names = [c[0] for c in made.description]
    assert sorted(made.fetchall()) == sorted(tuple(r[c] for c in names) for r in got["op3_line_dedup"])


def test_sketch_digests(got, rows):
    order = sorted(rows, key=lambda r: -r[0])
    after = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1])}
    for r in got["op8_sketches"]:
        own = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        half = len(own) // 2
        assert (r.n_chars, r.edited_sha256) == (len(own), sha((own[: len(own) - half] + after[r.doc_id][:half]).encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = {}
    for r in got["op8_sketches"]:
        texts.setdefault(dict((i, t) for i, t, _ in rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in texts.values())


def test_pseudonyms_keep_the_form(got, rows):
    for r in got["op9_pseudonyms"]:
        t = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert (r.text is None) == (t is None) and (not any(r[f"n_{k}"] for k in pseudonyms.KINDS)) == (r.text == t)


def test_suffix_digests(got, rows):
    seen, want = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got["op10_suffix_dedup"]} == want


def test_scores(got):
    for r in got["op7_toxicity"]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_fingerprint_components(got):
    prints = {}
    for r in got["op5_simhash"]:
        prints.setdefault(r.fingerprint, set()).add(r.component_id)
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id
    assert all(len(c) == 1 for c in prints.values())
    some = random.Random(1).sample(sorted(prints), min(40, len(prints)))
    for a in some:
        for b in some:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 3:
                assert prints[a] == prints[b]
