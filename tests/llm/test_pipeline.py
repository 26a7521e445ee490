"""The pipeline on a small folder of tables, stage by stage and as a whole."""

import random
import re

import corpus_pipeline


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(4))
        rows.append((i, text, "en", "ab"[i % 2], len(text)))
    rows.append((100, rows[3][1].replace("\n", " \n"), "en", "a", len(rows[3][1])))
    rows.append((101, "short", "en", "a", 5))
    rows.append((102, None, "en", None, None))
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {*range(60), 100} and kept.columns == columns
    lines = corpus_pipeline.dedup_lines(spark, kept, sf)
    assert next(r.text for r in lines.collect() if r.doc_id == 100) == "" and lines.columns == columns
    one = corpus_pipeline.near_dedup(spark, docs.where("doc_id < 60").unionByName(docs.where("doc_id = 100")), sf)
    assert sorted(r.doc_id for r in one.collect()) == list(range(60)) and one.columns == columns
    mixed = corpus_pipeline.mix_sources(spark, docs.where("doc_id < 60"), sf)
    size = sum(len(words(r[1])) for r in rows[:60])
    assert mixed.columns == columns and abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * size) <= 4
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and all(r.offset + r.length <= 2048 for r in got)
    assert {r.doc_id for r in got} <= {*range(60), 100}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]


def test_nulls_ties_long_texts_and_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    make = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))
    rows = [(i, make(4), "ab"[i % 2]) for i in range(20)]
    rows += [(None, make(4), "a"), (None, make(4), None), (50, None, "a"), (51, "", None), (52, make(3000), "b"), (3, rows[3][1], rows[3][2])]
    names = ["s", "block", "shard", "cut", "fp", "th", "key", "component", "h", "first", "pos", "line", "n", "rest"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), *[f"{n}{i}" for n in names]) for i, t, s in rows], shape).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
    kept = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted([(False, i) for i in range(20)] + [(True, 0)] * 2 + [(False, 52)])
    assert all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names) and all(r.n_chars == len(r.text) for r in kept)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    assert mixed and all(r[n] == f"{n}{r.doc_id}" and r.n_chars == len(r.text) for r in mixed for n in names)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept} and any(r.piece > 5 for r in got if r.doc_id == 52)
    assert sum(r.length for r in got) > 0 and all(r.offset + r.length <= 2048 for r in got)
