"""Every stage of the pipeline against a plain version on its own input, and the registered queries."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus
import numpy as np
import pytest
from test_links import linked
from test_texts import contaminated, tokenizer, vocabulary  # noqa: F401

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{out}/documents.parquet")
    rng = random.Random(4)
    full = [t for _, t, *_ in rows if t and len(t) > 300]
    items = [(k, rng.choice(full)[20:200]) for k in range(4)] + [(9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def plain(frame):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect()]


def test_stages(spark, folder, tokenizer):  # noqa: F811
    import corpus_pipeline

    from boreline.functions.blocks import durable

    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    one = durable(stages["language_id"](spark, docs, folder))
    assert one.columns == columns
    gone = Counter(plain(docs)) - Counter(plain(one))
    assert not Counter(plain(one)) - Counter(plain(docs))
    assert {t for _, t, *_ in gone} >= {None, "", "  \n\t ", "... !!", "1 2 3 4"}
    assert all(not any(c.isalpha() for c in t or "") or len(t) < 40 for _, t, *_ in gone)

    two = durable(stages["near_copies"](spark, one, folder))
    assert two.columns == columns
    before = plain(one)
    _, roots = linked(before)
    first = {}
    for row, root in zip(before, roots, strict=True):
        first[root] = min(first.get(root, row), row, key=lambda r: corpus.order(r[0]))
    assert Counter(i for i, *_ in plain(two)) == Counter(i for i, *_ in first.values())

    three = durable(stages["decontamination"](spark, two, folder))
    assert three.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = Counter({i: n for (i, *_, hit), n in contaminated(plain(two), items).items() if hit})
    assert bad and Counter(i for i, *_ in plain(three)) == Counter(i for i, *_ in plain(two)) - bad

    four = durable(stages["mixture"](spark, three, folder))
    assert four.columns == columns
    assert set(plain(four)) <= set(plain(three)) and max(Counter(plain(four)).values()) <= 3

    five = stages["token_files"](spark, four, folder).collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in plain(four)]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in five) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, *_), x in zip(plain(four), ids, strict=True))
    at = 0
    for r in sorted(five, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, five))


def test_language_stage_rejects_what_the_operator_rejects(spark, docs, folder):
    import corpus_pipeline

    from boreline.llm import languages

    filters = languages.learn_filters(docs.filter(~languages.held_out()))
    found = languages.predict_languages(docs.select("doc_id", "text"), filters).collect()
    want = Counter((r["doc_id"], r["text"]) for r in found if r["lang_pred"] != languages.UNKNOWN)
    kept = corpus_pipeline.identify_languages(spark, docs, folder)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert want[1004, "Re."] == 1


def test_stages_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_further_columns(spark, docs, folder):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    for number in range(1, 11):
        assert len([n for n in names if n.startswith(f"op{number}_")]) == 1


@pytest.mark.parametrize("name", ["op6_decontamination", "op9_mix_sources"])
def test_against_duckdb(spark, sf, name):
    import __spark_entry__ as entry
    import check
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = entry.queries()[name](spark, sf).toPandas()
    assert check.differences(mine, con.execute(entry.oracle_sql()[name]).fetchdf()) is None


@pytest.mark.parametrize("name", ["op1_quality", "op2_repeated_strings", "op3_context_trees", "op4_sentence_spans", "op5_languages", "op8_set_join"])
def test_one_row_per_document(spark, sf, name):
    import __spark_entry__ as entry

    found = entry.queries()[name](spark, sf).toPandas()
    assert sorted(found["doc_id"]) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
