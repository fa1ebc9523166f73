"""The registered queries over the smallest tables, against their SQL or plain loops; and the pipeline, stage by stage."""

import os

import brute
import pytest
from check_oracle import normal, oracle

from sparksymbols.llm import decontamination
from sparksymbols.llm.common import stored
from sparksymbols.llm.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("SYMBOLS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return oracle(FOLDER)


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name, *columns):
        if name not in made:
            made[name] = QUERIES[name](spark, FOLDER).collect()
        return sorted((tuple(r[c] for c in columns) for r in made[name]), key=str)

    return get


def test_names():
    import __spark_entry__ as entry

    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(name, spark, tables):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), tables.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_contaminated(result, tables):
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = brute.contaminated(docs, items, decontamination.UNITS)
    assert want and result("op4_decontamination", "doc_id", "item_id") == sorted(want, key=str)


def test_repeats(result, tables):
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert result("op5_suffix_repeats", *columns) == sorted(brute.repeats(docs), key=str)


def test_near_duplicates(result, tables):
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    assert result("op6_minhash", "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs), key=str)


@pytest.mark.parametrize(("name", "label", "threshold", "least"), [("op9_quality", "quality", 0.3, 0.9), ("op10_toxicity", "toxic", 0.5, 0.85)])
def test_classifiers(name, label, threshold, least, result, tables):
    from zlib import crc32

    rows = result(name, "doc_id", "held_out", "score", "predicted")
    assert len(rows) == tables.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(held == (crc32(str(i).encode()) % 5 == 0) for i, held, *_ in rows)
    assert all(0 <= s <= 1 and p == (s >= threshold) for _, _, s, p in rows)
    truth = dict(tables.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    known = [p == truth[i] for i, _, _, p in rows if i in truth]
    assert sum(known) / len(known) >= least


def test_pipeline(spark, tables):
    """Each stage on what the one before has kept."""
    import corpus_pipeline as C

    assert [name for name, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    good = {r["doc_id"] for r in QUERIES["op9_quality"](spark, FOLDER).where("predicted = 1").collect()}
    last = {}
    for i in good:
        last[texts[i]] = max(last.get(texts[i], i), i)
    single = set(last.values())
    near = {i for i, _, _, kept in brute.near([(i, texts[i]) for i in single], percent=C.NEAR_PERCENT) if kept}
    clean = near - {i for i, _ in brute.contaminated([(i, texts[i]) for i in near], items, decontamination.UNITS)}
    kept = docs
    for (name, stage), want in zip(C.STAGES[:-1], (good, single, near, clean), strict=True):
        kept = stored(stage(spark, kept, FOLDER), name)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == want, name
    mix = C.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert {r["doc_id"] for r in mix} == clean
    assert sorted(map(tuple, C.run(spark, FOLDER).collect())) == sorted(map(tuple, mix))
