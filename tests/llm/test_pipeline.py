"""The pipeline's stages on planted cases, and the whole run on the smallest tables."""

import numpy as np
import pytest
from check_oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import exact_dedup, packing, simhash, substrings, toxicity_pu
from tidewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_are_whole_and_in_order(spark):
    """Each stage keeps what its operator says of all its input, and the columns of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0] == "toxicity" and names[-1] == "best-fit packing"
    model = toxicity_pu.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        kept[name] = (now, out)
        now = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    assert ids(after) == ids(toxicity_pu.score(before, model).filter("predicted = 0"))
    before, after = kept["exact dedup"]
    assert ids(after) == ids(exact_dedup.exact_dedup(before).filter("kept"))
    before, after = kept["SimHash near-dedup"]
    assert ids(after) == ids(simhash.near_duplicates(before).filter("doc_id = component_id"))
    before, after = kept["substring dedup"]
    rows = {r.doc_id: r.text for r in before.collect()}
    brute = dict(zip(rows, substrings.brute_force(list(rows.values())), strict=True))
    for r in after.collect():
        n_words, n_removed, _ = brute[r.doc_id]
        assert (r.text == rows[r.doc_id]) if n_removed == 0 else len(r.text.split()) == n_words - n_removed
        assert r.n_chars == len(r.text)
    packed = corpus_pipeline.run(spark, SF)
    want = packing.best_fit_packing(now)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_planted_cases(spark):
    """Copies and repeated passages go; clean documents stay as they are."""
    r = np.random.default_rng(9)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))
    clean = [(k, text(120)) for k in range(20)]
    passage = text(60)
    planted = [(100, clean[0][1] + "  "), (101, clean[1][1].upper()), (102, text(30) + " " + passage), (103, text(30) + " " + passage + " " + text(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + planted], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, SF)
    left = {x.doc_id: x.text for x in now.collect()}
    # of equal texts the longer original stays; of near duplicates the least doc_id
    assert set(left) == {k for k in range(1, 20)} | {100, 102, 103}
    assert all(left[k] == t for k, t in clean if k > 0)
    assert len(left[102].split()) == 30 and len(left[103].split()) == 60


def test_registered_queries(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    columns = {n: q(spark, SF).columns for n, q in QUERIES.items() if n.startswith(("op4", "op7", "op10"))}
    assert columns["op4_exact_dedup"] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert QUERIES["op10_media_avi"](spark, SF).filter(F.col("payload_bytes") % 576 != 0).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, SF) == ""
