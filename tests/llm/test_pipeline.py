"""The corpus pipeline's stages, each against its own meaning, and the queries' rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from skyloom.llm import pseudonyms, queries
from skyloom.llm.scratch import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def test_stages(spark):
    SF = "/root/testdata/sf0.01"  # toxicity needs a few dozen toxic examples to learn from
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    seen = [docs]
    for _, stage in p.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    for d in seen[1:-1]:
        assert d.columns == docs.columns
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    assert len(toxic & ids[1]) <= 0.4 * len(toxic) and len(ids[1]) >= 0.9 * (len(ids[0]) - len(toxic))
    texts = [r[0] for r in seen[2].select("text").collect()]
    assert len(set(texts)) == len(texts)
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert not [t for (t,) in seen[3].select("text").collect() for i in items if i in t]
    before, after = dict(seen[3].select("doc_id", "text").collect()), dict(seen[4].select("doc_id", "text").collect())
    mails = {m for t in before.values() for m in re.findall(r"[\w.]+@[\w.]+\w", t)}
    assert mails and not [m for m in mails for t in after.values() if m in t]
    assert sum(before[i] == after[i] for i in before) > 0.5 * len(before)
    assert sorted(seen[5].columns) == ["batch", "bucket", "doc_id", "n_tokens", "padding", "place"]


def test_leaks_go_by_text_and_id(spark):
    """A text that holds an item goes, also without an id; a clean one that shares its id stays."""
    item = max((r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()), key=len)
    rows = [(1, f"before {item} after"), (1, "a clean text of its own"), (None, f"again {item}"), (None, "clean without an id"), (2, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], queries.DOCUMENTS)
    assert sorted(str((r["doc_id"], r["text"])) for r in p.drop_leaks(spark, docs, SF).collect()) == sorted(str(rows[k]) for k in (1, 3, 4))


def test_stages_with_clashing_columns_and_repeated_rows(spark):
    """Columns named like a stage's own results change nothing; nulls, empty texts and repeated rows have the result that docstrings give."""
    rows = [(1, "a text of some plain words", "en", "s", 26), (1, "a text of some plain words", "en", "s", 26), (None, None, None, None, None), (3, "", "en", None, 0), (4, "mail ann.lee@example.com now", "en", "s", 29)]
    plain = spark.createDataFrame(rows, queries.DOCUMENTS)
    more = ["_scored", "_id", "_hash", "text_hash", "component_id", "kept", "score", "Predicted", "evidence", "pii", "n_tokens", "bucket", "batch", "place", "padding", "items", "row"]
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in more])
    left = {"toxicity": 5, "near_duplicates": 4, "decontamination": 5, "pii": 5, "packing": 5}
    with_key = spark.conf.get(pseudonyms.KEY_SETTING, None)
    spark.conf.set(pseudonyms.KEY_SETTING, "a secret of the tests")
    try:
        for name, stage in p.STAGES:
            want, got = stage(spark, plain, SF), stage(spark, clash, SF)
            assert got.columns == want.columns and (name == "packing" or got.columns == p.COLUMNS)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
            assert got.count() == left[name], name
    finally:
        spark.conf.set(pseudonyms.KEY_SETTING, with_key) if with_key else spark.conf.unset(pseudonyms.KEY_SETTING)


def test_pipeline_on_a_cluster_without_a_secret(spark, monkeypatch, tmp_path):
    """It runs to its end where the master isn't a local one, with the shared folder given and no secret of pseudonyms."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(spark.conf, "get", lambda key, *default, get=spark.conf.get: f"file://{tmp_path}/shared" if key == "spark.checkpoint.dir" else get(key, *default))
    rows = [(1, "a text of some plain words", "en", "s", 26), (4, "mail ann.lee@example.com now", "en", "s", 29), (5, None, None, None, None)]
    spark.createDataFrame(rows, queries.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    assert sorted(r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()) == [1, 4, 5]


def test_run_and_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_every_row(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    if name in (tables := {"op4_url_filters": "pages", "op13_vector_codes": "embeddings"}):
        assert rows.count() == spark.read.parquet(f"{SF}/{tables[name]}.parquet").count()
    elif name == "op12_conversation_repair":  # a row for each conversation
        assert rows.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    elif name != "op5_decontamination":
        assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
