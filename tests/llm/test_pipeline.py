"""The whole pipeline over a small table with nulls, copies, a shared passage, secrets, a very long text and columns whose names clash with results."""

import random

import pytest

import corpus_pipeline
from deltaweave.llm import common


def made_up(rng, n):
    return " ".join(rng.choice("the house stands near water and people walk there every morning with their dogs".split()) + rng.choice(["", "", "s", "x"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    passage = " ".join(f"shared{i}" for i in range(55))
    rows = [(i, made_up(rng, 80), ("en", "de")[i % 2]) for i in range(40)]
    rows += [(100, rows[3][1], "de"), (101, rows[4][1] + " tail", "en"), (102, made_up(rng, 60) + " " + passage, "en"), (103, passage + " " + made_up(rng, 60), "en")]
    rows += [(104, "password = hunter2hunter2 " + made_up(rng, 50), "en"), (105, None, None), (106, "", "en"), (107, "12 34", "en"), (108, made_up(rng, 30_000), "en"), (None, made_up(rng, 70), "en"), (7, rows[7][1], "de")]
    docs = spark.createDataFrame([(i, t, g, "web", len(t or ""), 7.0, "x", "y") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, spans string")
    path = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_stage_keeps_clean_documents_and_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, folder))
        assert docs.columns == names, name
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not {105, 106, 107} & kept["language_id"].keys() and {0, 39, 108, None} <= kept["language_id"].keys()
    assert all(r["score"] == 7.0 and r["lang_pred"] == "x" for r in kept["language_id"].values())
    assert kept["near_duplicates"].keys() == kept["language_id"].keys() - {100, 101}
    after = kept["repeated_strings"]
    assert after.keys() == kept["near_duplicates"].keys() and not any("shared" in r["text"] for r in after.values())
    assert after[0]["text"] == kept["language_id"][0]["text"] and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert "hunter2hunter2" not in kept["secret_scan"][104]["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == after.keys()


def test_run_clears_its_folder(spark, folder):
    from pathlib import Path

    rows = corpus_pipeline.run(spark, folder)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    assert not list(shared.glob("pipeline-*")) and rows.count() > 40
