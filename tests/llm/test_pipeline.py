import os
import subprocess
import sys

import corpus_pipeline as cp
import pytest
from compare import difference, open_oracle

import __spark_entry__ as entry
from llm import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    problem, _ = difference(queries.QUERIES[name](spark, SF), open_oracle(SF), queries.ORACLES[name])
    assert problem is None, problem


def test_stages_step_by_step(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for number, (_, stage) in enumerate(cp.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{number}")
        tables.append(spark.read.parquet(f"{tmp_path}/{number}"))
        if number < len(cp.STAGES) - 1:
            assert tables[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    scores = {r.doc_id: r.predicted for r in queries.op2_quality_scores(spark, SF).collect()}
    assert ids[1] == [i for i in ids[0] if scores[i] == 1]
    assert ids[2] == ids[1]
    lines = [x for r in tables[2].collect() for x in (r.text or "").split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text or "") for r in tables[2].collect())
    groups = {r.page_id: r.component_id for r in __import__("llm.simhash").simhash.near_duplicates(cp._page_texts(tables[2])).collect()}
    assert ids[3] == sorted(set(groups.values()))
    assert set(ids[4]) == set(ids[3]) and set(ids[5]) == set(ids[4])
    pieces = tables[5].toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert pieces[pieces.piece == 0].shape[0] == len(ids[4])
    assert cp.run(spark, SF).count() == len(pieces)


def test_line_stage_drops_a_line_with_a_replaced_word(spark):
    line = "a line of some length that goes on to lladoque de ta {} ciie co and then ends"
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, line.format(word), "en", "s", 0) for i, word in enumerate(("de", "su"))], schema)
    assert {r.doc_id: r.text for r in cp.line_dedup(spark, docs, SF).collect()} == {0: line.format("de"), 1: ""}


def test_stages_take_odd_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "some text\nsome text", "en", "s", 19), (3, "some text\nsome text", "en", "s", 19)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() <= 20


def test_entry_without_the_corpus_folder(tmp_path):
    for name in ("pagefacts", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    code = ("import importlib.util, sys; sys.path.insert(0, '.'); s = importlib.util.spec_from_file_location('e', '__spark_entry__.py'); e = importlib.util.module_from_spec(s);"
            " s.loader.exec_module(e); sys.path[:] = [p for p in sys.path if p != '" + ROOT + "']; print(any(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.oracle_sql()) > 100)")
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["False", "True"], said.stderr
