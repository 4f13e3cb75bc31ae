"""The pipeline's stages against what each does alone, and the queries' contracts over the test tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from quillgraph.llm import mixing, neardup, pii
from quillgraph.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(stages, spark, sf_dir):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    left = {r["doc_id"] for r in stages[1].collect()}
    assert clean <= left
    judged = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert left == {r["doc_id"] for r in judged if r["predicted"] == 0}
    assert len(toxic & left) < len(toxic)


def test_one_of_each_group_stays(stages):
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(stages[1]).collect()}
    left = [r["doc_id"] for r in stages[2].collect()]
    assert sorted(left) == sorted(set(groups.values()))


def test_personal_data_goes_and_nothing_else(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    model, thresholds = pii.detector()
    for r in stages[3].collect():
        spans = pii.find(before[r["doc_id"]], model, thresholds)[1]
        assert r["text"] == pii.redact(before[r["doc_id"]], spans) and r["n_chars"] == len(r["text"])
        assert not pii.base_spans(r["text"])


def test_mix_and_pack_cover_all(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == Counter(copies)
    packed = Counter(r["doc_id"] for r in stages[5].where("piece = 0").collect())
    assert packed == Counter(copies)


def test_run(spark, sf_dir, stages):
    norm = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert norm(corpus_pipeline.run(spark, sf_dir)) == norm(stages[5])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf_dir}/{t}'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)  # noqa: E731  integers with nulls come as floats from one side
    cells = lambda df: sorted(map(tuple, ([cell(v) for v in row] for row in df[sorted(df.columns)].values.tolist())))
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


CONTRACT = {
    "op2_mixing": "doc_id size source_size target taken", "op3_url_filters": "page_id host path rule verdict",
    "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8_toxicity": "doc_id held_out score predicted", "op9_simhash": "doc_id fingerprint component_id",
    "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, sf_dir, name):
    assert set(CONTRACT[name].split()) <= set(QUERIES[name](spark, sf_dir).columns)
