"""The stages one by one, and the registered queries that have SQL."""

import pytest
from compare import connect, difference
from llm.test_dedup import copies_by_force, links_by_force, rows_of
from llm.test_filters import statistics_by_force

import __spark_entry__ as entry
import corpus_pipeline as P
from newsloom.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, sf_dir, name):
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    assert difference(mine, connect(sf_dir).execute(entry.oracle_sql()[name]).df()) is None


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS kept", "'mine' AS rule").cache()
    stages = dict(P.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns and {r.rule for r in good.collect()} == {"mine"}
    for _, text in rows_of(good):
        n, _, _, _, repeated = statistics_by_force(text)
        assert n >= 50 and 2 * repeated <= n
    once = stages["exact_dedup"](spark, good, sf_dir).cache()
    assert {i for i, _ in rows_of(once)} == {i for i, v in copies_by_force(rows_of(good)).items() if v[2]}
    apart = stages["near_dedup"](spark, once, sf_dir).cache()
    assert {i for i, _ in rows_of(apart)} == {i for i, v in links_by_force(rows_of(once), 5, 80, 100).items() if v[1] == i}
    clean = stages["personal_data"](spark, apart, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == apart.count()
    assert clean.where("text LIKE '%@mail_.example.com%'").count() == 0 and clean.where("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows_of(clean)}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
