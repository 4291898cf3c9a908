"""The registered queries, their SQL, and the pipeline."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from cuelake.llm import decontaminate, langid, mixing, quality, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    df = queries.queries()[name](spark, tiny)
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted(tuple(str(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_pipeline_stages_are_the_operators(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels, bench = spark.read.parquet(f"{tiny}/labels.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near-dedup", "decontamination", "mixing"]

    one = stages["quality"](spark, docs, tiny).cache()
    good = {r["doc_id"] for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in one.collect()} == good and one.columns == docs.columns

    two = stages["language"](spark, one, tiny).cache()
    known = {r["doc_id"] for r in langid.language_id(one).where("not rejected").collect()}
    assert {r["doc_id"] for r in two.collect()} == known

    three = stages["near-dedup"](spark, two, tiny).cache()
    assert {r["doc_id"] for r in three.collect()} == {r["component_id"] for r in simhash.near_duplicates(two).collect()}

    four = stages["decontamination"](spark, three, tiny).cache()
    clean = {r["doc_id"] for r in decontaminate.decontaminate(three, bench).where("not contaminated").collect()}
    assert {r["doc_id"] for r in four.collect()} == clean and four.columns == docs.columns

    five = stages["mixing"](spark, four, tiny)
    assert sorted(map(str, five.collect())) == sorted(map(str, mixing.mix(four).select(five.columns).collect()))


def test_pipeline_takes_odd_rows_and_none(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(2)).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "n_chars")
    for name, table in (("odd", docs.unionByName(odd).unionByName(docs.limit(5))), ("none", docs.limit(0))):
        d = f"{tmp_path}/{name}"
        table.write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tiny}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        n = corpus_pipeline.run(spark, d).count()
        assert n == 0 if name == "none" else n > 100
