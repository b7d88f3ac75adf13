"""Stages of the corpus pipeline against their operators, odd rows, and the registered queries."""

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foliospark.llm.op9_rules import quality_rules
from foliospark.llm.op10_privacy import base_spans
from queries.compare import check, duck
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard import brute as classes

SF = "/root/testdata/sf0.001"


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality_rules(docs, labels).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    found = classes(rows)
    ones = [(i, t) for i, t in rows if found[i][1] == i]
    dirty = leaks(ones, items)
    clean = {i for i, _ in ones if not dirty[i][4]}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "mix_copy"]
    got = out.collect()
    assert {r.doc_id for r in got} <= clean and max(r.mix_copy for r in got) <= 2
    assert all(not base_spans(r.text)[0] for r in got)
    words = sum(len(r.text.split()) for r in got)
    before = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert words == pytest.approx(1.5 * sum(before[i] for i in clean), rel=0.1)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, documents_of, tmp_path, name, stage):
    good = "This is a good text of many words, it has a mark at its end and says one thing only once."
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good + " And more."), (4, "word " * 20_000), (5, "x"), (6, good.replace("good", "Good"))]
    for table in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{table}.parquet"), tmp_path / f"{table}.parquet")
    for docs in (documents_of(rows), documents_of([]), documents_of(rows, clashes=False)):
        docs = docs.drop("mix_copy")
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + ["mix_copy"] * (name == "mixing")
        out.collect()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_return_a_row_for_each_document(spark, name):
    if name not in ("op6_preference", "op11_repair"):  # these are of conversations
        assert entry.queries()[name](spark, SF).count() == 200


@pytest.mark.parametrize("name", ["op3_repeats", "op7_jaccard_join"])
def test_sql(spark, name):
    assert check(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == ""
