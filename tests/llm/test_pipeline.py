"""The pipeline: its stages, in order and over all rows."""

import __spark_entry__ as contract
from test_corpus import _check_bins

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_its_stages_in_order(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    rows = contract.queries()["pipeline"](spark, SF).collect()
    _check_bins(rows, 2048)
    judged = {r["doc_id"] for r in contract.queries()["op4_quality_rules"](spark, SF).select("doc_id", "kept").collect() if r["kept"]}
    assert rows and {r["doc_id"] for r in rows} <= judged
    assert all(len((r["text"] or "").encode().split()) == r["size"] for r in rows)
