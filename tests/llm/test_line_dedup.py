"""The share decides on small hosts too."""

import pytest

from tracksieve.llm.line_dedup import drop_boilerplate


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_small_hosts_and_null_cells(spark, broadcast):
    rows = [(i, "four", f"shared line\nown {i}") for i in range(4)]
    rows += [(10 + i, "hundred", f"seldom\nown {i}" if i < 5 else f"own {i}") for i in range(100)]
    rows += [(200, "one", "alone on its host"), (201, None, "no host\nx"), (202, None, "no host\ny"), (203, "four", None), (204, "four", ""), (None, "four", "shared line")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows)
    assert [text[i] for i in range(4)] == [f"own {i}" for i in range(4)] and text[None] == ""
    assert text[10] == "seldom\nown 0" and text[200] == "alone on its host"  # 5 of 100 pages are not more than the share
    assert (text[201], text[202], text[203], text[204]) == ("x", "y", None, "")
