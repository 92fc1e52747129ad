"""The registered queries on the smallest tables."""

from __future__ import annotations

import pytest

from retrix.llm.oracle import ORACLE
from retrix.llm.queries import QUERIES
from tests.oracle import compare, connection

#: The columns that are compared with hidden cases.
FIXED = {"p1_found": {"id_a", "id_b"}, "p2_found": {"item_id", "line_no"}, "p3_found": {"item_id"}, "p4_found": {"id_a", "id_b"}, "p5_found": {"id", "defect_type"}, "p6_found": {"tbl", "rec_id", "line_no"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    frame = QUERIES[name](spark, data)
    if name in FIXED:
        assert set(frame.columns) == FIXED[name]
        assert frame.count() == frame.distinct().count()
    if name in ORACLE:
        compare(frame, connection(data), ORACLE[name])
    else:
        assert frame.count() > 0


def test_p1_against_brute_force(spark, data):
    from tests.llm.test_similar import brute

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/chunks.parquet").select("id", "content").distinct().collect()]
    assert {tuple(r) for r in QUERIES["p1_found"](spark, data).collect()} == brute(rows)
