"""The queries over the smallest tables: columns as stated, and plain checks of their contents."""

import os

import pytest

from tracklode.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["rid", "cluster_rid"],
    "p1_clusters": ["cluster_rid", "n_rids", "n_communities", "typical"],
    "p1_profiles": ["cluster_rid", "n_rids", "n_typical", "inside"],
    "p2_found": ["pattern"],
    "p2_supports": ["pattern", "support"],
    "p3_found": ["rid_a", "rid_b"],
    "p3_recall": ["n_queries", "n_true", "reached"],
    "p4_found": ["rid", "group_rid"],
    "p4_decomposed": ["rid", "group_rid"],
    "p6_found": ["rid_a", "rid_b"],
    "p6_links": ["rid", "class_rid", "n_class", "n_links"],
    "p7_ids": ["doc_id", "ids"],
    "p8_mixture": ["doc_id", "source", "n_tokens", "copy", "block", "shard"],
    "p8_shares": ["source", "target_share", "actual_share", "n_tokens", "n_documents", "n_uses", "most_copies"],
    "p8_seats": ["source", "n_seats"],
    "p8_reached": ["source", "target_share", "max_repeat", "reached", "within"],
    "p8_all_tokens": ["source", "target_share", "max_repeat", "within"],
    "p9_found": ["doc_id", "kind", "surface"],
    "p9_redacted": ["doc_id", "text", "n_found"],
    "p9_redaction_check": ["n_documents", "n_null", "n_left"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_query_is_listed():
    assert set(Q.QUERIES) == set(COLUMNS) and set(Q.SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("p1_clusters", "p2_supports")])
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    if name in ("p3_found", "p6_found"):
        assert all(r.rid_a < r.rid_b for r in rows) and len(set(rows)) == len(rows)
    if name == "p7_ids":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and str(df.schema["ids"].dataType.elementType) == "IntegerType()"
    if name == "p8_shares":
        assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9


def test_nothing_outside_imports_this_folder():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "tracklode")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "tracklode.llm" not in open(os.path.join(folder, f)).read(), f
