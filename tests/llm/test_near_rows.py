"""Which rows near-dedup keeps where ids are null or rows are equal."""

from __future__ import annotations

from collections import Counter

from tarnspark.llm.near_dedup import without_near_duplicates

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def test_blank_rows_stay_and_null_ids_are_grouped(spark):
    rows = [(1, None, "a"), (1, None, "b"), (None, " ", "a"), (None, " ", "a"), (None, LONG, "a"), (None, LONG + " tail", "a"), (None, OTHER, "a"), (2, OTHER, "a"), (2, OTHER, "b"), (None, "one two three", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = without_near_duplicates(docs, width=2).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept if not (r["text"] or "").strip()) == {(1, None): 2, (None, " "): 2}
    full = [(r["doc_id"], r["text"][:3]) for r in kept if (r["text"] or "").strip()]
    assert sorted(full, key=str) == [(2, "v0 "), (None, "one"), (None, "w0 ")]
