"""Pages without an id between pages with one."""

from barlake.llm import queries, warc


def test_null_ids(spark, tmp_path):
    rows = [(1, "http://a", "one"), (None, "http://b", "two"), (2, "http://c", "three"), (None, None, None), (3, "http://d", "two"), (None, "http://e", "two"), (4, "http://f", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in read) == sorted((f"<urn:page:{'' if k is None else k}>", html or "") for k, _, html in rows)
    assert {r.record_type for r in read} == {"response"}
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    done = queries.op6_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in done) == sorted((k or 0, len(html or "")) for k, _, html in rows)
