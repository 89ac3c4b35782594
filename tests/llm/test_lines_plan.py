"""A text is split once a row, not once a line that stays."""

from barlake.llm import lines


def test_no_lambda_splits_the_text_again(spark):
    text = "\n".join(f"line {i % 40}" for i in range(60)) + "\n\n \n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "line 1\nother\n")], "doc_id long, text string")
    done = lines.dedup_lines(docs)
    assert "element_at(split(" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in done.collect()}
    assert got == {1: ("\n".join(f"line {i}" for i in range(40)) + "\n\n \n", 60, 20), 2: (None, 0, 0), 3: ("", 0, 0), 4: ("other\n", 2, 1)}
