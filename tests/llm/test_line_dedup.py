from __future__ import annotations

from bulwark.llm import line_dedup


def test_spread_lines_go(docs):
    rows = [(i, f"own line number {i} with words enough\nCommon footer\nanother line of {i} here", "en", f"s{i % 6}") for i in range(30)]
    rows += [(100 + i, f"different body for document {i}\n  only two sites  ", "en", f"s{i % 2}") for i in range(10)]
    out = {r.doc_id: r for r in line_dedup.clean_lines(docs(rows), min_sites=5).collect()}
    assert len(out) == 40
    assert all("Common footer" not in r.text and f"own line number {i}" in r.text for i, r in out.items() if i < 100)
    assert all("only two sites" in r.text for i, r in out.items() if i >= 100)
    assert all(r.n_chars == len(r.text) and r.size == -1 and r.gone == "x" for r in out.values())


def test_near_threshold_is_exact(docs):
    def sites(n):
        rows = [(i, "shared line\n" + f"body {i} " * 9, "en", f"s{i}") for i in range(n)] * 3
        return line_dedup.clean_lines(docs(rows), min_sites=5).filter("text like '%shared line%'").count()

    assert sites(4) == 12 and sites(5) == 0


def test_copies_stay_whole(docs):
    rows = [(i, "a line that all copies have\nand a second such line", "en", f"s{i}") for i in range(8)]
    assert {r.text for r in line_dedup.clean_lines(docs(rows), 5).collect()} == {rows[0][1]}


def test_short_carriers_lose_long_passages(docs):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"few own words {i}\n{passage}", "en", f"s{i}") for i in range(6)]
    assert {r.doc_id: r.text for r in line_dedup.clean_lines(docs(rows), 5).collect()} == {i: f"few own words {i}" for i in range(6)}


def test_edges(docs, edge_rows):
    got = line_dedup.clean_lines(docs(edge_rows)).select("doc_id", "text").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs(edge_rows).select("doc_id", "text").collect())
    assert line_dedup.clean_lines(docs([])).count() == 0
    assert line_dedup.line_report(docs(edge_rows)).count() == len(edge_rows)


def test_blank_lines_and_long_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["a", "", "b", "c"], [0, 3]), (["a"], [0]), (["a", "b"], [])], "l array<string>, g array<int>")
    got = [r[0] for r in df.select(line_dedup.without(F.col("l"), F.col("g"))).collect()]
    assert got == [["", "b"], [], ["a", "b"]]
