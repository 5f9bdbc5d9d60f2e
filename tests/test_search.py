from pyspark.sql import functions as F

from ripplegraph.functions.text import chunks, described, tokens
from ripplegraph.operators import search

TEXT = """# Title

## First
A shared platform.
<!-- hidden
words -->
```
# not a heading
```
### Inner
Deep text.
## Empty
"""


def test_chunks(spark):
    docs = spark.createDataFrame([("a.md", TEXT), ("b.md", "before\n# Only\nthe end"), ("c.md", None), ("d.md", "")], "source string, text string")
    rows = {r.chunk_id: r for r in chunks(docs).collect()}
    assert [r.heading_path for r in rows.values() if r.heading == "Inner"] == [["Title", "First", "Inner"]]
    first = next(r for r in rows.values() if r.heading == "First")
    assert "# not a heading" in first.body and "hidden" not in first.body and first.line_start == 3 and first.document_title == "Title"
    assert sorted(r.heading for r in rows.values() if r.source == "b.md") == ["", "Only"]
    assert not [r for r in rows.values() if r.source in ("c.md", "d.md")]
    assert [r.heading for r in search.unwritten(chunks(docs)).collect()] == ["Empty"]


def test_described_sections(spark):
    docs = spark.createDataFrame([("a.md", TEXT), ("b.md", "before")], "source string, text string")
    rows = {r.chunk_id: r for r in described(chunks(docs)).collect()}
    inner = next(r for r in rows.values() if r.heading == "Inner")
    assert inner.breadcrumb == "Title > First > Inner" and inner.indexable == "Title\nFirst\nInner\nDeep text." and inner.citation == f"a.md, lines {inner.line_start}-{inner.line_end}"
    assert rows["b.md#1"].breadcrumb == "b.md" and rows["b.md#1"].is_document_title and rows["a.md#1"].is_empty and not inner.is_empty


def test_retriever_over_a_folder(spark, tmp_path):
    for name, text in (("notes/one.md", "# One\n## Rivers\nThe harbour and the river."), ("notes/two é.md", "# Two\n## Platforms\nA shared data platform."), ("rules/three.md", "# Three\n## Nothing\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = search.KeywordRetriever.from_corpus(spark, str(tmp_path), "notes", "rules")
    hits = found.search("which platform is shared?").collect()
    assert [(h.rank, h.source, h.breadcrumb) for h in hits] == [(1, "notes/two é.md", "Two > Platforms")]
    assert found.search("zebra").count() == 0 and sorted(r.heading for r in found.unwritten().collect()) == ["Nothing", "Three"]
    assert repr(found) == "KeywordRetriever(2 sections indexed, 2 unwritten)"
    assert search.rendered(found.search("river")).first().line.startswith("1. One > Rivers [notes/one.md, lines 2-3] (score ")


def test_near_ties_go_by_whole_scores(spark):
    docs = spark.createDataFrame([("b", "alpha " * 2000 + "x"), ("a", "alpha " * 2000 + "x y")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    rows = search.search(docs, asked).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a"] and abs(rows[0].score - rows[1].score) < 1e-3


def test_tokens(spark):
    row = spark.createDataFrame([("The shared Data platform",)], "text string").select(tokens("text").alias("t")).first()
    assert row.t == ["shared", "data", "platform"]


def test_search(spark):
    docs = spark.createDataFrame([("a", "shared data platform"), ("b", "harbour and river"), ("c", ""), ("d", "platform")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "the shared platform"), ("none", "zebra")], "query_id string, query string")
    rows = search.search(docs, asked, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in rows] == [("q", 1, "a"), ("q", 2, "d")]
    assert search.search(docs, asked, 0).count() == 0
    assert search.search(docs.where(F.lit(False)), asked, 3).count() == 0


def test_equal_sums_tie_whatever_the_order_of_their_rows(spark):
    import math
    import random

    draw = random.Random(3)
    bags = [[draw.uniform(0, 9) for _ in range(90)] for _ in range(60)]
    rows = [(bag, copy, x) for bag, gains in enumerate(bags) for copy in range(10) for x in draw.sample(gains, len(gains))]
    each = spark.createDataFrame(rows, "bag int, copy int, x double").coalesce(1).groupBy("bag", "copy").agg(F.sum("x").alias("plain"), search.exact_sum(F.col("x")).alias("exact"))
    found = each.groupBy("bag").agg(F.collect_set("exact").alias("exact"), F.countDistinct(F.round("plain", 12)).alias("plain")).orderBy("bag").collect()
    assert max(r.plain for r in found) > 1  # what told copies apart before
    assert [r.exact for r in found] == [[math.fsum(gains)] for gains in bags]
