"""Tokens and markdown sections, as Spark expressions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are never tokens.
STOPWORDS = (
    "a an and are as at be been but by can could do does for from had has have how i if in into is it its may might must "
    "of on or our shall should so such than that the their them then there these they this those to was we were what when "
    "where which while who why will with would you your"
)
# What ends a line, and what a heading is.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
HEADING = r"^(#{1,6})(?U:\s+)(.*?)(?U:\s*)#*(?U:\s*)$"


def tokens(text: str) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, repeats kept, stop words left out; null text: null."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS.split())
    return F.expr(f"filter(regexp_extract_all(lower({text}), '[a-z0-9]+', 0), t -> t not in ({stop}))")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunks(docs: DataFrame) -> DataFrame:
    """Sections of markdown: source, text -> chunk_id, source, document_title, heading, heading_path, body, line_start, line_end.

    A section runs from its heading to the next. Comments go first, so lines are numbered without them. Headings inside code
    fences are text. Text before the first heading is a section without heading, unless blank. Null text: no sections.
    """
    text = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    lines = docs.select("source", F.posexplode(F.split(text, LINE_END, -1)).alias("pos", "line"), F.size(F.split(text, LINE_END, -1)).alias("n"))
    lines = lines.where("pos < n - 1 or line <> ''")
    so_far = Window.partitionBy("source").orderBy("pos")
    lines = lines.withColumn("is_fence", F.col("line").rlike(r"^(?U:\s*)(```|~~~)"))
    fenced = F.sum(F.col("is_fence").cast("int")).over(so_far) % 2 == 1
    lines = lines.withColumn("is_heading", ~fenced & ~F.col("is_fence") & F.col("line").rlike(HEADING))
    lines = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(so_far))
    heading = F.max(F.when(F.col("is_heading"), F.struct(F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("text"))))
    body = F.expr("array_join(transform(array_sort(collect_list(if(is_heading, null, struct(pos, line)))), p -> p.line), '\n')")
    sections = lines.groupBy("source", "section").agg(heading.alias("h"), body.alias("body"), (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"))
    sections = sections.withColumn("body", stripped(F.col("body"))).where("h is not null or body <> ''")
    before = Window.partitionBy("source").orderBy("section")
    stack = "aggregate(hs, cast(array() as array<struct<level:int,text:string>>), (acc, h) -> concat(filter(acc, x -> x.level < h.level), array(h)))"
    nested = sections.withColumn("hs", F.collect_list("h").over(before)).withColumn("stack", F.expr(stack))
    return nested.select(
        F.concat_ws("#", "source", "line_start").alias("chunk_id"), "source",
        F.expr("coalesce(get(filter(hs, x -> x.level = 1), 0).text, '')").alias("document_title"),
        F.coalesce("h.text", F.lit("")).alias("heading"),
        F.expr("if(h is null, cast(array() as array<string>), transform(stack, x -> x.text))").alias("heading_path"),
        "body", "line_start", "line_end",
    )


def described(sections: DataFrame) -> DataFrame:
    """sections with breadcrumb, indexable text, citation, is_empty and is_document_title."""
    return sections.withColumns({
        "breadcrumb": F.when(F.size("heading_path") == 0, F.col("source")).otherwise(F.array_join("heading_path", " > ")),
        "indexable": F.trim(F.concat_ws("\n", F.array_join("heading_path", "\n"), "body"), F.lit(" \n\t")),
        "citation": F.format_string("%s, lines %d-%d", "source", "line_start", "line_end"),
        "is_empty": F.col("body") == "",
        "is_document_title": F.size("heading_path") <= 1,
    })
