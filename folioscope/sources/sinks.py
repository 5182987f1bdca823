"""Writing results: CSV, JSON, Markdown and HTML, by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(table: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, for formats without nesting."""
    nested = (ArrayType, MapType, StructType)
    return table.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in table.schema])


def write_csv(table: DataFrame, path: str, by: str | None = None) -> None:
    writer = flat(table).write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def wide_matrix(pairs: DataFrame, a: str = "a", b: str = "b", value: str = "cosine") -> DataFrame:
    """A row and a column per id: symmetric, 1 on the diagonal. For small corpora; the
    pairs themselves are the form that scales."""
    both = pairs.select(a, b, value).union(pairs.select(b, a, value))
    own = both.select(F.col(a), F.col(a).alias(b), F.lit(1.0).alias(value)).distinct()
    return both.union(own).groupBy(a).pivot(b).agg(F.first(value))


def markdown_card(title: Column, lines: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_page(title: Column, lines: Column) -> Column:
    rows = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "\n")
    return F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), escaped(title), F.lit("</title><h1>"), escaped(title), F.lit("</h1><ul>\n"), rows, F.lit("\n</ul>\n"))


def dossiers(results: DataFrame, docs: DataFrame, id: str = "sop_id") -> DataFrame:
    """id, status, text: a Markdown page for each document with what every analysis
    says of it, the worst status above."""
    from ..operators import rollup

    entry = F.struct("module", "status", "findings")
    told = results.groupBy(id).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    line = lambda e: F.concat(F.lit("- "), e["module"], F.lit(": "), e["status"], F.when(F.size(e["findings"]) > 0, F.concat(F.lit(" ("), F.array_join(e["findings"], "; "), F.lit(")"))).otherwise(""))
    rows = docs.select(id, "title").join(told, id, "left").join(rollup.worst_status(results, id).select(id, "status"), id, "left")
    status = F.coalesce("status", F.lit("n/a"))
    lines = F.coalesce(F.transform("entries", line), F.array().cast("array<string>"))
    text = F.concat(F.lit("# "), F.col(id), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n\nStatus: "), status, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return rows.select(id, status.alias("status"), text.alias("text"))


def dashboard(results: DataFrame) -> DataFrame:
    """text: one HTML page with a row for each analysis and the counts of its statuses."""
    counts = results.groupBy("module").agg(*[F.count_if(F.col("status") == s).alias(name) for s, name in (("fail", "f"), ("warn", "w"), ("pass", "p"), ("n/a", "n"))])
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr><td>"), escaped(F.col("module")), F.lit("</td>"), cell("f"), cell("w"), cell("p"), cell("n"), F.lit("</tr>"))
    rows = counts.select(F.struct("module", row.alias("row")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))  # a row per analysis
    head = "<!doctype html><meta charset=utf-8><title>Analyses</title><h1>Analyses</h1><table><tr><th>Analysis<th>fail<th>warn<th>pass<th>n/a</tr>\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n</table>\n")).alias("text"))


def write_text(texts: DataFrame, path: str, text: str = "text", by: str | None = None) -> None:
    writer = (texts.select(by, text) if by else texts.select(text)).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)
