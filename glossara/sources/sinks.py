"""Writers: graphs, transcripts, conversations, compaction and statistics."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import InvalidInputError


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): the element of each node and edge, made by executors."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.col("id").cast("string").alias("id"), F.format_string('<node id="%s" label="%s"/>', F.col("id"), esc(F.col("term"))).alias("line"))
    attr = F.format_string('<attvalues><attvalue for="relationship" value="%s"/><attvalue for="dimension" value="%s"/></attvalues>', esc(F.col("relationship")), esc(F.col("dimension")))
    e = edges.select(F.lit(1), F.concat_ws("-", "u", "v"), F.format_string('<edge id="%s-%s" source="%s" target="%s" weight="%s">%s</edge>', "u", "v", "u", "v", "weight", attr))
    return n.union(e)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> bool:
    """One GEXF 1.2draft file, streamed row by row from the executors; an empty graph writes nothing."""
    if not nodes.limit(1).count():
        return False
    path = path if path.endswith(".gexf") else path + ".gexf"
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected">\n')
        out.write(f"<attributes class={quoteattr('edge')}><attribute id='relationship' title='relationship' type='string'/><attribute id='dimension' title='dimension' type='string'/></attributes>\n")
        part = 0
        out.write("<nodes>\n")
        for row in gexf_lines(nodes, edges).orderBy("part", "id").toLocalIterator():
            if row["part"] != part:
                part = row["part"]
                out.write("</nodes>\n<edges>\n")
            out.write(row["line"] + "\n")
        out.write("</nodes>\n<edges>\n" if part == 0 else "")
        out.write("</edges>\n</graph></gexf>\n")
    return True


def write_gexf_parts(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The elements of a GEXF graph as XML part files, nodes and edges in a folder each; any size, any file system."""
    pair = lambda *names: F.struct(F.array(*[F.struct(F.lit(n).alias("_for"), F.col(n).cast("string").alias("_value")) for n in names]).alias("attvalue")).alias("attvalues")
    n = nodes.select(F.col("id").cast("string").alias("_id"), F.col("term").alias("_label"))
    e = edges.select(F.concat_ws("-", "u", "v").alias("_id"), F.col("u").cast("string").alias("_source"), F.col("v").cast("string").alias("_target"), F.col("weight").alias("_weight"), pair("relationship", "dimension"))
    for df, root, row in ((n, "nodes", "node"), (e, "edges", "edge")):
        df.write.format("xml").option("rootTag", root).option("rowTag", row).save(f"{folder}/{root}")


def write_transcripts(rows: DataFrame, folder: str) -> None:
    rows.select("text").write.mode("overwrite").text(folder)


def conversation_export(messages: DataFrame, form: str) -> DataFrame:
    """(conversation_id, content) as json, markdown or text."""
    ordered = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "speaker", "text"))).alias("m"))
    if form == "json":
        content = F.to_json(F.transform("m", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))))
    elif form == "markdown":
        content = F.array_join(F.transform("m", lambda x: F.concat(F.lit("**"), x["speaker"], F.lit(":** "), x["text"])), "\n\n")
    elif form == "text":
        content = F.array_join(F.transform("m", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n")
    else:
        raise ValueError(f"unknown format {form!r}")
    return ordered.select("conversation_id", content.alias("content"))


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    spark.read.parquet(source).coalesce(files).write.mode("overwrite").parquet(target)


def analyze(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def statistics(df: DataFrame) -> DataFrame:
    """(column, n, nulls, least, most) of each column, in one pass; what ANALYZE keeps of a table."""
    text = lambda c: c.cast("string")
    one = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), text(F.min(c)).alias("least"), text(F.max(c)).alias("most")) for c in df.columns]
    return df.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")


GRAPH_FORMATS = ("gexf", "json", "parquet")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, form: str) -> None:
    """Nodes and edges as part files in a folder each, in one of GRAPH_FORMATS."""
    if form not in GRAPH_FORMATS:
        raise InvalidInputError(f"unknown graph format {form!r}; there are {', '.join(GRAPH_FORMATS)}")
    if form == "gexf":
        write_gexf_parts(nodes, edges, folder)
        return
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        df.write.format(form).save(f"{folder}/{name}")


def config_json(config: dict) -> str:
    return json.dumps(config, indent=2, sort_keys=True, default=str)
