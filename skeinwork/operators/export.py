"""A graph as text: GraphML, Mermaid, Cypher. Rows are written where they lie; order is a sort key, not a collect.

Nodes have id and may have label; edges have src, dst and may have weight. All other columns are
attributes, null where a row has none. Every function gives ``part, nth, line``: the text is the
lines in order of part and nth, joined by line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import escape_cypher, escape_xml, graph_id, mermaid_label, number_text
from skeinwork.runtime import numbered, stored

# The names by which readers of GraphML know the format.
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_GRAPHML = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.1/graphml.xsd">'
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _kind(dtype: str) -> str:
    return "double" if dtype.startswith(_NUMBERS) else dtype if dtype == "boolean" else "string"


def _attributes(df: DataFrame, own: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(c, _kind(k)) for c, k in df.dtypes if c not in own]


def _text(c: str, kind: str) -> Column:
    return number_text(F.col(f"`{c}`")) if kind == "double" else F.col(f"`{c}`").cast("string")


def _lines(spark, part: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, k, x) for k, x in enumerate(lines)], "part int, nth long, line string")


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(nodes: DataFrame, edges: DataFrame, order: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Both with their place in the text: nodes by id or ``order``, edges by src and dst."""
    if "label" not in nodes.columns:
        nodes = nodes.withColumn("label", F.lit(None).cast("string"))
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(None).cast("double"))
    return numbered(nodes, order or ["id"], "_nth"), numbered(edges, ["src", "dst"], "_nth")


def graphml(nodes: DataFrame, edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The lines of a GraphML document. A null label is the id, a null weight 1; attributes are declared by the types of
    their columns: numbers as double, booleans as boolean, all else as string."""
    spark = nodes.sparkSession
    given, (nodes, edges) = (nodes, edges), _named(nodes, edges, order)
    of_nodes, of_edges = _attributes(given[0], ("id", "label")), _attributes(given[1], ("src", "dst", "weight"))
    x = escape_xml
    keys = [("node", "n", c, k) for c, k in [*of_nodes, ("label", "string")]] + [("edge", "e", c, k) for c, k in [*of_edges, ("weight", "double")]]
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
    head = [_XML, _GRAPHML, *(f'  <key id="{a}_{esc(c)}" for="{what}" attr.name="{esc(c)}" attr.type="{k}" />' for what, a, c, k in keys), '  <graph id="G" edgedefault="directed">']
    data = lambda key, value: F.concat(F.lit(f'      <data key="{key}">'), x(value), F.lit("</data>"))
    n = F.concat_ws("\n", F.concat(F.lit('    <node id="'), x(F.col("id").cast("string")), F.lit('">')), data("n_label", F.coalesce("label", F.col("id").cast("string"))), *(data(f"n_{esc(c)}", _text(c, k)) for c, k in of_nodes), F.lit("    </node>"))
    ends = F.concat(F.lit('    <edge id="e'), F.col("_nth").cast("string"), F.lit('" source="'), x(F.col("src").cast("string")), F.lit('" target="'), x(F.col("dst").cast("string")), F.lit('">'))
    e = F.concat_ws("\n", ends, data("e_weight", F.coalesce(number_text(F.col("weight")), F.lit("1"))), *(data(f"e_{esc(c)}", _text(c, k)) for c, k in of_edges), F.lit("    </edge>"))
    return _all(
        _lines(spark, 0, head), nodes.select(F.lit(1).alias("part"), F.col("_nth").alias("nth"), n.alias("line")), edges.select(F.lit(2).alias("part"), F.col("_nth").alias("nth"), e.alias("line")), _lines(spark, 3, ["  </graph>", "</graphml>"])
    )


def chart_ids(nodes: DataFrame) -> DataFrame:
    """``id, cid`` for nodes (id, _nth): the id in word characters or, where an earlier node has that, the first of
    it with ``_1``, ``_2`` ... that no earlier node has.

    Every node asks for its names in that order and a name goes to the earliest node that asks, which gives what
    handing names out one by one would. Nodes of one plain name start as far on as there are earlier ones, so
    that further rounds are needed only where a made name is another node's plain one."""
    plain = nodes.select("id", "_nth", graph_id(F.col("id").cast("string")).alias("base"))
    before = F.row_number().over(Window.partitionBy("base").orderBy("_nth")) - 1
    asks = stored(plain.withColumn("step", before), "names")
    name = F.when(F.col("step") > 0, F.concat("base", F.lit("_"), F.col("step").cast("string"))).otherwise(F.col("base"))
    while True:
        named = asks.withColumn("cid", name)
        first = named.groupBy("cid").agg(F.min("_nth").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        if first.limit(1).count() == 0:
            return named.select("id", "cid")
        lost = F.coalesce((F.col("_nth") > F.col("first")).cast("int"), F.lit(0))
        asks = stored(named.join(first, "cid", "left").select("id", "_nth", "base", (F.col("step") + lost).alias("step")), "names")


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "LR", order: list[str] | None = None) -> DataFrame:
    """The lines of a Mermaid flow chart; weights other than 1 are written on their edges. An edge's end that is no
    node goes by its plain name."""
    spark = nodes.sparkSession
    nodes, edges = _named(nodes, edges, order)
    ids = stored(chart_ids(nodes), "ids")
    n = nodes.join(ids, "id").select(F.lit(1).alias("part"), F.col("_nth").alias("nth"), F.concat(F.lit("  "), "cid", F.lit("["), mermaid_label(F.coalesce("label", F.col("id").cast("string"))), F.lit("]")).alias("line"))
    both = edges.join(ids.select(F.col("id").alias("src"), F.col("cid").alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.col("cid").alias("b")), "dst", "left")
    arrow = F.when(F.col("weight").isNotNull() & (F.col("weight") != 1), F.concat(F.lit(" -->|"), number_text(F.col("weight")), F.lit("| "))).otherwise(" --> ")
    e = F.concat(F.lit("  "), F.coalesce("a", graph_id(F.col("src").cast("string"))), arrow, F.coalesce("b", graph_id(F.col("dst").cast("string"))))
    return _all(_lines(spark, 0, [f"flowchart {direction}"]), n, both.select(F.lit(2).alias("part"), F.col("_nth").alias("nth"), e.alias("line")))


def cypher(nodes: DataFrame, edges: DataFrame, label: str = "File", kind: str = "IMPORTS", order: list[str] | None = None) -> DataFrame:
    """MERGE statements of nodes, then of edges. A label equal to the id, or null, is not written."""
    of_nodes, of_edges = _attributes(nodes, ("id", "label")), _attributes(edges, ("src", "dst", "weight"))
    nodes, edges = _named(nodes, edges, order)
    quoted = lambda c: F.concat(F.lit("'"), escape_cypher(c), F.lit("'"))
    plain = lambda c: "".join(x if x.isascii() and (x.isalnum() or x == "_") else "_" for x in c)
    name = lambda c: f"n_{plain(c)}" if not c or c[0].isdigit() else plain(c)
    value = lambda c, k: _text(c, k) if k != "string" else quoted(_text(c, k))
    id_ = F.col("id").cast("string")
    props = [F.concat(F.lit("path: "), quoted(id_)), F.when((F.length("label") > 0) & (F.col("label") != id_), F.concat(F.lit("label: "), quoted(F.col("label")))), *(F.concat(F.lit(f"{name(c)}: "), value(c, k)) for c, k in of_nodes)]
    n = F.concat(F.lit(f"MERGE (:{label} {{ "), F.concat_ws(", ", *props), F.lit(" });"))
    props = [F.concat(F.lit("weight: "), F.coalesce(number_text(F.col("weight")), F.lit("1"))), *(F.concat(F.lit(f"{name(c)}: "), value(c, k)) for c, k in of_edges)]
    end = lambda c: quoted(F.col(c).cast("string"))
    e = F.concat(F.lit(f"MATCH (a:{label} {{ path: "), end("src"), F.lit(f" }}), (b:{label} {{ path: "), end("dst"), F.lit(f" }}) MERGE (a)-[:{kind} {{ "), F.concat_ws(", ", *props), F.lit(" }]->(b);"))
    return _all(nodes.select(F.lit(1).alias("part"), F.col("_nth").alias("nth"), n.alias("line")), edges.select(F.lit(2).alias("part"), F.col("_nth").alias("nth"), e.alias("line")))
