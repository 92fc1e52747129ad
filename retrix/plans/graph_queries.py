"""Queries over a property graph of regions, nations, customers, suppliers and orders, and one of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import graph as G
from retrix.operators.writes import latest
from retrix.plans.registry import query
from retrix.sources.tables import cut, table

GRAPH = """
    WITH RECURSIVE nodes AS (
        SELECT 'r' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders
    ), edges AS (
        SELECT 'r' || n_regionkey AS src, 'HAS' AS type, 'n' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'BUYS', 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 'SELLS', 's' || s_suppkey FROM supplier
        UNION ALL SELECT 'c' || o_custkey, 'PLACED', 'o' || o_orderkey FROM orders
    ), sym AS (SELECT src, type, dst FROM edges UNION ALL SELECT dst, type, src FROM edges)
"""


def nodes(spark: SparkSession, directory: str) -> DataFrame:
    parts = (("region", "r_regionkey", "r"), ("nation", "n_nationkey", "n"), ("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s"), ("orders", "o_orderkey", "o"))
    out = None
    for name, key, prefix in parts:
        one = table(spark, directory, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit("order" if name == "orders" else name).alias("type"))
        out = one if out is None else out.union(one)
    return out


def edges(spark: SparkSession, directory: str) -> DataFrame:
    parts = (
        ("nation", "n_regionkey", "r", "HAS", "n_nationkey", "n"), ("customer", "c_nationkey", "n", "BUYS", "c_custkey", "c"),
        ("supplier", "s_nationkey", "n", "SELLS", "s_suppkey", "s"), ("orders", "o_custkey", "c", "PLACED", "o_orderkey", "o"),
    )
    out = None
    for name, a, x, kind, b, y in parts:
        one = table(spark, directory, name).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(y), F.col(b).cast("string")).alias("dst"))
        out = one if out is None else out.union(one)
    return out


@query(GRAPH + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes and edges."""
    a = nodes(spark, directory).agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("one"))
    return a.join(edges(spark, directory).agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("one")), "one").drop("one")


@query(GRAPH + "SELECT type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY type")
def graph_valid_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Edges whose ends exist, by type."""
    return G.valid_edges(edges(spark, directory), nodes(spark, directory)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(GRAPH + "SELECT id, count(src) AS degree FROM nodes LEFT JOIN sym ON src = id GROUP BY id HAVING count(src) > 20")
def graph_hubs(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes with more than twenty edges."""
    return G.degrees(nodes(spark, directory), edges(spark, directory)).where("degree > 20").select("id", "degree")


@query(GRAPH + "SELECT id, type FROM nodes WHERE id NOT IN (SELECT src FROM sym)")
def graph_isolated(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes without edges."""
    return G.degrees(nodes(spark, directory), edges(spark, directory)).where("degree = 0").select("id", "type")


@query(
    GRAPH
    + """, hop(seed, id, hops) AS (SELECT 'n3', 'n3', 0 UNION SELECT seed, dst, hops + 1 FROM hop JOIN sym ON src = hop.id WHERE hops < 2)
    SELECT seed, id, min(hops)::INT AS hops FROM hop GROUP BY ALL"""
)
def graph_khop(spark: SparkSession, directory: str) -> DataFrame:
    """Everything within two steps of a nation, whatever the direction."""
    own = nodes(spark, directory)
    return G.k_hop(edges(spark, directory), own.where("id = 'n3'").select("id"), 2)


@query(GRAPH + "SELECT e.src, e.type, e.dst, n.type AS dst_type FROM edges e JOIN nodes n ON n.id = e.dst")
def graph_context(spark: SparkSession, directory: str) -> DataFrame:
    """What every node holds."""
    found = edges(spark, directory)
    return found.join(nodes(spark, directory).select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst").select("src", "type", "dst", "dst_type")


@query(GRAPH + "SELECT n.id, count(b.dst) AS neighbours, list_sort(list(DISTINCT b.type) FILTER (b.type IS NOT NULL)) AS kinds FROM nodes n LEFT JOIN sym b ON b.src = n.id GROUP BY n.id")
def graph_neighbourhood(spark: SparkSession, directory: str) -> DataFrame:
    """Neighbours of every node, also of those that have none."""
    wanted = nodes(spark, directory)
    joined = wanted.select("id").join(G.both_ways(edges(spark, directory)).withColumnRenamed("src", "id"), "id", "left")
    return joined.groupBy("id").agg(F.count("dst").alias("neighbours"), F.sort_array(F.collect_set("type")).alias("kinds"))


@query(
    GRAPH
    + """ SELECT a.type AS src_type, e.type AS relation, b.type AS dst_type, count(*) AS freq, round(least(count(*) / 100.0::DOUBLE, 1), 6) AS confidence
    FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL HAVING count(*) > 5 ORDER BY freq DESC, relation LIMIT 20"""
)
def graph_patterns(spark: SparkSession, directory: str) -> DataFrame:
    """The most frequent kinds of edges."""
    own = nodes(spark, directory)
    typed = edges(spark, directory).join(own.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(own.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    counted = typed.groupBy("src_type", F.col("type").alias("relation"), "dst_type").agg(F.count(F.lit(1)).alias("freq")).where("freq > 5")
    return counted.withColumn("confidence", F.round(F.least(F.col("freq") / 100, F.lit(1.0)), 6)).orderBy(F.desc("freq"), "relation").limit(20)


@query(
    GRAPH
    + """, p AS (
        SELECT a.type || '>' || b.type AS pattern FROM edges a JOIN edges b ON b.src = a.dst
        UNION ALL SELECT a.type || '>' || b.type || '>' || c.type FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst
    ) SELECT pattern, count(*)::BIGINT AS paths, round(least(count(*) / 10.0::DOUBLE, 1), 6) AS confidence FROM p GROUP BY pattern HAVING count(*) >= 3"""
)
def graph_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Sequences of relations along paths of two and three edges."""
    own = edges(spark, directory)
    both = G.path_patterns(own, 2).union(G.path_patterns(own, 3)).where("paths >= 3")
    return both.withColumn("confidence", F.round(F.least(F.col("paths") / 10, F.lit(1.0)), 6))


@query(GRAPH + "SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC, type LIMIT 3")
def graph_summary(spark: SparkSession, directory: str) -> DataFrame:
    """The three most frequent relations."""
    return edges(spark, directory).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(3)


@query(GRAPH + "SELECT id, round(count(src)::DOUBLE / (SELECT count(*) - 1 FROM nodes), 9) AS centrality FROM nodes LEFT JOIN sym ON src = id GROUP BY id ORDER BY centrality DESC, id LIMIT 5")
def graph_central(spark: SparkSession, directory: str) -> DataFrame:
    """The five most central nodes by degree."""
    return G.top_central(nodes(spark, directory), edges(spark, directory))


@query()
def graph_central_entities(spark: SparkSession, directory: str) -> DataFrame:
    """The five most central nodes by degree and betweenness, half and half."""
    return G.central_entities(nodes(spark, directory), edges(spark, directory))


@query(GRAPH + ", gone AS (SELECT id FROM nodes WHERE type = 'nation' AND id LIKE '%1') SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS edges")
def graph_delete(spark: SparkSession, directory: str) -> DataFrame:
    """The graph after deleting nodes with their edges."""
    own = nodes(spark, directory)
    n, e = G.delete_nodes(own, edges(spark, directory), own.where("type = 'nation' AND id LIKE '%1'").select("id"))
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("one")).join(e.agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("one")), "one").drop("one")


@query()
def graph_pagerank(spark: SparkSession, directory: str) -> DataFrame:
    """The twenty nodes with the highest rank of the whole graph."""
    own = cut(nodes(spark, directory).select("id"))
    return G.page_rank(own, cut(edges(spark, directory))).select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


@query()
def graph_communities(spark: SparkSession, directory: str) -> DataFrame:
    """Communities of three nodes and more, with their parts of the modularity."""
    links = edges(spark, directory)
    found = G.communities(nodes(spark, directory), links)
    return G.modularity(found, links).where("members >= 3").withColumn("modularity", F.round("modularity", 9))


_ONCE = "WITH c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) AS n FROM chunks) WHERE n = 1)"


@query(
    _ONCE
    + """, i AS (SELECT file_path, list_sort(list(DISTINCT x)) AS imports FROM (SELECT file_path, unnest(relations['imports']) AS x FROM c WHERE file_path IS NOT NULL) GROUP BY file_path),
    s AS (SELECT file_path, list_sort(list(DISTINCT x)) AS symbols FROM (SELECT file_path, unnest(symbols) AS x FROM c WHERE file_path IS NOT NULL) GROUP BY file_path)
    SELECT f.file_path, coalesce(len(imports), 0)::INT AS n_imports, coalesce(len(symbols), 0)::INT AS n_symbols FROM (SELECT DISTINCT file_path FROM c WHERE file_path IS NOT NULL) f LEFT JOIN i USING (file_path) LEFT JOIN s USING (file_path)"""
)
def code_dependencies(spark: SparkSession, directory: str) -> DataFrame:
    """What every file imports and holds; files without either come out too."""
    rows = latest(table(spark, directory, "chunks"), ["id"], F.asc_nulls_first("created_at")).where("file_path IS NOT NULL")
    imports = rows.select("file_path", F.explode(F.col("relations")["imports"]).alias("x")).groupBy("file_path").agg(F.countDistinct("x").alias("n_imports"))
    held = rows.select("file_path", F.explode("symbols").alias("x")).groupBy("file_path").agg(F.countDistinct("x").alias("n_symbols"))
    joined = rows.select("file_path").distinct().join(imports, "file_path", "left").join(held, "file_path", "left")
    return joined.select("file_path", F.coalesce("n_imports", F.lit(0)).cast("int").alias("n_imports"), F.coalesce("n_symbols", F.lit(0)).cast("int").alias("n_symbols"))


@query(_ONCE + ", k AS (SELECT DISTINCT unnest(symbols) AS name FROM c), called AS (SELECT DISTINCT unnest(relations['calls']) AS name FROM c) SELECT name FROM called WHERE name NOT IN (SELECT name FROM k WHERE name IS NOT NULL)")
def expansion_candidates(spark: SparkSession, directory: str) -> DataFrame:
    """Names that are called but not known yet."""
    rows = table(spark, directory, "chunks")
    known = rows.select(F.explode("symbols").alias("name")).distinct()
    return rows.select(F.explode(F.col("relations")["calls"]).alias("name")).distinct().join(known, "name", "left_anti")


@query("SELECT trim(split_part(l, '->', 1)) AS src, trim(split_part(l, '->', 2)) AS type, trim(split_part(l, '->', 3)) AS dst FROM (SELECT n_name || ' -> in -> ' || n_regionkey AS l FROM nation UNION ALL SELECT r_name || ' is no edge' FROM region) WHERE len(string_split(l, '->')) = 3")
def relation_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Edges read out of lines of text."""
    lines = table(spark, directory, "nation").select(F.concat("n_name", F.lit(" -> in -> "), F.col("n_regionkey").cast("string")).alias("l"))
    return G.triples(lines.union(table(spark, directory, "region").select(F.concat("r_name", F.lit(" is no edge")))), "l")
