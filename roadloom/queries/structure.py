"""Graph access, changes and numberings, jobs over partitions, and counters of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import graphs, relational
from roadloom.plans import batched, flow, frontier, hierarchy, jobs
from roadloom.queries.graphs import BORDER_SQL, CELL_SQL, all_pairs_sql
from roadloom.queries.registry import registry
from roadloom.session import saved
from roadloom.sources.derived import COPURCHASE_SQL, GEO_SQL, copurchase, geo, grid_cells, grid_cells_sql, grid_edges, grid_nodes, grid_sql, parts, table

QUERIES, ORACLE_SQL, query = registry()

#: Line items as arcs from parts to suppliers, numbered; many are parallel.
ITEMS_SQL = "items AS (SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey, l_quantity, l_orderkey, l_linenumber, l_extendedprice) - 1 AS edge_id, l_partkey AS src, l_suppkey AS dst, l_quantity::BIGINT AS w FROM lineitem)"


def _items(spark, sf_dir):
    arcs = table(spark, sf_dir, "lineitem").select(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice").alias("k"), F.lit(1).cast("long").alias("one"))
    return saved(relational.global_prefix_sums(arcs, "k", "one", 8).select((F.col("prefix") - 1).alias("edge_id"), F.col("k.l_partkey").alias("src"), F.col("k.l_suppkey").alias("dst"), F.col("k.l_quantity").cast("long").alias("w")))


@query(f"WITH {COPURCHASE_SQL} SELECT greatest(max(greatest(src, dst)) + 1, 1)::BIGINT AS nodes, count(*) AS arcs, 1::BIGINT AS nodes_of_none FROM copurchase")
def node_count(spark, sf_dir):
    """Nodes are counted to the largest id; a graph without arcs has one."""
    e = copurchase(spark, sf_dir)
    return graphs.node_count(e).join(graphs.node_count(e.limit(0)).select(F.col("nodes").alias("nodes_of_none")))


@query(f"WITH {COPURCHASE_SQL} SELECT i::BIGINT AS node, count(src) AS degree FROM range(0, (SELECT max(greatest(src, dst)) + 1 FROM copurchase)) t(i) LEFT JOIN copurchase ON src = i GROUP BY i")
def node_degrees(spark, sf_dir):
    """Arcs out of every node, those without any too."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return graphs.node_set(e).join(relational.out_degrees(e), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"WITH {ITEMS_SQL} SELECT edge_id, src, dst, n - 1 AS beside FROM (SELECT *, count(*) OVER (PARTITION BY src, dst) AS n FROM items) WHERE n > 1")
def parallel_arcs(spark, sf_dir):
    return graphs.parallel_arcs(_items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL}, a AS (SELECT * FROM items), b AS (SELECT edge_id - 1 AS edge_id, src, dst FROM items) SELECT a.edge_id, a.src = b.src AND a.dst = b.dst AS parallel FROM a JOIN b USING (edge_id)")
def is_parallel(spark, sf_dir):
    """Whether each arc is parallel to the next."""
    e = _items(spark, sf_dir)
    after = e.select((F.col("edge_id") - 1).alias("edge_id"), F.col("src").alias("s"), F.col("dst").alias("d"))
    return e.join(after, "edge_id").select("edge_id", graphs.is_parallel(F.col("src"), F.col("dst"), F.col("s"), F.col("d")).alias("parallel"))


@query(f"WITH {ITEMS_SQL}, w AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 100 AS dst FROM orders) SELECT w.src, w.dst, min(edge_id) AS edge_id FROM w LEFT JOIN items i ON i.src = w.src AND i.dst = w.dst GROUP BY ALL")
def find_edge(spark, sf_dir):
    """The first arc of asked pairs, null for pairs without one."""
    wanted = table(spark, sf_dir, "orders").selectExpr("o_custkey AS src", "o_orderkey % 100 AS dst").distinct()
    return graphs.found_edges(_items(spark, sf_dir), wanted)


_CHANGED = f"""{ITEMS_SQL}, more AS (SELECT s_suppkey AS src, s_nationkey::BIGINT AS dst, floor(abs(s_acctbal))::BIGINT AS w FROM supplier),
changed AS (SELECT * FROM items WHERE edge_id % 5 <> 0 UNION ALL SELECT (SELECT max(edge_id) FROM items WHERE edge_id % 5 <> 0) + row_number() OVER (ORDER BY src, dst, w), src, dst, w FROM more)"""


@query(f"WITH {_CHANGED} SELECT * FROM changed")
def changed_graph(spark, sf_dir):
    """A fifth of the arcs removed, then others inserted."""
    e = _items(spark, sf_dir)
    more = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS src", "cast(s_nationkey AS bigint) AS dst", "cast(floor(abs(s_acctbal)) AS bigint) AS w")
    return graphs.inserted(graphs.removed(e, e.where("edge_id % 5 = 0")), more)


@query(f"WITH {ITEMS_SQL}, n AS (SELECT DISTINCT dst * 1000 + src AS id FROM items) SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS new FROM n")
def renumbering(spark, sf_dir):
    return graphs.renumbering(_items(spark, sf_dir).selectExpr("dst * 1000 + src AS id"))


@query("WITH l AS (SELECT c_custkey AS node, (c_custkey * 7919) % 97 AS label FROM customer), f AS (SELECT label, min(node) AS first FROM l GROUP BY label) SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS cell FROM l JOIN f USING (label)")
def compact(spark, sf_dir):
    return graphs.compacted(table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "(c_custkey * 7919) % 97 AS cell"))


@query(f"WITH {grid_cells_sql(16)} SELECT level::BIGINT AS level, max(cell) + 1 AS cells FROM cells GROUP BY level")
def cells_on_level(spark, sf_dir):
    return graphs.cells_on_level(grid_cells(spark, 16)).select(F.col("level").cast("long").alias("level"), "cells")


@query(f"WITH {grid_cells_sql(16)}, p AS (SELECT i AS a, (i * 37 + 11) % 256 AS b FROM range(256) t(i)) SELECT a, b, x.level::BIGINT AS level, x.cell = y.cell AS same FROM p JOIN cells x ON x.node = a JOIN cells y ON y.node = b AND y.level = x.level")
def same_cell(spark, sf_dir):
    pairs = spark.range(256).selectExpr("id AS a", "(id * 37 + 11) % 256 AS b")
    return graphs.same_cell(grid_cells(spark, 16), pairs).withColumn("level", F.col("level").cast("long"))


_GROUPS = f"""{grid_sql(16)}, {grid_cells_sql(16)}, c AS (SELECT node, cell FROM cells WHERE level = 0), g AS (SELECT DISTINCT cell, cell % 7 AS grp FROM c),
s AS (SELECT cell, count(*) AS size FROM c GROUP BY cell), x AS (SELECT least(a.cell, b.cell) AS a, greatest(a.cell, b.cell) AS b FROM grid JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.cell <> b.cell)"""


def _contracted(spark):
    cells = grid_cells(spark, 16).where("level = 0").select("node", "cell")
    sizes, arcs = hierarchy.cell_graph(grid_edges(spark, 16), cells)
    return graphs.contracted(sizes, arcs, sizes.selectExpr("cell", "cell % 7 AS grp"))


@query(f"WITH {_GROUPS} SELECT least(p.grp, q.grp)::BIGINT AS a, greatest(p.grp, q.grp)::BIGINT AS b, count(*) AS w FROM x JOIN g p ON p.cell = x.a JOIN g q ON q.cell = x.b WHERE p.grp <> q.grp GROUP BY ALL")
def contracted_arcs(spark, sf_dir):
    return _contracted(spark)[1]


@query(f"WITH {_GROUPS} SELECT grp::BIGINT AS cell, sum(size)::BIGINT AS size FROM s JOIN g USING (cell) GROUP BY grp")
def contracted_sizes(spark, sf_dir):
    return _contracted(spark)[0]


#: Cells of a grid that fall into pieces: stripes of seven nodes, and every fourth node.
STRIPES = "CASE level WHEN 0 THEN (node // 7) % 9 ELSE node % 4 END"
_STRIPED = f"""{grid_sql(12)}, cells AS (SELECT node, level, {STRIPES} AS cell FROM range(144) n(node), range(2) l(level)),
inner_arcs AS (SELECT a.level, a.cell, src, dst FROM grid JOIN cells a ON a.node = src JOIN cells b ON b.node = dst AND b.level = a.level AND b.cell = a.cell),
both_ways AS (SELECT level, src, dst FROM inner_arcs UNION SELECT level, dst, src FROM inner_arcs),
reach(level, node, other) AS (SELECT level, node, node FROM cells UNION SELECT r.level, r.node, e.dst FROM reach r JOIN both_ways e ON e.level = r.level AND e.src = r.other),
piece AS (SELECT level, node, min(other) AS first FROM reach GROUP BY ALL)"""


def _striped(spark):
    return spark.range(288).selectExpr("id % 144 AS node", "cast(id div 144 AS int) AS level").selectExpr("node", "level", f"{STRIPES.replace('//', 'div')} AS cell")


@query(f"""WITH RECURSIVE {_STRIPED}, p AS (SELECT level, cell, first, count(*) AS n FROM piece JOIN cells USING (level, node) GROUP BY ALL), c AS (SELECT level, cell, count(*) AS pieces, sum(n)::BIGINT AS n FROM p GROUP BY ALL)
SELECT level::BIGINT AS level, count(*) AS cells, count(*) FILTER (pieces = 1) AS whole, sum(pieces)::BIGINT AS pieces, max(n) AS largest FROM c GROUP BY level""")
def cell_components(spark, sf_dir):
    """Pieces of the cells of each level."""
    return jobs.cell_components(grid_edges(spark, 12), _striped(spark)).withColumn("level", F.col("level").cast("long"))


@query(f"WITH RECURSIVE {_STRIPED} SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS cell FROM piece WHERE level = 0")
def fragments(spark, sf_dir):
    return graphs.fragments(grid_edges(spark, 12), _striped(spark).where("level = 0").select("node", "cell"))


@query(f"WITH RECURSIVE {_STRIPED} SELECT count(DISTINCT first) AS sets FROM piece WHERE level = 1")
def number_of_sets(spark, sf_dir):
    e, cells = grid_edges(spark, 12), _striped(spark).where("level = 1").select("node", "cell")
    a, b = (cells.select(F.col("node").alias(k), F.col("cell").alias(f"c_{k}")) for k in ("src", "dst"))
    inner = e.join(a, "src").join(b, "dst").where("c_src = c_dst")
    return graphs.number_of_sets(frontier.weak_components(inner, cells.select("node")))


@query("""WITH c AS (SELECT i AS node, l AS level, CASE l WHEN 0 THEN i % 10 ELSE i // 50 END AS cell FROM range(200) n(i), range(2) t(l))
SELECT a.level::BIGINT AS level, a.cell::BIGINT AS cell FROM c a JOIN c b ON a.node = b.node AND b.level = a.level + 1 GROUP BY ALL HAVING count(DISTINCT b.cell) > 1
UNION ALL SELECT level::BIGINT, cell::BIGINT FROM c WHERE false""")
def nesting_check(spark, sf_dir):
    """The cells of a broken directory that lie in several cells above."""
    c = spark.range(400).selectExpr("id % 200 AS node", "cast(id div 200 AS int) AS level").selectExpr("node", "level", "CASE level WHEN 0 THEN node % 10 ELSE node div 50 END AS cell")
    return hierarchy.nesting_violations(c).select(F.col("level").cast("long").alias("level"), "cell")


_DFS = """adj AS (SELECT src, list(DISTINCT dst ORDER BY dst) AS out FROM grid GROUP BY src),
walk(pos, node, parent, stack, seen) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT, [{'n': 0::BIGINT, 'p': NULL::BIGINT}], [0::BIGINT]
  UNION ALL SELECT pos + 1, rest[-1].n, rest[-1].p, rest, seen || fresh FROM (
    SELECT pos, seen, list_filter(out, lambda v: NOT list_contains(seen, v)) AS fresh, stack[:-2] || list_transform(list_filter(out, lambda v: NOT list_contains(seen, v)), lambda v: {'n': v, 'p': node}) AS rest FROM walk JOIN adj ON src = node)
  WHERE len(rest) > 0)"""


@query(f"WITH RECURSIVE {grid_sql(6, True)}, {_DFS} SELECT 0::BIGINT AS instance, pos, node, parent FROM walk")
def dfs_order(spark, sf_dir):
    """The order in which a stack hands out the nodes of a one-way grid."""
    return graphs.depth_first(grid_edges(spark, 6, one_way=True).selectExpr("0L AS instance", "0L AS start", "src", "dst"))


@query(f"WITH {BORDER_SQL}, top AS (SELECT node, max(border_level) AS b FROM (SELECT src AS node, border_level FROM arcs UNION ALL SELECT dst, border_level FROM arcs) GROUP BY node) SELECT count(*) FILTER (b > 0) AS nodes FROM top")
def on_a_border(spark, sf_dir):
    return hierarchy.on_a_border(grid_edges(spark, 16), grid_cells(spark, 16))


_ORDER = f"""{BORDER_SQL}, top AS (SELECT node, max(border_level) AS b FROM (SELECT src AS node, border_level FROM arcs UNION ALL SELECT dst, border_level FROM arcs) GROUP BY node),
k AS (SELECT node, list(cell ORDER BY level DESC) AS c FROM cells GROUP BY node), o AS (SELECT node AS old, (row_number() OVER (ORDER BY b DESC, c, node) - 1)::BIGINT AS new FROM top JOIN k USING (node))"""


@query(f"WITH {_ORDER} SELECT s.new AS src, t.new AS dst, w::BIGINT AS w FROM grid JOIN o s ON s.old = src JOIN o t ON t.old = dst")
def renumbered_edges(spark, sf_dir):
    return jobs.renumber(grid_edges(spark, 16), grid_nodes(spark, 16), grid_cells(spark, 16))[0].withColumn("w", F.col("w").cast("long"))


@query(f"WITH {_ORDER} SELECT new AS node, level::BIGINT AS level, cell::BIGINT AS cell FROM cells JOIN o ON old = node")
def renumbered_directory(spark, sf_dir):
    return jobs.renumber(grid_edges(spark, 16), grid_nodes(spark, 16), grid_cells(spark, 16))[2].withColumn("level", F.col("level").cast("long"))


_BORDER_NODES = f"""{grid_sql(16)}, {grid_cells_sql(16)}, border AS (
  SELECT DISTINCT a.level, n.cell, n.node FROM grid JOIN cells a ON a.node = src JOIN cells b ON b.node = dst AND b.level = a.level AND b.cell <> a.cell, LATERAL (SELECT a.cell AS cell, src AS node UNION ALL SELECT b.cell, dst) n),
s AS (SELECT level, cell, count(*) AS n FROM border GROUP BY ALL)"""


@query(f"WITH {_BORDER_NODES} SELECT level::BIGINT AS level, count(*) AS cells, avg(n) AS mean, list(n ORDER BY n)[count(*) // 2 + 1] AS median, max(n) AS largest, sum(n * n) / sum(n) AS biased_mean FROM s GROUP BY level")
def border_stats(spark, sf_dir):
    border = hierarchy.border_nodes(grid_edges(spark, 16), grid_cells(spark, 16))
    return relational.border_statistics(border).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_BORDER_NODES} SELECT level::BIGINT AS level, cell::BIGINT AS cell, node::BIGINT AS node, row_number() OVER (PARTITION BY level, cell ORDER BY node) - 1 AS place FROM border")
def border_places(spark, sf_dir):
    t = hierarchy.cell_distances(grid_edges(spark, 16), grid_cells(spark, 16))
    return hierarchy.border_places(t).withColumn("level", F.col("level").cast("long"))


@query("SELECT level, count(DISTINCT p) AS cells, count(*) AS nodes FROM (SELECT c_custkey % 100 + 1 AS p, floor(log2(c_custkey % 100 + 1))::BIGINT AS level FROM customer) GROUP BY level")
def partition_levels(spark, sf_dir):
    return relational.partition_levels(table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "c_custkey % 100 + 1 AS partition_id"))


# Searches with targets, paths and counters

TARGETS = "SELECT s AS source, (s * 29 + k * 53) % 300 AS target FROM range(0, 256, 51) a(s), range(4) b(k)"


def _wanted(spark):
    return spark.range(0, 256, 51).selectExpr("id AS source", "transform(sequence(0L, 3L), k -> (id * 29 + k * 53) % 300) AS targets")


_REACHED = f"""SELECT source, target, dist AS distance, min(dist IS NOT NULL) OVER (PARTITION BY source) AS all_reached FROM (
  SELECT t.source, t.target, sp.dist FROM (SELECT DISTINCT * FROM ({TARGETS})) t LEFT JOIN sp ON sp.source = t.source AND sp.node = t.target)"""


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", _REACHED))
def one_to_targets(spark, sf_dir):
    """One search a source to several targets, some of which are no nodes of the graph."""
    return batched.one_to_many(grid_edges(spark, 16), _wanted(spark)).drop("path")


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", _REACHED.replace("% 300", "% 256").replace(TARGETS, TARGETS.replace("% 300", "% 256"))))
def mld_one_to_many(spark, sf_dir):
    """One overlay search a source to several targets."""
    wanted = _wanted(spark).selectExpr("source", "transform(targets, (t, k) -> (source * 29 + k * 53) % 256) AS targets")
    return hierarchy.overlay_one_to_many(grid_edges(spark, 16), grid_cells(spark, 16), wanted)


_SOME = "SELECT s AS source, (s * 29 + k * 53) % 256 AS target FROM range(0, 256, 51) a(s), range(4) b(k)"


def _some_pairs(spark):
    return spark.range(0, 256, 51).selectExpr("id AS source", "explode(transform(sequence(0L, 3L), k -> (id * 29 + k * 53) % 256)) AS target").distinct()


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", f""", p AS (SELECT DISTINCT * FROM ({_SOME})),
first_arc AS (SELECT src, dst, min(w) AS w FROM grid GROUP BY ALL)
SELECT p.source, p.target, sp.dist AS distance, sp.dist AS along FROM p JOIN sp ON sp.source = p.source AND sp.node = p.target"""))
def path_arcs(spark, sf_dir):
    """Distances beside the summed weights of the arcs along the paths."""
    e = saved(frontier.edge_ids(grid_edges(spark, 16)))
    paths = saved(batched.shortest_paths(e, _some_pairs(spark)))
    along = batched.path_edges(paths, e).groupBy("source", "target").agg(F.sum("w").alias("along"))
    return paths.join(along, ["source", "target"], "left").select("source", "target", "distance", F.coalesce("along", F.lit(0)).alias("along"))


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", f""", p AS (SELECT DISTINCT * FROM ({_SOME})),
goal AS (SELECT p.source, p.target, sp.dist FROM p JOIN sp ON sp.source = p.source AND sp.node = p.target),
done AS (SELECT g.source, g.target, sp.node, sp.dist FROM goal g JOIN sp ON sp.source = g.source AND (sp.dist, sp.node) <= (g.dist, g.target)),
seen AS (SELECT d.source, d.target, e.dst AS node, d.dist + e.w AS cand, min(d.dist + e.w) OVER (PARTITION BY d.source, d.target, e.dst ORDER BY d.dist, d.node, e.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM done d JOIN grid e ON e.src = d.node WHERE d.node <> d.target AND e.dst <> d.source)
SELECT g.source, g.target, g.dist AS distance, (SELECT count(*) FROM done d WHERE d.source = g.source AND d.target = g.target) AS settled,
  1 + (SELECT count(DISTINCT node) FROM seen s WHERE s.source = g.source AND s.target = g.target) AS inserted,
  (SELECT count(*) FROM seen s WHERE s.source = g.source AND s.target = g.target AND s.cand < s.best) AS decreased FROM goal g"""))
def search_counters(spark, sf_dir):
    """What plain searches did to their queues."""
    return batched.pair_distances(grid_edges(spark, 16), _some_pairs(spark)).select("source", "target", "distance", "settled", "inserted", "decreased")


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(256) t(i)", f""", p AS (SELECT DISTINCT * FROM ({_SOME}))
SELECT p.source, p.target, a.dist AS distance, true AS on_the_way FROM p JOIN sp a ON a.source = p.source AND a.node = p.target"""))
def meeting_nodes(spark, sf_dir):
    """Whether the node where two searches met lies on a shortest path."""
    e = grid_edges(spark, 16)
    met = saved(batched.pair_distances(e, _some_pairs(spark), "bidirectional").select("source", "target", "distance", "meeting"))
    legs = batched.pair_distances(e, met.selectExpr("source", "meeting AS target").union(met.selectExpr("meeting", "target")).distinct()).select("source", "target", "distance")
    a, b = legs.selectExpr("source", "target AS meeting", "distance AS there"), legs.selectExpr("source AS meeting", "target", "distance AS back")
    return met.join(a, ["source", "meeting"]).join(b, ["meeting", "target"]).selectExpr("source", "target", "distance", "there + back = distance AS on_the_way")


_OVERLAY = f"""WITH RECURSIVE {grid_sql(8)}, {grid_cells_sql(8)}, p AS (SELECT DISTINCT s AS source, (s * 29 + k * 53) % 64 AS target FROM range(0, 64, 13) a(s), range(4) b(k)),
arcs AS (SELECT a.level, a.cell, g.src, g.dst, g.w FROM grid g JOIN cells a ON a.node = g.src JOIN cells b ON b.node = g.dst AND b.level = a.level AND b.cell = a.cell),
border AS (SELECT DISTINCT a.level, n.cell, n.node FROM grid JOIN cells a ON a.node = src JOIN cells b ON b.node = dst AND b.level = a.level AND b.cell <> a.cell, LATERAL (SELECT a.cell AS cell, src AS node UNION ALL SELECT b.cell, dst) n),
ways(level, cell, u, v, w) USING KEY (level, u, v) AS (
  SELECT level, cell, node, node, 0::BIGINT FROM border
  UNION SELECT s.level, s.cell, s.u, e.dst, min(s.w + e.w)::BIGINT FROM ways s JOIN arcs e ON e.level = s.level AND e.src = s.v LEFT JOIN recurring.ways r ON r.level = s.level AND r.u = s.u AND r.v = e.dst
  WHERE r.w IS NULL OR s.w + e.w < r.w GROUP BY s.level, s.cell, s.u, e.dst),
over_at AS (SELECT p.source, p.target, c.node, max(c.level) FILTER (c.cell <> s.cell AND c.cell <> t.cell) AS level FROM p JOIN cells s ON s.node = p.source JOIN cells t ON t.node = p.target AND t.level = s.level JOIN cells c ON c.level = s.level GROUP BY ALL),
steps AS (
  SELECT o.source, o.target, g.src, g.dst, g.w FROM over_at o JOIN grid g ON g.src = o.node WHERE o.level IS NULL
  UNION ALL SELECT o.source, o.target, g.src, g.dst, g.w FROM over_at o JOIN grid g ON g.src = o.node JOIN cells a ON a.node = g.src AND a.level = o.level JOIN cells b ON b.node = g.dst AND b.level = o.level AND b.cell <> a.cell
  UNION ALL SELECT o.source, o.target, x.u, x.v, x.w FROM over_at o JOIN ways x ON x.u = o.node AND x.level = o.level JOIN border b ON b.level = x.level AND b.node = x.v),
found(source, target, node, dist) USING KEY (source, target, node) AS (
  SELECT source, target, source, 0::BIGINT FROM p
  UNION SELECT f.source, f.target, e.dst, min(f.dist + e.w)::BIGINT FROM found f JOIN steps e ON e.source = f.source AND e.target = f.target AND e.src = f.node LEFT JOIN recurring.found r ON r.source = f.source AND r.target = f.target AND r.node = e.dst
  WHERE r.dist IS NULL OR f.dist + e.w < r.dist GROUP BY f.source, f.target, e.dst),
done AS (SELECT f.source, f.target, f.node, o.level FROM found f JOIN found g ON g.source = f.source AND g.target = f.target AND g.node = f.target AND (f.dist, f.node) <= (g.dist, g.node) JOIN over_at o ON o.source = f.source AND o.target = f.target AND o.node = f.node)"""


def _few(spark):
    return spark.range(0, 64, 13).selectExpr("id AS source", "explode(transform(sequence(0L, 3L), k -> (id * 29 + k * 53) % 64)) AS target").distinct()


@query(f"{_OVERLAY} SELECT level::BIGINT AS level, count(*) AS settled, count(*) / (SELECT count(*) FROM done) AS share FROM done GROUP BY level")
def query_levels(spark, sf_dir):
    """The levels that overlay searches step over at the nodes they settle."""
    return hierarchy.stepped_levels(grid_edges(spark, 8), grid_cells(spark, 8), _few(spark))


@query(f"{_OVERLAY} SELECT 'mld' AS engine, source, target, 0::BIGINT AS rank, count(*) AS settled FROM done GROUP BY source, target")
def scans(spark, sf_dir):
    """Nodes settled by overlay searches, pair by pair."""
    pairs = _few(spark).withColumn("rank", F.lit(0).cast("long"))
    return hierarchy.scans(grid_edges(spark, 8), grid_cells(spark, 8), pairs).drop("inserted", "decreased")


_TABLES = f"{CELL_SQL}, t AS (SELECT s.level, s.cell, s.u, s.v, s.w FROM sp s JOIN border b ON b.level = s.level AND b.node = s.v)"


@query(f"{_TABLES} SELECT 'row' AS kind, v AS node, w FROM t WHERE level = 1 AND cell = 0 AND u = 3 UNION ALL SELECT 'column', u, w FROM t WHERE level = 1 AND cell = 0 AND v = 24")
def cell_rows(spark, sf_dir):
    """One border node's distances to, and another's from, the border of its cell."""
    t = hierarchy.cell_distances(grid_edges(spark, 8), grid_cells(spark, 8))
    part = lambda kind, node: hierarchy.cell_rows(t, 1, 0, node, kind == "column").select(F.lit(kind).alias("kind"), "node", "w")
    return part("row", 3).union(part("column", 24))


@query(f"{CELL_SQL} SELECT level::BIGINT AS level, count(DISTINCT cell) AS cells, count(*) AS border_nodes FROM border GROUP BY level")
def customized_cells(spark, sf_dir):
    """The cells that have a table, and their border nodes, on each level."""
    t = hierarchy.cell_distances(grid_edges(spark, 8), grid_cells(spark, 8))
    return hierarchy.border_places(t).groupBy(F.col("level").cast("long").alias("level")).agg(F.countDistinct("cell").alias("cells"), F.count(F.lit(1)).alias("border_nodes"))


@query(f"""WITH {COPURCHASE_SQL}, k AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 9 <> 0), e AS (SELECT src, dst, CASE WHEN src % 50 <> 0 THEN w END AS w FROM copurchase)
SELECT 'unknown node' AS problem, src, dst FROM e WHERE src NOT IN (FROM k) OR dst NOT IN (FROM k) UNION ALL SELECT 'no weight', src, dst FROM e WHERE w IS NULL""")
def integrity(spark, sf_dir):
    """Arcs with unknown ends or without a weight, in a graph with both."""
    e = saved(copurchase(spark, sf_dir), placed=True).selectExpr("src", "dst", "CASE WHEN src % 50 <> 0 THEN w END AS w")
    known = table(spark, sf_dir, "customer").selectExpr("c_custkey AS node").where("node % 9 <> 0")
    return relational.integrity_violations(e, known, parts(spark, sf_dir))


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, b(node, hops) USING KEY (node) AS (
  SELECT min(src), 0::BIGINT FROM copurchase UNION SELECT e.dst, min(b.hops + 1)::BIGINT FROM b JOIN copurchase e ON b.node = e.src LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.hops IS NULL GROUP BY e.dst),
far AS (SELECT max(node) AS node FROM b WHERE hops = (SELECT max(hops) FROM b)),
path(pos, node) AS (SELECT b.hops, b.node FROM b JOIN far USING (node)
  UNION ALL SELECT p.pos - 1, (SELECT min(e.src) FROM copurchase e JOIN b y ON y.node = e.src WHERE e.dst = p.node AND y.hops = p.pos - 1) FROM path p WHERE p.pos > 0)
SELECT pos, node FROM path""")
def bfs_path(spark, sf_dir):
    """The way to one of the farthest nodes."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    levels = saved(frontier.bfs_levels(e, e.agg(F.min("src").alias("node"))))
    far = levels.agg(F.max(F.struct("hops", "node")).alias("x")).first()["x"]["node"]
    return frontier.path_to(levels, far)


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, goal AS (SELECT max(dst) AS node FROM copurchase), b(node, hops) USING KEY (node) AS (
  SELECT min(src), 0::BIGINT FROM copurchase UNION SELECT e.dst, min(b.hops + 1)::BIGINT FROM b JOIN copurchase e ON b.node = e.src LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.hops IS NULL GROUP BY e.dst)
SELECT node, hops FROM b WHERE hops <= (SELECT hops FROM b JOIN goal USING (node))""")
def bfs_to_target(spark, sf_dir):
    """Nodes reached up to the level that discovers a target."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return frontier.bfs_levels(e, e.agg(F.min("src").alias("node")), e.agg(F.max("dst").alias("node"))).select("node", "hops")


@query(f"""WITH {grid_sql(4)}, proj AS (SELECT axis, i AS id, CASE axis WHEN 0 THEN i // 4 WHEN 1 THEN i % 4 WHEN 2 THEN i // 4 + i % 4 ELSE i // 4 - i % 4 END AS v FROM range(16) n(i), range(4) a(axis)),
ranked AS (SELECT axis, id, row_number() OVER (PARTITION BY axis ORDER BY v, id) AS r FROM proj),
sides AS (SELECT axis, id, mask, r <= 4 OR r <= 12 AND (mask >> greatest(least(r - 5, 7), 0)) & 1 = 1 AS inside FROM ranked, range(256) m(mask)),
cuts AS (SELECT a.axis, a.mask, count(*) FILTER (a.inside AND NOT b.inside) AS flow FROM grid JOIN sides a ON a.id = src JOIN sides b ON b.id = dst AND b.axis = a.axis AND b.mask = a.mask GROUP BY ALL),
least AS (SELECT axis, min(flow) AS flow FROM cuts GROUP BY axis), best AS (SELECT axis, flow, bit_and(mask) AS mask FROM cuts JOIN least USING (axis, flow) GROUP BY ALL),
pick AS (SELECT axis, mask FROM best ORDER BY flow, least(4 + bit_count(mask), 12 - bit_count(mask)) DESC, axis LIMIT 1)
SELECT id AS node, CASE WHEN inside THEN 2 ELSE 3 END::BIGINT AS partition_id FROM pick JOIN sides USING (axis, mask)""")
def first_cut(spark, sf_dir):
    """The best of the four cuts of a small grid, out of all cuts."""
    return flow.bisection(grid_edges(spark, 4), grid_nodes(spark, 4), 1, least=2)


@query()
def timings(spark, sf_dir):
    """Times of the sampled pairs with both plain engines."""
    e = grid_edges(spark, 16)
    pairs = saved(batched.rank_samples(e, spark.range(0, 256, 85).withColumnRenamed("id", "node")))
    return batched.timed_pairs(e, pairs).union(batched.timed_pairs(e, pairs, "bidirectional"))


@query()
def partition_job(spark, sf_dir):
    """Bisection, pieces and a directory of two levels, as one job."""
    return jobs.partition(grid_edges(spark, 12), grid_nodes(spark, 12), 4, level_sizes=(40, 90))[1].withColumn("level", F.col("level").cast("long"))


@query()
def alpha_cells(spark, sf_dir):
    """Corners of hulls and of alpha shapes of a partition's cells."""
    g = grid_nodes(spark, 16)
    jittered = g.selectExpr("id", "cast(lat + (id * 7919) % 377 AS int) AS lat", "cast(lon + (id * 104729) % 389 AS int) AS lon")
    return jobs.alpha_cells(jittered, grid_cells(spark, 16), 120.0)
