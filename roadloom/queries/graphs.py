"""Traversals, components, trees, flows, hierarchies and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.plans import batched, flow, frontier, hierarchy
from roadloom.queries.registry import registry
from roadloom.session import saved
from roadloom.sources.derived import COPURCHASE_SQL, GEO_SQL, TRADE_SQL, copurchase, geo, grid_cells, grid_cells_sql, grid_edges, grid_nodes, grid_sql, table, trade

QUERIES, ORACLE_SQL, query = registry()


def shortest_sql(with_sql: str, edges: str, source: str, select: str) -> str:
    return f"""WITH RECURSIVE {with_sql}, sp(node, dist) USING KEY (node) AS (
  SELECT {source}::BIGINT, 0::BIGINT
  UNION SELECT e.dst::BIGINT, min(s.dist + e.w)::BIGINT FROM sp s JOIN {edges} e ON s.node = e.src LEFT JOIN recurring.sp r ON r.node = e.dst
  WHERE r.dist IS NULL OR s.dist + e.w < r.dist GROUP BY e.dst)
{select}"""


def all_pairs_sql(with_sql: str, edges: str, sources: str, select: str) -> str:
    return f"""WITH RECURSIVE {with_sql}, sp(source, node, dist) USING KEY (source, node) AS (
  SELECT s::BIGINT, s::BIGINT, 0::BIGINT FROM ({sources}) q(s)
  UNION SELECT s.source, e.dst::BIGINT, min(s.dist + e.w)::BIGINT FROM sp s JOIN {edges} e ON s.node = e.src LEFT JOIN recurring.sp r ON r.source = s.source AND r.node = e.dst
  WHERE r.dist IS NULL OR s.dist + e.w < r.dist GROUP BY s.source, e.dst)
{select}"""


def _nodes(edges):
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _some(spark, side, step):
    return spark.range(0, side * side, step).withColumnRenamed("id", "node")


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, b(node, hops) USING KEY (node) AS (
  SELECT min(src), 0::BIGINT FROM copurchase UNION SELECT e.dst, min(b.hops + 1)::BIGINT FROM b JOIN copurchase e ON b.node = e.src LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.hops IS NULL GROUP BY e.dst)
SELECT x.node, x.hops, (SELECT min(e.src) FROM copurchase e JOIN b y ON e.src = y.node WHERE e.dst = x.node AND y.hops = x.hops - 1) AS parent FROM b x""")
def bfs_levels(spark, sf_dir):
    e = saved(copurchase(spark, sf_dir), placed=True)
    return frontier.bfs_levels(e, e.agg(F.min("src").alias("node")))


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, b(node) USING KEY (node) AS (
  SELECT min(src) FROM copurchase UNION SELECT e.dst FROM b JOIN copurchase e ON b.node = e.src LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.node IS NULL AND e.w > 10 GROUP BY e.dst)
SELECT node FROM b""")
def filtered_reach(spark, sf_dir):
    """Nodes reached over arcs that the filter leaves."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return frontier.bfs_levels(e.where("w > 10"), e.agg(F.min("src").alias("node"))).select("node")


@query(shortest_sql(COPURCHASE_SQL, "copurchase", "(SELECT min(src) FROM copurchase)", "SELECT node, dist FROM sp"))
def sssp_copurchase(spark, sf_dir):
    """The flagship: distances from the smallest part, by the batched kernel, or by iterated joins where the arcs don't fit."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return batched.one_to_all(e, e.agg(F.min("src").alias("node")), parents=False).select("node", "dist")


@query(shortest_sql(COPURCHASE_SQL, "copurchase", "(SELECT min(src) FROM copurchase)", "SELECT node, dist FROM sp"))
def sssp_relational(spark, sf_dir):
    """The same distances by iterated joins."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return frontier.distances(e, e.agg(F.min("src")).first()[0])


@query(shortest_sql(grid_sql(16), "grid", "0", "SELECT node, dist FROM sp"))
def sssp_grid16(spark, sf_dir):
    return batched.one_to_all(grid_edges(spark, 16), spark.range(1).withColumnRenamed("id", "node")).select("node", "dist")


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", "SELECT source, node, dist FROM sp"))
def one_to_many(spark, sf_dir):
    return batched.one_to_all(grid_edges(spark, 16), _some(spark, 16, 51)).select("source", "node", "dist")


PAIRS = "SELECT source, node AS target, dist AS distance FROM sp WHERE (source * 31 + node) % 17 = 0"


def _pairs(spark, step=51):
    return _some(spark, 16, step).crossJoin(spark.range(256).withColumnRenamed("id", "target")).where("(node * 31 + target) % 17 = 0").selectExpr("node AS source", "target")


@query(all_pairs_sql(grid_sql(16, True), "grid", "SELECT i FROM range(0, 256, 51) t(i)", PAIRS))
def dijkstra_pairs(spark, sf_dir):
    return batched.pair_distances(grid_edges(spark, 16, one_way=True), _pairs(spark)).where("distance IS NOT NULL").select("source", "target", "distance")


@query(all_pairs_sql(grid_sql(16, True), "grid", "SELECT i FROM range(0, 256, 51) t(i)", PAIRS))
def bidirectional_pairs(spark, sf_dir):
    return batched.pair_distances(grid_edges(spark, 16, one_way=True), _pairs(spark), "bidirectional").where("distance IS NOT NULL").select("source", "target", "distance")


@query(all_pairs_sql(f"{grid_sql(16)}, {grid_cells_sql(16)}", "grid", "SELECT i FROM range(0, 256, 51) t(i)", PAIRS))
def mld_pairs(spark, sf_dir):
    """Distances by stepping over cells: equal to plain searches."""
    return hierarchy.overlay_distances(grid_edges(spark, 16), grid_cells(spark, 16), _pairs(spark)).select("source", "target", "distance")


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", PAIRS))
def bidirectional_mld_pairs(spark, sf_dir):
    return hierarchy.overlay_distances(grid_edges(spark, 16), grid_cells(spark, 16), _pairs(spark), both_ends=True).select("source", "target", "distance")


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 37) t(i)", """, r AS (SELECT source, node, dist, row_number() OVER (PARTITION BY source ORDER BY dist, node) - 1 AS k FROM sp)
SELECT source, node AS target, k::BIGINT AS rank, dist AS distance FROM r WHERE k IN (1, 2, 4, 8, 16, 32, 64, 128)"""))
def ranks_sample(spark, sf_dir):
    return batched.rank_samples(grid_edges(spark, 16), _some(spark, 16, 37))


@query(all_pairs_sql(grid_sql(16), "grid", "SELECT i FROM range(0, 256, 51) t(i)", "SELECT source, node AS target, dist AS length FROM sp WHERE (source * 31 + node) % 17 = 0"))
def path_lengths(spark, sf_dir):
    """The summed weights along the paths found."""
    e = grid_edges(spark, 16)
    paths = batched.shortest_paths(e, _pairs(spark))
    hops = paths.select("source", "target", F.posexplode("path").alias("k", "src")).withColumn("dst", F.expr("lead(src) OVER (PARTITION BY source, target ORDER BY k)"))
    return hops.join(e, ["src", "dst"], "left").groupBy("source", "target").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("length"))


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, few AS (SELECT src, dst FROM copurchase WHERE w >= 45), both_ways AS (SELECT src, dst FROM few UNION SELECT dst, src FROM few), c(node, root) USING KEY (node) AS (
  SELECT src, src FROM both_ways UNION SELECT e.dst, min(c.root) FROM c JOIN both_ways e ON c.node = e.src JOIN recurring.c r ON r.node = e.dst WHERE c.root < r.root GROUP BY e.dst)
SELECT node, root AS component FROM c""")
def heavy_components(spark, sf_dir):
    """Components over the arcs of weight 45 or more, an edge filter that leaves many of them."""
    return frontier.weak_components(saved(copurchase(spark, sf_dir).where("w >= 45")))


@query(f"""WITH RECURSIVE {COPURCHASE_SQL}, both_ways AS (SELECT src, dst FROM copurchase UNION SELECT dst, src FROM copurchase), c(node, root) USING KEY (node) AS (
  SELECT src, src FROM both_ways UNION SELECT e.dst, min(c.root) FROM c JOIN both_ways e ON c.node = e.src JOIN recurring.c r ON r.node = e.dst WHERE c.root < r.root GROUP BY e.dst)
SELECT node, root AS component FROM c""")
def components(spark, sf_dir):
    return frontier.weak_components(saved(copurchase(spark, sf_dir), placed=True))


@query()
def scc(spark, sf_dir):
    """Strong components of all arcs."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    return frontier.strong_components(e, _nodes(e))


@query()
def cycle_check(spark, sf_dir):
    """Whether there are cycles: over all arcs, and over those that go up, which can have none."""
    e = saved(copurchase(spark, sf_dir), placed=True)
    found = lambda arcs, name: frontier.cyclic_core(arcs).agg(F.lit(name).alias("arcs"), (F.count(F.lit(1)) > 0).alias("cyclic"))
    return found(e, "all").union(found(e.where("src < dst"), "upward"))


KRUSKAL_SQL = f"""RECURSIVE {TRADE_SQL}, numbered AS (SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS edge_id, src, dst, w FROM trade WHERE src <> dst),
sorted AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, edge_id DESC) AS k FROM numbered),
grown(k, tree, edge_id, src, dst, w) AS (SELECT 0::BIGINT, range(25), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL SELECT s.k, CASE WHEN g.tree[s.src + 1] = g.tree[s.dst + 1] THEN g.tree ELSE list_transform(g.tree, lambda t: CASE WHEN t = g.tree[s.dst + 1] THEN g.tree[s.src + 1] ELSE t END) END,
    CASE WHEN g.tree[s.src + 1] <> g.tree[s.dst + 1] THEN s.edge_id END, s.src, s.dst, s.w FROM grown g JOIN sorted s ON s.k = g.k + 1)"""


@query(f"WITH {KRUSKAL_SQL} SELECT edge_id, src, dst, w FROM grown WHERE edge_id IS NOT NULL")
def mst(spark, sf_dir):
    """The minimum spanning forest of the trade graph's undirected arcs."""
    return frontier.spanning_forest(frontier.edge_ids(trade(spark, sf_dir).where("src <> dst"))).select("edge_id", "src", "dst", "w")


@query(f"WITH {KRUSKAL_SQL} SELECT sum(w)::BIGINT AS cost FROM grown WHERE edge_id IS NOT NULL")
def mst_cost(spark, sf_dir):
    return mst(spark, sf_dir).agg(F.sum("w").alias("cost"))


@query(f"WITH {grid_sql(8)} SELECT src, count(*) AS out_arcs, sum(w)::BIGINT AS out_weight FROM grid GROUP BY src")
def grid_graph(spark, sf_dir):
    return grid_edges(spark, 8).groupBy("src").agg(F.count(F.lit(1)).alias("out_arcs"), F.sum("w").alias("out_weight"))


def _grid_flows(spark, sides):
    """Capacities on grids from corner to corner, one instance a side length."""
    out = None
    for side in sides:
        part = grid_edges(spark, side).selectExpr(f"{side}L AS instance", "src", "dst", "w AS cap", "0L AS s", f"{side * side - 1}L AS t")
        out = part if out is None else out.union(part)
    return out


def _flow_arcs(spark, sf_dir):
    """Small instances: grids of side 2 to 4, and the trade between regions."""
    of = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS n", "cast(n_regionkey AS bigint) AS r")
    flows = trade(spark, sf_dir).join(of.selectExpr("n AS src", "r AS rs"), "src").join(of.selectExpr("n AS dst", "r AS rd"), "dst")
    regions = flows.where("rs <> rd").selectExpr("100L AS instance", "rs AS src", "rd AS dst", "w AS cap", "0L AS s", "4L AS t")
    return _grid_flows(spark, (2, 3, 4)).union(regions)


#: Every cut of the small instances, by the bits of its source side.
CUTS_SQL = f"""WITH {TRADE_SQL}, {grid_sql(2).replace('rc AS', 'rc2 AS').replace('FROM rc', 'FROM rc2').replace('east', 'east2').replace('south', 'south2').replace('grid AS', 'grid2 AS')},
{grid_sql(3).replace('rc AS', 'rc3 AS').replace('FROM rc', 'FROM rc3').replace('east', 'east3').replace('south', 'south3').replace('grid AS', 'grid3 AS')}, {grid_sql(4)},
arcs AS (SELECT 2 AS instance, src, dst, w AS cap, 4 AS n FROM grid2 UNION ALL SELECT 3, src, dst, w, 9 FROM grid3 UNION ALL SELECT 4, src, dst, w, 16 FROM grid
  UNION ALL SELECT 100, a.n_regionkey, b.n_regionkey, w, 5 FROM trade JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey),
merged AS (SELECT instance, n, src, dst, sum(cap) AS cap FROM arcs GROUP BY ALL),
sides AS (SELECT DISTINCT instance, n, side * 2 + 1 AS side FROM (SELECT DISTINCT instance, n FROM merged) i, range(16384) s(side) WHERE side < 1 << (n - 2)),
cuts AS (SELECT s.instance, s.side, coalesce(sum(cap), 0)::BIGINT AS cut FROM sides s LEFT JOIN merged m ON m.instance = s.instance AND (s.side >> m.src) & 1 = 1 AND (s.side >> m.dst) & 1 = 0 GROUP BY ALL)"""


@query(f"{CUTS_SQL} SELECT instance::BIGINT AS instance, min(cut) AS flow FROM cuts GROUP BY instance")
def max_flow(spark, sf_dir):
    return flow.max_flows(_flow_arcs(spark, sf_dir)).select("instance", "flow")


@query(f"""{CUTS_SQL}, least AS (SELECT instance, min(cut) AS cut FROM cuts GROUP BY instance), best AS (SELECT instance, bit_and(side) AS side FROM cuts JOIN least USING (instance, cut) GROUP BY instance)
SELECT instance::BIGINT AS instance, i::BIGINT AS node FROM best, range(16) t(i) WHERE (side >> i) & 1 = 1""")
def min_cut_side(spark, sf_dir):
    """The source sides of the minimum cuts: the smallest of all, which lies in every other."""
    return flow.max_flows(_flow_arcs(spark, sf_dir)).select("instance", F.explode("source_side").alias("node"))


@query()
def min_cut(spark, sf_dir):
    """Arcs of the minimum cuts of larger grids; their capacities sum to the flows."""
    arcs = _grid_flows(spark, (5, 6, 12))
    side = flow.max_flows(arcs).select("instance", "flow", F.explode("source_side").alias("src"))
    inner = side.select("instance", F.col("src").alias("dst"))
    return arcs.join(side, ["instance", "src"]).join(inner, ["instance", "dst"], "left_anti").groupBy("instance", "flow").agg(F.sum("cap").alias("cut"))


@query(f"WITH {grid_cells_sql(16)} SELECT a.node, a.cell::BIGINT AS cell, b.cell::BIGINT AS parent FROM cells a JOIN cells b ON a.node = b.node AND a.level = 0 AND b.level = 1")
def level_cells(spark, sf_dir):
    c = grid_cells(spark, 16)
    return c.where("level = 0").select("node", "cell").join(c.where("level = 1").select("node", F.col("cell").alias("parent")), "node")


LEVEL_PAIRS = "pairs AS (SELECT i AS a, (i * 37 + 11) % 256 AS b, (i * 101 + 5) % 256 AS n FROM range(256) t(i))"


def _level_pairs(spark):
    p = hierarchy.packed(grid_cells(spark, 16))
    rows = spark.range(256).selectExpr("id AS a", "(id * 37 + 11) % 256 AS b", "(id * 101 + 5) % 256 AS n")
    for k in ("a", "b", "n"):
        rows = rows.join(p.select(F.col("node").alias(k), F.col("cells").alias(f"c_{k}")), k)
    return rows


@query(f"WITH {grid_cells_sql(16)}, {LEVEL_PAIRS} SELECT p.a, p.b, min(x.level)::BIGINT AS level FROM pairs p LEFT JOIN cells x ON x.node = p.a LEFT JOIN cells y ON y.node = p.b AND y.level = x.level WHERE x.cell = y.cell GROUP BY ALL")
def common_level(spark, sf_dir):
    return _level_pairs(spark).select("a", "b", hierarchy.common_level("c_a", "c_b").cast("long").alias("level"))


@query(f"""WITH {grid_cells_sql(16)}, {LEVEL_PAIRS}, h AS (SELECT p.a, p.b, p.n, max(CASE WHEN x.cell <> z.cell THEN z.level END) AS s, max(CASE WHEN y.cell <> z.cell THEN z.level END) AS t
  FROM pairs p JOIN cells z ON z.node = p.n JOIN cells x ON x.node = p.a AND x.level = z.level JOIN cells y ON y.node = p.b AND y.level = z.level GROUP BY ALL)
SELECT a, b, n, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN least(s, t) END::BIGINT AS level FROM h""")
def query_level(spark, sf_dir):
    return _level_pairs(spark).select("a", "b", "n", hierarchy.query_level("c_a", "c_b", "c_n").cast("long").alias("level"))


BORDER_SQL = f"{grid_sql(16)}, {grid_cells_sql(16)}, arcs AS (SELECT g.src, g.dst, g.w, coalesce(max(CASE WHEN a.cell <> b.cell THEN a.level + 1 END), 0)::BIGINT AS border_level FROM grid g JOIN cells a ON a.node = g.src JOIN cells b ON b.node = g.dst AND a.level = b.level GROUP BY ALL)"


@query(f"WITH {BORDER_SQL} SELECT src, dst, w, border_level FROM arcs")
def border_levels(spark, sf_dir):
    return hierarchy.border_levels(grid_edges(spark, 16), grid_cells(spark, 16))


@query(f"""WITH {BORDER_SQL}, top AS (SELECT node, max(border_level) AS b FROM (SELECT src AS node, border_level FROM arcs UNION ALL SELECT dst, border_level FROM arcs) GROUP BY node),
k AS (SELECT node, list(cell ORDER BY level DESC) AS c FROM cells GROUP BY node)
SELECT node AS old, (row_number() OVER (ORDER BY b DESC, c, node) - 1)::BIGINT AS new FROM top JOIN k USING (node)""")
def node_ordering(spark, sf_dir):
    return hierarchy.node_ordering(grid_edges(spark, 16), grid_cells(spark, 16))


@query(f"""WITH {grid_sql(16)}, {grid_cells_sql(16)}, c AS (SELECT * FROM cells WHERE level = 0)
SELECT least(x.cell, y.cell)::BIGINT AS a, greatest(x.cell, y.cell)::BIGINT AS b, count(*) AS w FROM grid JOIN c x ON src = x.node JOIN c y ON dst = y.node WHERE x.cell <> y.cell GROUP BY ALL""")
def cell_graph(spark, sf_dir):
    return hierarchy.cell_graph(grid_edges(spark, 16), grid_cells(spark, 16).where("level = 0").select("node", "cell"))[1]


CELL_SQL = f"""WITH RECURSIVE {grid_sql(8)}, {grid_cells_sql(8)}, arcs AS (SELECT a.level, a.cell, g.src, g.dst, g.w FROM grid g JOIN cells a ON a.node = g.src JOIN cells b ON b.node = g.dst AND b.level = a.level AND b.cell = a.cell),
border AS (SELECT DISTINCT a.level, a.cell, n.node FROM grid g JOIN cells a ON a.node = g.src JOIN cells b ON b.node = g.dst AND b.level = a.level AND b.cell <> a.cell, LATERAL (SELECT g.src AS node) n
  UNION SELECT b.level, b.cell, g.dst FROM grid g JOIN cells a ON a.node = g.src JOIN cells b ON b.node = g.dst AND b.level = a.level AND b.cell <> a.cell),
sp(level, cell, u, v, w) USING KEY (level, u, v) AS (
  SELECT level, cell, node, node, 0::BIGINT FROM border
  UNION SELECT s.level, s.cell, s.u, e.dst, min(s.w + e.w)::BIGINT FROM sp s JOIN arcs e ON e.level = s.level AND e.src = s.v LEFT JOIN recurring.sp r ON r.level = s.level AND r.u = s.u AND r.v = e.dst
  WHERE r.w IS NULL OR s.w + e.w < r.w GROUP BY s.level, s.cell, s.u, e.dst)"""


@query(f"{CELL_SQL} SELECT s.level::BIGINT AS level, s.cell::BIGINT AS cell, s.u, s.v, s.w FROM sp s JOIN border b ON b.level = s.level AND b.node = s.v")
def cell_distances(spark, sf_dir):
    t = hierarchy.cell_distances(grid_edges(spark, 8), grid_cells(spark, 8))
    return t.select(F.col("level").cast("long").alias("level"), "cell", "u", "v", "w")


@query(f"{CELL_SQL}, t AS (SELECT s.level::BIGINT AS level, s.cell::BIGINT AS cell, s.u, s.v, s.w FROM sp s JOIN border b ON b.level = s.level AND b.node = s.v) SELECT level, cell, u, v, CASE WHEN (u * 7 + v) % 11 <> 1 THEN w + 1 END AS table_w, w AS graph_w FROM t WHERE (u * 7 + v) % 11 < 2")
def cell_check(spark, sf_dir):
    """Tables with wrong and with missing entries against searches on the bare graph: just these are found."""
    e, c = grid_edges(spark, 8), grid_cells(spark, 8)
    t = hierarchy.cell_distances(e, c).where("(u * 7 + v) % 11 <> 1").withColumn("w", F.expr("CASE WHEN (u * 7 + v) % 11 = 0 THEN w + 1 ELSE w END"))
    return hierarchy.cell_mismatches(e, c, t).withColumn("level", F.col("level").cast("long"))


@query()
def inertial_flow(spark, sf_dir):
    """Sizes and cut of one bisection of a grid."""
    e, n = grid_edges(spark, 12), grid_nodes(spark, 12)
    part = flow.bisection(e, n, 1, least=4)
    a, b = (part.selectExpr(f"node AS {k}", f"partition_id AS p_{k}") for k in ("src", "dst"))
    cut = e.join(a, "src").join(b, "dst").where("p_src <> p_dst").agg(F.count(F.lit(1)).alias("cut"))
    return part.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size")).join(F.broadcast(cut))


@query()
def bisection(spark, sf_dir):
    """Recursive bisection to depth four."""
    return flow.bisection(grid_edges(spark, 12), grid_nodes(spark, 12), 4, least=8)


@query()
def assemble(spark, sf_dir):
    """A directory of connected cells over the pieces of a bisection."""
    e = grid_edges(spark, 12)
    part = flow.bisection(e, grid_nodes(spark, 12), 4, least=8).withColumnRenamed("partition_id", "cell")
    a, b = (part.selectExpr(f"node AS {k}", f"cell AS p_{k}") for k in ("src", "dst"))
    inner = e.join(a, "src").join(b, "dst").where("p_src = p_dst").select("src", "dst")
    pieces = frontier.weak_components(inner, part.select("node")).withColumnRenamed("component", "cell")
    return hierarchy.assembled(e, pieces, [40, 80, 150]).select("node", F.col("level").cast("long").alias("level"), "cell")


@query(f"WITH {GEO_SQL}, {COPURCHASE_SQL} SELECT a.lat / 1e6 AS latitude, a.lon / 1e6 AS longitude FROM (SELECT unnest([src, dst]) AS id FROM copurchase WHERE src % 4 <> dst % 4) JOIN geo a USING (id)")
def cut_csv(spark, sf_dir):
    """Ends of arcs between different partitions."""
    from roadloom.sources.formats import cut_arcs

    e = copurchase(spark, sf_dir)
    part = _nodes(e).selectExpr("node", "node % 4 AS partition_id")
    return cut_arcs(e, part, geo(spark, sf_dir))
