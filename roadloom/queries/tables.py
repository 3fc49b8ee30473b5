"""Aggregates, windows, orders, sketches and spatial joins over plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions import boxes
from roadloom.operators import coding, relational, sketches, spatial
from roadloom.queries.registry import registry
from roadloom.queries.scalars import HAVERSINE
from roadloom.sources.derived import COPURCHASE_SQL, GEO_SQL, TRADE_SQL, copurchase, geo, grid_cells, grid_cells_sql, grid_edges, grid_sql, parts, table, trade

QUERIES, ORACLE_SQL, query = registry()


@query(f"WITH {GEO_SQL} SELECT c_nationkey::BIGINT AS nation, min(lat)::BIGINT AS min_lat, min(lon)::BIGINT AS min_lon, max(lat)::BIGINT AS max_lat, max(lon)::BIGINT AS max_lon FROM geo JOIN customer ON id = c_custkey GROUP BY ALL")
def bbox_by_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "cast(c_nationkey AS bigint) AS nation")
    boxes = relational.bounding_boxes(geo(spark, sf_dir).join(c, "id"), "nation")
    return boxes.selectExpr("nation", *(f"cast({c} AS bigint) AS {c}" for c in ("min_lat", "min_lon", "max_lat", "max_lon")))


BOXES = "boxes AS (SELECT n_nationkey::BIGINT AS box_id, n_nationkey * 6000000 - 80000000 AS lo_lat, n_nationkey * 12000000 - 170000000 AS lo_lon FROM nation)"


@query(f"WITH {GEO_SQL}, {BOXES} SELECT box_id, id FROM geo JOIN boxes ON lat BETWEEN lo_lat AND lo_lat + 20000000 AND lon BETWEEN lo_lon AND lo_lon + 30000000")
def window_intersect(spark, sf_dir):
    boxes = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS box_id", "n_nationkey * 6000000 - 80000000 AS min_lat", "n_nationkey * 12000000 - 170000000 AS min_lon")
    return spatial.in_windows(geo(spark, sf_dir), boxes.withColumn("max_lat", F.col("min_lat") + 20000000).withColumn("max_lon", F.col("min_lon") + 30000000))


@query(f"""WITH {GEO_SQL}, q AS (SELECT s_suppkey AS query_id, (s_suppkey * 1117) % 140 - 70 AS a, (s_suppkey * 2791) % 360 - 180 AS b FROM supplier),
d AS (SELECT query_id, id, {HAVERSINE.format(a='a', b='b', c='(lat / 1e6)', d='(lon / 1e6)')} AS km FROM q, geo)
SELECT query_id, id, round(km, 6) AS km, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, id) AS k FROM d) WHERE k <= 5""")
def knn(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS query_id", "((s_suppkey * 1117) % 140 - 70) * 1000000 AS lat", "((s_suppkey * 2791) % 360 - 180) * 1000000 AS lon")
    near = spatial.nearest(geo(spark, sf_dir), q, 5, 20_000_000)
    return near.select("query_id", "id", F.round("distance", 6).alias("km"), F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def top_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.struct("o_totalprice", "o_orderkey").alias("k"))
    return relational.top_k(o, "k", 100).select("k.o_orderkey", "k.o_totalprice")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 0 AS prefix FROM events")
def prefix_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(1).cast("long").alias("one"))
    return relational.prefix_sums(e, "user_id", "event_id", "one").select("user_id", "event_id", "prefix")


@query("SELECT event_id, (sum((event_id * 7) % 13) OVER (ORDER BY event_id))::BIGINT AS prefix FROM events")
def global_prefix_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 13).alias("v"))
    return relational.global_prefix_sums(e, "event_id", "v", 8).select("event_id", "prefix")


_PREFIX = "p AS (SELECT l_orderkey AS g, l_linenumber::BIGINT AS i, (sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::BIGINT AS prefix FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL))"


def _quantities(spark, sf_dir, *keys):
    """g, i, q: summed quantities of the lines of orders, spread by the keys over parts that grow with the table."""
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("i"), F.col("l_quantity").cast("long").alias("q"))
    return q.repartition(parts(spark, sf_dir), *keys).groupBy("g", "i").agg(F.sum("q").alias("q"))


def _lines(spark, sf_dir):
    return relational.prefix_sums(_quantities(spark, sf_dir, "g"), "g", "i", "q")


@query(f"WITH {_PREFIX} SELECT a.g, a.i, b.i AS j, CASE WHEN a.i >= b.i THEN 0 ELSE b.prefix - a.prefix END AS total FROM p a JOIN p b ON a.g = b.g")
def range_sum(spark, sf_dir):
    p = _lines(spark, sf_dir)
    ranges = p.select("g", "i").join(p.select("g", F.col("i").alias("j")), "g")
    return relational.range_sums(p, ranges, "g", "i")


@query(f"WITH {_PREFIX} SELECT g, max(i) AS pos FROM p WHERE prefix <= 60 GROUP BY g")
def select_prefix(spark, sf_dir):
    return relational.select_prefix(_lines(spark, sf_dir), "g", "i", F.lit(60))


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m) SELECT user_id, run, min(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def event_runs(spark, sf_dir):
    return relational.equal_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH m AS (SELECT user_id, ts, event_id, value, CASE WHEN value >= lag(value) OVER w THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m) SELECT user_id, run, count(*) AS length FROM r GROUP BY ALL""")
def event_runs_by_pred(spark, sf_dir):
    """Runs that go on while the value does not fall."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("_prev", F.lag("value").over(w))
    return relational.runs(e, "user_id", ["ts", "event_id"], F.col("value") >= F.col("_prev")).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("length"))


@query("SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part)")
def kway_merge(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return relational.merged_runs(parts, "k")


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos, c_custkey, c_acctbal FROM customer")
def radix_sort(spark, sf_dir):
    """Numeric order, negative values included, with positions."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.struct("c_acctbal", "c_custkey").alias("k"), F.lit(1).cast("long").alias("one"))
    return relational.global_prefix_sums(c, "k", "one", 8).select(F.col("prefix").alias("pos"), "c_custkey", "c_acctbal")


@query(f"WITH {COPURCHASE_SQL} SELECT src AS node, count(*) AS degree FROM copurchase GROUP BY src")
def out_degree(spark, sf_dir):
    return relational.out_degrees(copurchase(spark, sf_dir))


@query("SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY ALL")
def parallel_merge(spark, sf_dir):
    arcs = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS src", "l_suppkey AS dst", "cast(l_quantity AS bigint) AS w")
    return relational.merged_parallel(arcs)


@query(f"WITH {COPURCHASE_SQL} SELECT dst AS src, src AS dst, w FROM copurchase")
def reverse_graph(spark, sf_dir):
    return relational.reversed_edges(copurchase(spark, sf_dir))


@query(f"WITH {COPURCHASE_SQL} SELECT src, dst, w FROM copurchase a WHERE NOT EXISTS (SELECT 1 FROM copurchase b WHERE b.src = a.dst AND b.dst = a.src AND b.w = a.w)")
def symmetric_check(spark, sf_dir):
    return relational.asymmetric_arcs(copurchase(spark, sf_dir))


@query(f"WITH {TRADE_SQL} SELECT src, dst, w FROM trade WHERE src = dst")
def self_loops(spark, sf_dir):
    return trade(spark, sf_dir).where("src = dst")


@query(f"WITH {COPURCHASE_SQL} SELECT count(DISTINCT n)::BIGINT AS nodes, (SELECT count(*) FROM copurchase)::BIGINT AS arcs, (SELECT max(d) FROM (SELECT count(*) AS d FROM copurchase GROUP BY src))::BIGINT AS max_degree FROM (SELECT src AS n FROM copurchase UNION ALL SELECT dst FROM copurchase)")
def graph_counts(spark, sf_dir):
    e = copurchase(spark, sf_dir)
    degrees = e.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("d")))).alias("x")).groupBy("x.n").agg(F.sum("x.d").alias("d"))
    return degrees.agg(F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("arcs"), F.max("d").alias("max_degree"))


@query(f"""WITH {grid_cells_sql(16)}, s AS (SELECT level, cell, count(*) AS n FROM cells GROUP BY ALL)
SELECT level::BIGINT AS level, count(*) AS cells, avg(n) AS mean, list(n ORDER BY n)[count(*) // 2 + 1] AS median, max(n) AS largest, sum(n * n) / sum(n) AS biased_mean FROM s GROUP BY level""")
def cell_stats(spark, sf_dir):
    return relational.cell_statistics(grid_cells(spark, 16)).withColumn("level", F.col("level").cast("long"))


@query(f"""WITH {grid_sql(16)}, {grid_cells_sql(16)}, c AS (SELECT * FROM cells WHERE level = 1), s AS (SELECT count(*) AS n FROM c GROUP BY cell)
SELECT (SELECT count(*) FROM grid JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.cell <> b.cell)::BIGINT AS cut, count(*) AS cells, min(n) AS smallest, list(n ORDER BY n)[count(*) // 2 + 1] AS median, max(n) AS largest FROM s""")
def partition_stats(spark, sf_dir):
    return relational.partition_statistics(grid_edges(spark, 16), grid_cells(spark, 16).where("level = 1"))


@query("""WITH t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'dijkstra' ELSE 'mld' END AS engine, event_id % 1000 + 1 AS rank, (event_id * 37) % 1009 AS nanos FROM events),
m AS (SELECT engine, round(log2(rank))::BIGINT AS bucket, median(nanos) AS median FROM t GROUP BY ALL)
SELECT a.bucket, a.median / b.median AS ratio FROM m a JOIN m b ON a.bucket = b.bucket AND a.engine = 'dijkstra' AND b.engine = 'mld'""")
def rank_speedups(spark, sf_dir):
    """Ratios of median times of two engines by rank bucket."""
    t = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 2 = 0 THEN 'dijkstra' ELSE 'mld' END AS engine", "event_id % 1000 + 1 AS rank", "(event_id * 37) % 1009 AS nanos")
    return relational.speedups(t, "dijkstra", "mld").where("ratio IS NOT NULL")


@query("""WITH RECURSIVE items AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_quantity::BIGINT AS q FROM lineitem),
pack AS (SELECT g, i, 0 AS bin, q AS used FROM items WHERE i = 1
  UNION ALL SELECT n.g, n.i, CASE WHEN p.used + n.q > 60 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.used + n.q > 60 THEN n.q ELSE p.used + n.q END FROM pack p JOIN items n ON n.g = p.g AND n.i = p.i + 1)
SELECT g, i, bin::BIGINT AS bin FROM pack""")
def bin_pack(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(w).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("q"))
    return relational.next_fit(items, "g", "i", "q", 60)


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
p AS (SELECT *, lag(k) OVER (PARTITION BY user_id, event_type ORDER BY k) AS before FROM e),
d AS (SELECT a.user_id, a.k, a.before, count(DISTINCT b.event_type) AS other FROM p a LEFT JOIN e b ON b.user_id = a.user_id AND b.k > a.before AND b.k < a.k GROUP BY ALL)
SELECT user_id, count(*) FILTER (before IS NOT NULL AND other < 3) AS hits, count(*) FILTER (before IS NULL OR other >= 3) AS misses FROM d GROUP BY user_id""")
def lru_replay(spark, sf_dir):
    """Hits of a cache of three event types over each user's events."""
    return relational.lru_hits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS added, count(*) FILTER (p_partkey % 3 = 0) AS found, true AS few_false FROM part")
def bloom(spark, sf_dir):
    """A filter sized by the keys that were added: all of them are found, and of the others no more than three times as many
    as the rate allows (and a handful)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    added = p.where("key % 3 = 0")
    n = added.count()
    found = sketches.bloom_contains(p, "key", sketches.bloom_filter(added, "key", n, 0.01), n, 0.01)
    hit = lambda own: F.count_if(F.col("maybe") & (F.expr("key % 3 = 0") if own else F.expr("key % 3 <> 0")))
    return found.agg(F.count_if(F.expr("key % 3 = 0")).alias("added"), hit(True).alias("found"), (hit(False) <= 5 + 0.03 * F.count_if(F.expr("key % 3 <> 0"))).alias("few_false"))


@query("SELECT l_partkey AS key, count(*) AS n, true AS covered FROM lineitem GROUP BY l_partkey")
def count_min(spark, sf_dir):
    """Counts beside whether each estimate is at least the count and within the error bound."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    sketch = sketches.count_min(rows, "key", 0.001, 1e-6)
    est = sketches.count_min_estimates(rows, "key", sketch, 0.001, 1e-6)
    exact = rows.groupBy("key").count()
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return exact.join(est, "key").join(F.broadcast(total)).select("key", F.col("count").alias("n"), F.expr("estimate >= count AND estimate <= count + 0.001 * total").alias("covered"))


@query("WITH d AS (SELECT l_orderkey AS g, l_linenumber::BIGINT AS i, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL), u AS (SELECT g, i, q + CASE WHEN i % 2 = 1 THEN g % 10 ELSE 0 END AS q FROM d) SELECT g, i, (sum(q) OVER (PARTITION BY g ORDER BY i))::BIGINT AS prefix FROM u")
def prefix_after_update(spark, sf_dir):
    """Prefix sums after point additions."""
    values = _quantities(spark, sf_dir, "g", "i")
    changed = relational.updated(values, values.where("i % 2 = 1").selectExpr("g", "i", "g % 10 AS q"), "g", "i", "q")
    return relational.prefix_sums(changed.repartition(parts(spark, sf_dir), "g"), "g", "i", "q").select("g", "i", "prefix")


@query(r"""WITH RECURSIVE w AS (SELECT ascii(lang) * 256 + ascii(lang[2:]) AS g, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
n AS (SELECT g, w[1] AS symbol, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
merge(g, l, cost) AS (SELECT g, list_sort(list(n)), 0::BIGINT FROM n GROUP BY g
  UNION ALL SELECT g, list_sort(list_append(l[3:], l[1] + l[2])), (cost + l[1] + l[2])::BIGINT FROM merge WHERE len(l) > 1)
SELECT m.g::BIGINT AS g, CASE WHEN k.symbols = 1 THEN l[1] ELSE cost END::BIGINT AS bits, k.symbols FROM merge m JOIN (SELECT g, count(*) AS symbols FROM n GROUP BY g) k ON k.g = m.g WHERE len(l) = 1""")
def huffman_bits(spark, sf_dir):
    """Bits of the words' first letters in each language, one alphabet a language, and the letters."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.expr("cast(ascii(lang) * 256 + ascii(substring(lang, 2)) AS bigint)").alias("g"), F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    counts = d.groupBy("g", F.substring("w", 1, 1).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return coding.huffman(counts, "g").groupBy("g").agg(F.sum(F.col("n") * F.col("length")).alias("bits"), F.count(F.lit(1)).alias("symbols"))


@query("""WITH v AS (SELECT w, x, row_number() OVER (PARTITION BY w ORDER BY x) - 1 AS idx FROM range(1, 9) a(w), range(65536) b(x) WHERE bit_count(x) = w)
SELECT w AS weight, idx, x AS value FROM v WHERE idx <= 40 AND w > 1 UNION ALL SELECT 1, i, 1::BIGINT << i FROM range(41) t(i)""")
def weighted_words(spark, sf_dir):
    """The first 64-bit numbers of each weight, by rank."""
    rows = spark.range(1, 9).withColumnRenamed("id", "weight").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))))
    return coding.weighted_words(rows)


_TABULATED = "(xor(({x}), ({x}) >> 16)) >> 16"
_TABLE = "(xor({y}, {y} >> 16) * 73244475) & 4294967295"
_ENTRY = "(({i} + 1) * 2654435769 + {t} * 2246822507) & 4294967295"


@query(f"""WITH e AS (SELECT p_partkey AS key, {_ENTRY.format(i='(p_partkey & 65535)', t=0)} AS a, {_ENTRY.format(i='((p_partkey >> 16) & 65535)', t=1)} AS b FROM part),
m AS (SELECT key, {_TABLE.format(y='a')} AS a, {_TABLE.format(y='b')} AS b FROM e)
SELECT key, xor({_TABULATED.format(x='a')}, {_TABULATED.format(x='b')}) AS hash FROM m""")
def tabulation_hash(spark, sf_dir):
    return coding.tabulation_hashes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))


_WINDOWS = "win AS (SELECT n_nationkey::BIGINT AS window_id, n_nationkey * 6000000 - 80000000 AS a, n_nationkey * 12000000 - 170000000 AS b, n_nationkey * 6000000 - 60000000 AS c, n_nationkey * 12000000 - 140000000 AS d FROM nation)"


@query(f"""WITH {GEO_SQL}, {_WINDOWS}, el AS (SELECT id, lat AS a, lon AS b, lat + (id * 31337) % 9000000 AS c, lon + (id * 7331) % 12000000 AS d FROM geo)
SELECT window_id, id FROM el JOIN win ON el.a <= win.c AND win.a <= el.c AND el.b <= win.d AND win.b <= el.d""")
def box_intersect(spark, sf_dir):
    """Boxes that meet windows."""
    el = geo(spark, sf_dir).select("id", boxes.box(F.col("lat"), F.col("lon"), F.col("lat") + (F.col("id") * 31337) % 9000000, F.col("lon") + (F.col("id") * 7331) % 12000000).alias("box"))
    win = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("window_id"), boxes.box(*(F.expr(x) for x in ("n_nationkey * 6000000 - 80000000", "n_nationkey * 12000000 - 170000000", "n_nationkey * 6000000 - 60000000", "n_nationkey * 12000000 - 140000000"))).alias("box"))
    return spatial.intersecting(el, win)


@query(f"""WITH {GEO_SQL}, q AS (SELECT s_suppkey AS query_id, s_suppkey % 50 AS g, (s_suppkey * 1117) % 140 * 1000000 - 70000000 AS a, (s_suppkey * 2791) % 360 * 1000000 - 180000000 AS b FROM supplier),
d AS (SELECT query_id, id, sqrt((a - lat)::DOUBLE * (a - lat) + (b - lon)::DOUBLE * (b - lon)) AS distance FROM q JOIN geo ON id % 50 = g)
SELECT query_id, id, round(distance, 3) AS distance, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM d) WHERE k <= 3""")
def knn_planar(spark, sf_dir):
    """Neighbours in the plane, among the points of a query's group."""
    q = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS query_id", "s_suppkey % 50 AS group", "(s_suppkey * 1117) % 140 * 1000000 - 70000000 AS lat", "(s_suppkey * 2791) % 360 * 1000000 - 180000000 AS lon")
    near = spatial.nearest_in(geo(spark, sf_dir).withColumn("group", F.col("id") % 50), q, 3, boxes.Planar)
    return near.select("query_id", "id", F.round("distance", 3).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT n::BIGINT AS i, 0::BIGINT AS value FROM range(5) t(n)")
def fenwick_zeros(spark, sf_dir):
    return relational.zeros(spark, 5).select("i", "value")
