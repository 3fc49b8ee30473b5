"""Readers and writers of graph and routing files. Line formats parse as DataFrames; ids become 0-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import folder_bytes

#: Text whose rows one task of an ingest sorts.
TASK_BYTES = 16 << 20


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))


def read_dimacs(spark: SparkSession, path: str, unit_weights: bool = False) -> DataFrame:
    """src, dst, w from `a u v w` lines; self loops and malformed lines are dropped."""
    rows = _tokens(spark, path).where("t[0] = 'a' AND size(t) = 4").selectExpr("try_cast(t[1] AS bigint) - 1 AS src", "try_cast(t[2] AS bigint) - 1 AS dst", "1L AS w" if unit_weights else "try_cast(t[3] AS bigint) AS w")
    return rows.where("src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL AND src <> dst")


def read_dimacs_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon (micro-degrees) from `v id lon lat` lines."""
    rows = _tokens(spark, path).where("t[0] = 'v' AND size(t) = 4")
    return rows.selectExpr("try_cast(t[1] AS bigint) - 1 AS id", "try_cast(t[3] AS int) AS lat", "try_cast(t[2] AS int) AS lon").where("id IS NOT NULL")


def _header(spark: SparkSession, path: str) -> str:
    """The first line; of a folder, that of the first file by name that is not empty."""
    for file in sorted(spark.read.text(path).inputFiles()):
        if first := spark.read.text(file).limit(1).collect():
            return first[0][0].strip()
    return ""


def read_ddsg(spark: SparkSession, path: str, unit_weights: bool = False) -> DataFrame:
    """src, dst, w from `u v w dir` lines: 0 both ways, 1 forward, 2 backward, 3 closed. Without the header `d`: empty."""
    rows = _tokens(spark, path).where("size(t) = 4").selectExpr("try_cast(t[0] AS bigint) AS u", "try_cast(t[1] AS bigint) AS v", "1L AS w" if unit_weights else "try_cast(t[2] AS bigint) AS w", "try_cast(t[3] AS int) AS dir")
    ways = "CASE dir WHEN 0 THEN array(struct(u AS src, v AS dst), struct(v AS src, u AS dst)) WHEN 1 THEN array(struct(u AS src, v AS dst)) WHEN 2 THEN array(struct(v AS src, u AS dst)) END"
    arcs = rows.selectExpr("w", f"explode({ways}) AS arc").selectExpr("arc.src AS src", "arc.dst AS dst", "w").where("src <> dst")
    return arcs if _header(spark, path) == "d" else arcs.limit(0)


def read_ddsg_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """id, lon, lat in the file's unit of a hundred-thousandth degree, as degrees."""
    return _tokens(spark, path).where("size(t) = 3").selectExpr("cast(t[0] AS bigint) AS id", "cast(t[1] AS double) / 1e5 AS lon", "cast(t[2] AS double) / 1e5 AS lat")


def numbered_lines(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """value, pos: the lines that the condition leaves, numbered from 0 in the file's order. Lines are counted by block and
    numbered inside it, so no task sees them all and none is shuffled."""
    lines = spark.read.text(path).where(where).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    sizes = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"))
    base = sizes.selectExpr("f", "b", "low", "coalesce(sum(n) OVER (ORDER BY f, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")  # a row a block
    return lines.join(F.broadcast(base), ["f", "b"]).selectExpr("value", "k - low + base AS pos")


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w = 1: line i (after the header) lists the 1-based neighbours of node i; lines with % are comments. A
    neighbour beyond the announced number of nodes is an error."""
    lines = numbered_lines(spark, path, "not startswith(ltrim(value), '%')")
    head = lines.where("pos = 0").selectExpr(r"cast(split(trim(value), '\\s+')[0] AS bigint) AS n").collect()
    n = head[0][0] if head else 0
    arcs = lines.where("pos > 0").selectExpr("pos - 1 AS src", r"explode(split(trim(value), '\\s+')) AS t").selectExpr("src", "try_cast(t AS bigint) - 1 AS dst", "1L AS w").where("dst IS NOT NULL")
    inside = F.when((F.col("dst") >= 0) & (F.col("dst") < n) & (F.col("src") < n), F.col("dst")).otherwise(F.raise_error(F.lit("a node is beyond the announced number")).cast("bigint"))
    return arcs.select("src", inside.alias("dst"), "w").where("src <> dst")


def read_metis_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """id (by line), lon, lat in degrees from `lon lat [z]` lines in hundred-thousandths."""
    lines = numbered_lines(spark, path, "size(split(trim(value), '[ \\t]+')) >= 2").select("pos", F.split(F.trim("value"), r"\s+").alias("t"))
    return lines.selectExpr("pos AS id", "cast(t[0] AS double) / 1e5 AS lon", "cast(t[1] AS double) / 1e5 AS lat")


#: Readers of graphs and coordinates by format.
GRAPHS = {"dimacs": (read_dimacs, read_dimacs_coordinates), "ddsg": (read_ddsg, read_ddsg_coordinates), "metis": (read_metis, read_metis_coordinates)}


def ingest(spark: SparkSession, kind: str, graph: str, coordinates: str, out: str) -> None:
    """Reads a graph of a text format (dimacs, ddsg, metis) with its coordinates and writes Parquet tables under `out`: edges
    (src, dst, w), sorted by source in ranges, and nodes (id, lat, lon in micro-degrees)."""
    if kind not in GRAPHS:
        raise ValueError(f"unknown format {kind}")
    edges, places = (read(spark, path) for read, path in zip(GRAPHS[kind], (graph, coordinates), strict=True))
    tasks = lambda at: max(spark.sparkContext.defaultParallelism, -(-folder_bytes(spark, at) // TASK_BYTES))
    edges.repartitionByRange(tasks(graph), "src", "dst").sortWithinPartitions("src", "dst", "w").write.mode("overwrite").parquet(f"{out}/edges")
    if kind != "dimacs":  # degrees
        places = places.selectExpr("id", "cast(lat * 1e6 AS int) AS lat", "cast(lon * 1e6 AS int) AS lon")
    places.select("id", "lat", "lon").repartitionByRange(tasks(coordinates), "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{out}/nodes")


def read_edges(spark: SparkSession, path: str, with_weights: bool = True) -> DataFrame:
    """src, dst [, w] of an ingested graph. Without weights their column is not read."""
    return spark.read.parquet(f"{path}/edges").select("src", "dst", *(["w"] if with_weights else []))


def narrowed(edges: DataFrame) -> DataFrame:
    """Arcs with ends and weights that fit 32 unsigned bits; a wider value is an error, not a wrap."""
    checked = lambda c: F.when(F.col(c).between(0, (1 << 32) - 1), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} does not fit 32 bits: "), F.col(c).cast("string"))).cast("bigint"))
    return edges.select(*(checked(c).alias(c) for c in edges.columns))


def write_directory(cells: DataFrame, path: str) -> None:
    """Persists a level directory (node, level, cell), a folder a level."""
    cells.select("node", "level", "cell").write.mode("overwrite").partitionBy("level").parquet(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).selectExpr("node", "cast(level AS int) AS level", "cell")


def write_ordering(ordering: DataFrame, path: str) -> None:
    """Persists a numbering (old, new), sorted by old number in ranges."""
    ordering.select("old", "new").repartitionByRange("old").sortWithinPartitions("old").write.mode("overwrite").parquet(path)


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tsplib(spark: SparkSession, path: str) -> DataFrame:
    """i, j, w of a TSPLIB instance: EUC_2D, or EXPLICIT with FULL_MATRIX or LOWER_DIAG_ROW.

    An instance is one small file with sections, read whole by one task."""
    from roadloom.session import ship

    ship(spark)
    whole = spark.read.text(path, wholetext=True)

    def parse(frames):
        for frame in frames:
            for text in frame["value"]:
                yield tsplib_matrix(text)

    return whole.mapInPandas(parse, "i long, j long, w long")


def tsplib_matrix(text: str):
    import pandas as pd

    head, numbers, section = {}, [], None
    for line in map(str.strip, text.splitlines()):
        if not line or line == "EOF":
            continue
        if line.endswith("_SECTION"):
            section = line
        elif section:
            numbers += [float(x) for x in line.split()]
        elif ":" in line:
            key, value = line.split(":", 1)
            head[key.strip()] = value.strip()
    n = int(head["DIMENSION"])
    kind, form = head["EDGE_WEIGHT_TYPE"], head.get("EDGE_WEIGHT_FORMAT")
    if kind == "EUC_2D":
        if len(numbers) != 3 * n:
            raise ValueError(f"{n} sites announced, {len(numbers) / 3:g} found")
        at = [(int(numbers[k + 1]), int(numbers[k + 2])) for k in range(0, 3 * n, 3)]
        w = [[int(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 + 0.5) for b in at] for a in at]
    elif kind == "EXPLICIT" and form == "FULL_MATRIX":
        if len(numbers) != n * n:
            raise ValueError("matrix does not match the dimension")
        w = [[int(numbers[i * n + j]) for j in range(n)] for i in range(n)]
    elif kind == "EXPLICIT" and form == "LOWER_DIAG_ROW":
        if len(numbers) != n * (n + 1) // 2:
            raise ValueError("triangle does not match the dimension")
        w = [[int(numbers[max(i, j) * (max(i, j) + 1) // 2 + min(i, j)]) for j in range(n)] for i in range(n)]
    else:
        raise ValueError(f"unknown edge weights {kind} {form}")
    return pd.DataFrame([(i, j, w[i][j]) for i in range(n) for j in range(n)], columns=["i", "j", "w"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source, target, rank, distance; bad lines are dropped."""
    return spark.read.csv(path, header=True, schema="source long, target long, rank long, distance long", mode="DROPMALFORMED")


#: Columns of the interchange tables.
CSV_TABLES = {
    "pairs": ("source", "target", "rank", "distance"),
    "timings": ("engine", "source", "target", "rank", "nanos", "distance"),
    "scans": ("engine", "source", "target", "rank", "settled", "inserted", "decreased"),
    "cut": ("latitude", "longitude"),
    "assignment": ("partition_id", "latitude", "longitude"),
}


def write_csv(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Writes a table with a header; kind: one of CSV_TABLES, whose columns it then has, in order."""
    (df.select(*CSV_TABLES[kind]) if kind else df).write.mode("overwrite").csv(path, header=True)


def cut_arcs(edges: DataFrame, partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """latitude, longitude of both ends of every arc between different partitions, in degrees."""
    a, b = (partition.selectExpr(f"node AS {k}", f"partition_id AS p_{k}") for k in ("src", "dst"))
    cut = edges.join(a, "src").join(b, "dst").where("p_src <> p_dst").selectExpr("explode(array(src, dst)) AS id")
    return cut.join(nodes, "id").selectExpr("lat / 1e6 AS latitude", "lon / 1e6 AS longitude")


def assignment(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """partition_id, latitude, longitude of every node."""
    return partition.join(nodes, partition.node == nodes.id).selectExpr("partition_id", "lat / 1e6 AS latitude", "lon / 1e6 AS longitude")


def polygon_features(hulls: DataFrame) -> DataFrame:
    """GeoJSON features, a JSON text a row, of hulls (cell, ring of struct(lat, lon) in micro-degrees), with bounding box."""
    point = lambda p: F.array(p["lon"] / 1e6, p["lat"] / 1e6)
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), point)
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c])) / 1e6), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])) / 1e6)
    feature = F.struct(F.lit("Feature").alias("type"), F.col("cell").alias("id"), F.array(low("lon"), low("lat"), high("lon"), high("lat")).alias("bbox"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    return hulls.select("cell", F.to_json(feature).alias("feature"))


def boundary_points(edges: DataFrame, partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, lat, lon of the start of every arc between different partitions, a row an arc; nodes without coordinates have none."""
    a, b = (partition.selectExpr(f"node AS {k}", f"partition_id AS p_{k}") for k in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("p_src <> p_dst").selectExpr("src AS id").join(nodes, "id").select("id", "lat", "lon")


def point_features(points: DataFrame) -> DataFrame:
    """GeoJSON point features of rows (id, lat, lon) in micro-degrees."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.struct(F.lit("Point").alias("type"), F.array(F.col("lon") / 1e6, F.col("lat") / 1e6).alias("coordinates")).alias("geometry"))
    return points.select("id", F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame, path: str) -> None:
    """Writes the features (JSON texts) as one GeoJSON collection in text files whose lines, in file order, are the document:
    the opening line, a feature a line in order of the first column, the closing line. No row holds more than a feature."""
    k = features.columns[0]
    body = features.select(F.lit(1).alias("part"), F.col(k).cast("string").alias("s"), F.col(k).alias("k"), "feature")
    first = body.agg(F.min("k")).first()[0]
    lines = body.select("part", "k", F.when(F.col("k") == first, F.col("feature")).otherwise(F.concat(F.lit(","), "feature")).alias("value"))
    ends = features.sparkSession.createDataFrame([(0, None, '{"type":"FeatureCollection","features":['), (2, None, "]}")], lines.schema)
    lines.union(ends).repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)
