"""Queries over the graph operators, each with the SQL that gives the same rows.

Weights are whole cents or counts, so that both engines compare the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import weights
from sylvan.operators.components import connected_components
from sylvan.operators.dendrogram import chain, dendrogram, flat_clusters, sequence_dendrogram, with_heights
from sylvan.operators.graph import both_directions, canonical_edges, degrees, edge_index, offsets, oriented
from sylvan.operators.msf import block_spanning_forest, minimum_spanning_forest
from sylvan.operators.triangles import edge_support, triangles, truss
from sylvan.plans import flow
from sylvan.runtime import read_table, shared_path
from sylvan.sources import generators, graph_files

Query = Callable[[SparkSession, str], DataFrame]
TREE = ["e", "src", "dst", "w", "parent"]
#: Rows that the distributed forms leave to one task in queries that are to show them.
FEW = 100
#: Sizes of the generated trees.
N, K = 1000, 10


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def star_nation_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves around their nation, weighted by balance: one star for each nation."""
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("hub"), F.col("c_custkey").alias("e"), _cents("c_acctbal").alias("w"))
    return chain(rows, ["hub"]).select("hub", "e", "w", "parent")


def _hook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select((F.col("c_custkey") - F.lit(1)).alias("i"), _cents("c_acctbal").alias("w")).where("i > 0")
    return canonical_edges(rows.select(F.col("i").alias("src"), (((F.col("i") * F.lit(2654435761)) % 1000003) % F.col("i")).alias("dst"), "w"))


HOOK_SQL = """SELECT least(i, h) AS src, greatest(i, h) AS dst, w FROM (
    SELECT c_custkey - 1 AS i, ((c_custkey - 1) * 2654435761 % 1000003) % greatest(c_custkey - 1, 1) AS h, cast(round(c_acctbal * 100) AS BIGINT) AS w FROM customer WHERE c_custkey > 1
  )"""


def hook_customer_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dendrogram(_hook_edges(spark, sf_dir)).select(TREE)


def hook_customer_rake_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracted in rounds over tables until some FEW edges are left."""
    return dendrogram(_hook_edges(spark, sf_dir), "rake_compress", FEW).select(TREE)


def hook_customer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of local minima over tables until some FEW edges are left."""
    return dendrogram(_hook_edges(spark, sf_dir), "rounds", FEW).select(TREE)


def _geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("src"), (F.col("n_nationkey") + 100).cast("bigint").alias("dst"), (F.col("n_nationkey") % 7).cast("bigint").alias("w"))
    supplier = read_table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 100).cast("bigint").alias("src"), (F.col("s_suppkey") + 1000).alias("dst"), _cents("s_acctbal").alias("w"))
    customer = read_table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("bigint").alias("src"), (F.col("c_custkey") + 10_000_000).alias("dst"), _cents("c_acctbal").alias("w"))
    return canonical_edges(nation.unionByName(supplier).unionByName(customer))


def geo_tree_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier and customer: a forest of as many trees as regions."""
    return dendrogram(_geo_edges(spark, sf_dir)).select(TREE)


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _cents("value").alias("w"))
    return events.select(F.col("user_id").alias("seq_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("pos"), "w")


def event_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_dendrogram(_sequences(spark, sf_dir)).select("seq_id", "pos", "w", "parent")


def event_cartesian_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sequences, those of over 70 events cut into tables of edges."""
    return sequence_dendrogram(_sequences(spark, sf_dir), one_task=70).select("seq_id", "pos", "w", "parent")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each pair of nations trades, both ways together."""
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").cast("bigint").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("bigint").alias("dst"))
    return canonical_edges(pairs.agg(F.count("*").alias("w")))


TRADE_SQL = """SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL"""


def trade_msf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimum_spanning_forest(_trade(spark, sf_dir))


def trade_boruvka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest in Boruvka rounds over tables."""
    return minimum_spanning_forest(_trade(spark, sf_dir), one_task=4)


def trade_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.cluster(_trade(spark, sf_dir)).select(TREE)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")).alias("vector"))


def embedding_msf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum spanning tree over all pairs of vectors by squared distance in thousandths."""
    return block_spanning_forest(_vectors(spark, sf_dir))


def embedding_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dendrogram(block_spanning_forest(_vectors(spark, sf_dir))).select(TREE)


def _copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at most two lines apart in an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.array(F.lead("l_partkey").over(order), F.lead("l_partkey", 2).over(order)).alias("next"))
    rows = lines.select("src", F.explode("next").alias("dst")).where("dst is not null")
    return canonical_edges(rows)


COPART_SQL = """SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT l_partkey AS a, unnest([lead(l_partkey) OVER o, lead(l_partkey, 2) OVER o]) AS b FROM lineitem
    WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)
  ) WHERE b IS NOT NULL AND a <> b"""


def copart_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(_copart(spark, sf_dir))


def copart_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_support(_copart(spark, sf_dir))


def copart_triangle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.top_triangles(_copart(spark, sf_dir))


def copart_inverse_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.inverse_triangles(_copart(spark, sf_dir))


def copart_truss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truss(_copart(spark, sf_dir)).select("src", "dst", "support", "k")


def supplier_truss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truss(_neighbours(spark, sf_dir)).select("src", "dst", "support", "k")


def supplier_truss_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peeled in rounds over tables until a component has some FEW edges left."""
    return truss(_neighbours(spark, sf_dir), FEW).select("src", "dst", "support", "k")


def copart_similarity_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle similarity, spanning forest, dendrogram."""
    return flow.cluster(_copart(spark, sf_dir), "triangle_similarity").select(TREE)


def copart_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_copart(spark, sf_dir)).select("id", "component")


def copart_components_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by large and small stars over tables."""
    return connected_components(_copart(spark, sf_dir), one_task=FEW).select("id", "component")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of lines that follow each other in an order; ties that the SQL leaves open go by supplier."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
    return canonical_edges(lines.where("dst is not null"))


NEIGHBOURS_SQL = """SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem
  ) WHERE b IS NOT NULL AND a <> b"""


def _round_trip(edges: DataFrame, write: Callable, read: Callable) -> DataFrame:
    path = shared_path(edges.sparkSession, "graph")
    write(edges, path)
    return read(edges.sparkSession, path)


def file_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as adjacency text and read again; so are the next two, with weights."""
    return _round_trip(_copart(spark, sf_dir), graph_files.write_adjacency, graph_files.read_adjacency)


def file_adjacency_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = partial(graph_files.read_adjacency, weight="int")
    return _round_trip(_hook_edges(spark, sf_dir), graph_files.write_adjacency, read)


def file_adjacency_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = partial(graph_files.read_adjacency, weight="float")
    return _round_trip(weights.inverse_degree(_copart(spark, sf_dir)), graph_files.write_adjacency, read)


def file_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = partial(graph_files.read_edge_list, weight="int")
    return _round_trip(_hook_edges(spark, sf_dir), graph_files.write_edge_list, read)


def file_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_hook_edges(spark, sf_dir), graph_files.write_binary, graph_files.read_binary)


def file_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = partial(graph_files.read_graph, fmt="parquet")
    return _round_trip(_hook_edges(spark, sf_dir), lambda edges, path: edges.write.parquet(path), read)


def file_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a written adjacency file to the dendrogram of its spanning forest, as the command line does."""
    flow_of = partial(flow.from_file, weight="int")
    return _round_trip(_trade(spark, sf_dir), graph_files.write_adjacency, flow_of).select(TREE)


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_edges(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")))


SUPPLY_SQL = "SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem"


def deg_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.inverse_degree(_supply(spark, sf_dir))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(_supply(spark, sf_dir))


def graph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(_supply(spark, sf_dir)).select("id", "degree", "offset")


def graph_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oriented(_supply(spark, sf_dir))


def graph_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_directions(_supply(spark, sf_dir).withColumn("w", F.lit(0.0)))


def graph_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_index(_supply(spark, sf_dir))


def canonical_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as parallel weighted edges between customers and parts: the least weight stays."""
    line, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).select((F.col("l_partkey") + 10_000_000).alias("src"), F.col("o_custkey").alias("dst"), _cents("l_extendedprice").alias("w"))
    return canonical_edges(rows)


def customer_flat_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook tree cut at a balance of 5000."""
    return flat_clusters(_hook_edges(spark, sf_dir), 500_000)


def hook_customer_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_heights(dendrogram(_hook_edges(spark, sf_dir)), FEW).select(*TREE, "height")


def gen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.path(spark, N).drop("pos")


def gen_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.star(spark, N).drop("pos")


def gen_caterpillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.caterpillar(spark, K).drop("pos")


def gen_full_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.full_binary(spark, K).drop("pos")


def gen_uniform_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.uniform_hook(spark, N).drop("pos")


def low_parallelism_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.low_parallelism(_hook_edges(spark, sf_dir))


def permutation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation drawn by a formula that SQL has too."""
    return weights.permutation(_hook_edges(spark, sf_dir), key=(F.col("src") * F.lit(2654435761) + F.col("dst") * F.lit(40503)) % 1000003)


def path_unit_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.from_generator(spark, "path", N).select(TREE)


def caterpillar_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.from_generator(spark, "caterpillar", 8, "low_parallelism").select(TREE)


FUNCTIONS = (
    star_nation_dendrogram, hook_customer_dendrogram, hook_customer_rake_compress, hook_customer_rounds, geo_tree_dendrogram,
    event_cartesian, event_cartesian_long, trade_msf, trade_boruvka, trade_dendrogram, embedding_msf, embedding_dendrogram,
    copart_triangles, copart_support, copart_triangle_weights, copart_inverse_triangles, copart_truss, copart_similarity_dendrogram,
    copart_components, copart_components_stars, supplier_truss, supplier_truss_rounds, deg_weights, graph_degrees, graph_offsets,
    graph_oriented, graph_directed, graph_edge_index, canonical_min, customer_flat_clusters, hook_customer_heights, gen_path,
    gen_star, gen_caterpillar, gen_full_binary, gen_uniform_hook, low_parallelism_weights, permutation_weights,
    path_unit_dendrogram, caterpillar_dendrogram, file_adjacency, file_adjacency_int, file_adjacency_float, file_edge_list,
    file_binary, file_parquet, file_dendrogram,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in FUNCTIONS}


def _dendrogram_sql(edges: str, final: str = "SELECT e, src, dst, w, parent FROM dendro") -> str:
    """The definition: vertices that the edges up to an edge's rank reach from it, and the least edge beyond that touches them."""
    return f"""
WITH RECURSIVE edges AS (
  {edges}
), idx AS (
  SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM edges
), arcs AS (
  SELECT src AS a, dst AS b, w, e FROM idx UNION ALL SELECT dst, src, w, e FROM idx
), comp(i, v) AS (
  SELECT e, src FROM idx
  UNION
  SELECT comp.i, arcs.b FROM comp JOIN idx ON idx.e = comp.i JOIN arcs ON arcs.a = comp.v AND (arcs.w, arcs.e) <= (idx.w, idx.e)
), touch AS (
  SELECT comp.i, arg_min(arcs.e, row(arcs.w, arcs.e)) AS parent
  FROM comp JOIN idx ON idx.e = comp.i JOIN arcs ON arcs.a = comp.v AND (arcs.w, arcs.e) > (idx.w, idx.e) GROUP BY comp.i
), dendro AS (
  SELECT e, src, dst, w, coalesce(parent, e) AS parent FROM idx LEFT JOIN touch ON touch.i = idx.e
)
{final}"""


MSF_SQL = """reach(i, v) AS (
  SELECT e, src FROM idx
  UNION
  SELECT reach.i, arcs.b FROM reach JOIN idx ON idx.e = reach.i JOIN arcs ON arcs.a = reach.v AND (arcs.w, arcs.e) < (idx.w, idx.e)
)"""


def _msf_sql(edges: str) -> str:
    """The cycle rule: an edge stays unless lesser edges connect its ends."""
    return f"""
WITH RECURSIVE graph AS (
  {edges}
), idx AS (
  SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM graph
), arcs AS (
  SELECT src AS a, dst AS b, w, e FROM idx UNION ALL SELECT dst, src, w, e FROM idx
), {MSF_SQL}
SELECT src, dst, w FROM idx WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.i = idx.e AND reach.v = idx.dst)"""


def _prim_sql(edges: str, final: str = "SELECT s AS src, t AS dst, w FROM prim WHERE s IS NOT NULL") -> str:
    """Prim's rule: the least edge that leaves the vertices reached so far; where none does, the least vertex left starts a tree."""
    return f"""
WITH RECURSIVE graph AS MATERIALIZED (
  {edges}
), arcs AS MATERIALIZED (
  SELECT src AS a, dst AS b, w::DOUBLE AS w, src AS s, dst AS t FROM graph UNION ALL SELECT dst, src, w::DOUBLE, src, dst FROM graph
), prim(id, w, s, t, done) USING KEY (id) AS (
  SELECT DISTINCT a, 'infinity'::DOUBLE, NULL::BIGINT, NULL::BIGINT, false FROM arcs
  UNION
  (WITH pick AS (SELECT * FROM recurring.prim WHERE NOT done ORDER BY w, s, t, id LIMIT 1)
  SELECT id, w, s, t, true FROM pick
  UNION ALL
  SELECT own.id, arcs.w, arcs.s, arcs.t, false FROM pick JOIN arcs ON arcs.a = pick.id JOIN recurring.prim own ON own.id = arcs.b
  WHERE NOT own.done AND (own.s IS NULL OR (arcs.w, arcs.s, arcs.t) < (own.w, own.s, own.t)))
)
{final}"""


EMBEDDING_SQL = """SELECT a.id AS src, b.id AS dst,
    cast(list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x) AS BIGINT) AS w
  FROM points a JOIN points b ON a.id < b.id"""
POINTS_SQL = """points AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS x FROM embeddings
), """


def _embedding_sql(final: str) -> str:
    return final.replace("WITH RECURSIVE ", "WITH RECURSIVE " + POINTS_SQL, 1)


TRIANGLES_SQL = f"""edges AS (
  {COPART_SQL}
), tri AS (
  SELECT a.src AS u, a.dst AS v, b.dst AS w FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst
)"""
SUPPORT_SQL = f"""{TRIANGLES_SQL}, sides AS (
  SELECT u AS src, v AS dst, 1 AS hit FROM tri UNION ALL SELECT u, w, 1 FROM tri UNION ALL SELECT v, w, 1 FROM tri
), support AS (
  SELECT src, dst, count(hit) AS support FROM edges LEFT JOIN sides USING (src, dst) GROUP BY src, dst
)"""
SUPPLY_DEGREES = f"""graph AS (
  {SUPPLY_SQL}
), deg AS (
  SELECT id, count(*) AS degree FROM (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph) GROUP BY id
)"""
EVENTS_SQL = """seq AS (
  SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, cast(round(value * 100) AS BIGINT) AS w FROM events
)"""
GEO_SQL = """SELECT n_regionkey::BIGINT AS src, n_nationkey + 100 AS dst, (n_nationkey % 7)::BIGINT AS w FROM nation
  UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000, cast(round(s_acctbal * 100) AS BIGINT) FROM supplier
  UNION ALL SELECT c_nationkey + 100, c_custkey + 10000000, cast(round(c_acctbal * 100) AS BIGINT) FROM customer"""
CATERPILLAR_SQL = "SELECT CASE WHEN i < {h} THEN i ELSE i - {h} END AS src, i + 1 AS dst{w} FROM range({m}) t(i)"

TOP_SQL = f"""
WITH edges AS (
  {COPART_SQL}
), deg AS (
  SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id
), up AS (
  SELECT CASE WHEN (a.d, src) < (b.d, dst) THEN src ELSE dst END AS lo, CASE WHEN (a.d, src) < (b.d, dst) THEN dst ELSE src END AS hi
  FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst
), shared AS (
  SELECT x.lo, x.hi, count(*) AS shared FROM up x JOIN up y ON y.lo = x.hi JOIN up z ON z.lo = x.lo AND z.hi = y.hi GROUP BY x.lo, x.hi
)
SELECT lo, hi, coalesce(shared, 0) AS shared, 1.0::DOUBLE / (coalesce(shared, 0) + 1) AS w FROM up LEFT JOIN shared USING (lo, hi)
QUALIFY row_number() OVER (PARTITION BY lo ORDER BY coalesce(shared, 0) DESC, hi) <= 5"""


def _over_forest(edges: str, kind: str) -> str:
    """The dendrogram of the spanning forest of edges whose weights are of this type."""
    forest = _prim_sql(edges, f"SELECT s AS src, t AS dst, w::{kind} AS w FROM prim WHERE s IS NOT NULL")
    return _dendrogram_sql("SELECT * FROM msf").replace("WITH RECURSIVE", f"WITH RECURSIVE msf AS MATERIALIZED ({forest}), ")


#: Edges fall at the level to which the least support among those left has risen, with all their triangles.
TRUSS_SQL = f"""
WITH RECURSIVE edges AS MATERIALIZED (
  SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS id FROM ({NEIGHBOURS_SQL})
), tri AS MATERIALIZED (
  SELECT row_number() OVER () AS t, a.id AS x, b.id AS y, c.id AS z
  FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst
), sides AS MATERIALIZED (
  SELECT t, unnest([x, y, z]) AS id FROM tri
), total AS MATERIALIZED (
  SELECT edges.id, count(t) AS support FROM edges LEFT JOIN sides USING (id) GROUP BY edges.id
), peel(id, support, k) USING KEY (id) AS (
  SELECT id, support, NULL::BIGINT FROM total
  UNION
  (WITH level AS (
    SELECT greatest(coalesce(max(k), 0), min(support) FILTER (k IS NULL)) AS l, max(k) AS before FROM recurring.peel HAVING count(*) FILTER (k IS NULL) > 0
  ), live AS (
    SELECT sides.t FROM sides JOIN recurring.peel p ON p.id = sides.id AND p.k IS NULL GROUP BY sides.t HAVING count(*) = 3
  ), falls AS (
    SELECT p.id, level.l FROM recurring.peel p, level WHERE p.k IS NULL AND p.support <= level.l
  ), hit AS (
    SELECT DISTINCT live.t FROM live JOIN sides USING (t) JOIN falls USING (id)
  ), lost AS (
    SELECT id, count(*) AS n FROM hit JOIN sides USING (t) GROUP BY id
  )
  SELECT p.id, p.support - coalesce(lost.n, 0), falls.l FROM recurring.peel p LEFT JOIN lost USING (id) LEFT JOIN falls USING (id)
  WHERE p.k IS NULL AND (falls.id IS NOT NULL OR lost.id IS NOT NULL))
)
SELECT edges.src, edges.dst, total.support, peel.k FROM edges JOIN total USING (id) JOIN peel USING (id)"""

ORACLE_SQL: dict[str, str] = {
    "star_nation_dendrogram": """
SELECT c_nationkey::BIGINT AS hub, c_custkey AS e, cast(round(c_acctbal * 100) AS BIGINT) AS w,
  coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY cast(round(c_acctbal * 100) AS BIGINT), c_custkey), c_custkey) AS parent FROM customer""",
    "hook_customer_dendrogram": _dendrogram_sql(HOOK_SQL),
    "hook_customer_rake_compress": _dendrogram_sql(HOOK_SQL),
    "hook_customer_rounds": _dendrogram_sql(HOOK_SQL),
    "geo_tree_dendrogram": _dendrogram_sql(GEO_SQL),
    "event_cartesian": f"""
WITH {EVENTS_SQL}, pairs AS (
  SELECT a.seq_id, a.pos, b.pos AS other, b.w AS bw FROM seq a JOIN seq b ON a.seq_id = b.seq_id AND (b.w, b.pos) > (a.w, a.pos)
), near AS (
  SELECT seq_id, pos, max(other) FILTER (other < pos) AS l, min(other) FILTER (other > pos) AS r FROM pairs GROUP BY seq_id, pos
), best AS (
  SELECT near.seq_id, near.pos, arg_min(seq.pos, row(seq.w, seq.pos)) AS parent FROM near JOIN seq ON seq.seq_id = near.seq_id AND seq.pos IN (near.l, near.r) GROUP BY near.seq_id, near.pos
)
SELECT seq_id, pos, w, coalesce(parent, pos) AS parent FROM seq LEFT JOIN best USING (seq_id, pos)""",
    "trade_msf": _msf_sql(TRADE_SQL),
    "trade_dendrogram": _dendrogram_sql("SELECT * FROM msf").replace("WITH RECURSIVE", f"WITH RECURSIVE msf AS ({_msf_sql(TRADE_SQL)}), "),
    "copart_triangles": f"""
WITH edges AS MATERIALIZED (
  {COPART_SQL}
), deg AS MATERIALIZED (
  SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id
), up AS MATERIALIZED (
  SELECT CASE WHEN (a.d, src) < (b.d, dst) THEN src ELSE dst END AS lo, CASE WHEN (a.d, src) < (b.d, dst) THEN dst ELSE src END AS hi
  FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst
), tri AS (
  SELECT list_sort([x.lo, x.hi, y.hi]) AS t FROM up x JOIN up y ON y.lo = x.hi JOIN up z ON z.lo = x.lo AND z.hi = y.hi
)
SELECT t[1] AS u, t[2] AS v, t[3] AS w FROM tri""",
    "copart_support": f"WITH {SUPPORT_SQL} SELECT src, dst, support FROM support",
    "copart_inverse_triangles": f"WITH {SUPPORT_SQL} SELECT src, dst, 1.0::DOUBLE / support AS w FROM support WHERE support > 0",
    "copart_triangle_weights": TOP_SQL,
    "embedding_msf": _embedding_sql(_prim_sql(EMBEDDING_SQL, "SELECT s AS src, t AS dst, w::BIGINT AS w FROM prim WHERE s IS NOT NULL")),
    "embedding_dendrogram": _embedding_sql(_over_forest(EMBEDDING_SQL, "BIGINT")),
    "copart_similarity_dendrogram": _over_forest(f"SELECT least(lo, hi) AS src, greatest(lo, hi) AS dst, w FROM ({TOP_SQL})", "DOUBLE"),
    "supplier_truss": TRUSS_SQL,
    "supplier_truss_rounds": TRUSS_SQL,
    "trade_boruvka": _msf_sql(TRADE_SQL),
    "gen_uniform_hook": f"""
SELECT (one * 2147483648 + (one * 69621 + 1) % 2147483647) % i AS dst, i AS src, 1::BIGINT AS w
FROM (SELECT i, (i % 2147483647 * 48271 + 16807) % 2147483647 AS one FROM range(1, {N}) t(i))""",
    "file_adjacency": COPART_SQL,
    "file_adjacency_float": f"""
WITH graph AS (
  {COPART_SQL}
), deg AS (
  SELECT id, count(*) AS degree FROM (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph) GROUP BY id
)
SELECT src, dst, 1.0::DOUBLE / (a.degree + b.degree) AS w FROM graph JOIN deg a ON a.id = src JOIN deg b ON b.id = dst""",
    "file_adjacency_int": HOOK_SQL,
    "file_edge_list": HOOK_SQL,
    "file_binary": HOOK_SQL,
    "file_parquet": HOOK_SQL,
    "copart_components": f"""
WITH RECURSIVE edges AS (
  {COPART_SQL}
), arcs AS (
  SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges
), label(id, component) USING KEY (id) AS (
  SELECT a, min(least(a, b)) FROM arcs GROUP BY a
  UNION
  SELECT arcs.b, min(label.component) FROM label JOIN arcs ON arcs.a = label.id JOIN recurring.label AS own ON own.id = arcs.b WHERE label.component < own.component GROUP BY arcs.b
)
SELECT id, component FROM label""",
    "deg_weights": f"WITH {SUPPLY_DEGREES} SELECT src, dst, 1.0::DOUBLE / (a.degree + b.degree) AS w FROM graph JOIN deg a ON a.id = src JOIN deg b ON b.id = dst",
    "graph_degrees": f"WITH {SUPPLY_DEGREES} SELECT id, degree FROM deg",
    "graph_offsets": f"WITH {SUPPLY_DEGREES} SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS \"offset\" FROM deg",
    "graph_oriented": f"""WITH {SUPPLY_DEGREES} SELECT CASE WHEN (a.degree, src) < (b.degree, dst) THEN src ELSE dst END AS lo,
  CASE WHEN (a.degree, src) < (b.degree, dst) THEN dst ELSE src END AS hi FROM graph JOIN deg a ON a.id = src JOIN deg b ON b.id = dst""",
    "graph_directed": f"WITH graph AS ({SUPPLY_SQL}) SELECT src, dst, 0.0::DOUBLE AS w FROM graph UNION ALL SELECT dst, src, 0.0::DOUBLE FROM graph",
    "graph_edge_index": f"WITH graph AS ({SUPPLY_SQL}) SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e FROM graph",
    "canonical_min": "SELECT o_custkey AS src, l_partkey + 10000000 AS dst, min(cast(round(l_extendedprice * 100) AS BIGINT)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "customer_flat_clusters": f"""
WITH RECURSIVE edges AS (
  {HOOK_SQL}
), arcs AS (
  SELECT src AS a, dst AS b FROM edges WHERE w <= 500000 UNION ALL SELECT dst, src FROM edges WHERE w <= 500000
), reach(id, dest) AS (
  SELECT id, id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
  UNION
  SELECT reach.id, arcs.b FROM reach JOIN arcs ON arcs.a = reach.dest
)
SELECT id, min(dest) AS cluster FROM reach GROUP BY id""",
    "hook_customer_heights": _dendrogram_sql(HOOK_SQL, "SELECT e, src, dst, w, parent, height FROM dendro JOIN (SELECT top, max(h) AS height FROM climb GROUP BY top) ON top = e").replace(
        ")\nSELECT e, src, dst, w, parent, height", "), climb(top, h) AS (\n  SELECT e, 1::BIGINT FROM dendro\n  UNION\n  SELECT d.parent, climb.h + 1 FROM climb JOIN dendro d ON d.e = climb.top WHERE d.parent <> d.e\n)\nSELECT e, src, dst, w, parent, height"),
    "gen_path": f"SELECT i AS src, i + 1 AS dst, 1::BIGINT AS w FROM range({N - 1}) t(i)",
    "gen_star": f"SELECT 0::BIGINT AS src, i AS dst, 1::BIGINT AS w FROM range(1, {N}) t(i)",
    "gen_caterpillar": CATERPILLAR_SQL.format(h=((1 << K) - 1) // 2, m=(1 << K) - 1, w=", 1::BIGINT AS w"),
    "gen_full_binary": f"SELECT i AS src, unnest([2 * i + 1, 2 * i + 2]) AS dst, 1::BIGINT AS w FROM range({((1 << K) - 1) // 2}) t(i)",
    "low_parallelism_weights": f"""WITH edges AS (
  {HOOK_SQL}
), idx AS (
  SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS e, count(*) OVER () AS m FROM edges
)
SELECT src, dst, CASE WHEN e < m // 2 THEN e ELSE m - 1 - e + m // 2 END AS w FROM idx""",
    "permutation_weights": f"SELECT src, dst, row_number() OVER (ORDER BY (src * 2654435761 + dst * 40503) % 1000003, src, dst) AS w FROM (\n  {HOOK_SQL}\n)",
    "path_unit_dendrogram": f"SELECT i AS e, i AS src, i + 1 AS dst, 1::BIGINT AS w, least(i + 1, {N - 2}) AS parent FROM range({N - 1}) t(i)",
    "caterpillar_dendrogram": _dendrogram_sql("SELECT src, dst, CASE WHEN i < 127 THEN i ELSE 254 - i + 127 END AS w FROM (" + CATERPILLAR_SQL.format(h=127, m=255, w=", i") + ")"),
}
ORACLE_SQL["event_cartesian_long"] = ORACLE_SQL["event_cartesian"]
ORACLE_SQL["copart_components_stars"] = ORACLE_SQL["copart_components"]
ORACLE_SQL["file_dendrogram"] = ORACLE_SQL["trade_dendrogram"]
