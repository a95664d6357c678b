"""python -m sylvan: build a dendrogram from a graph file or a generated tree and write it as Parquet."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from sylvan.functions.weights import SCHEMES
from sylvan.operators.msf import minimum_spanning_forest
from sylvan.plans import flow
from sylvan.runtime import materialize, shared_path
from sylvan.sources.generators import GENERATORS
from sylvan.sources.graph_files import read_graph, save_binary, write_adjacency, write_binary, write_parents


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sylvan", description=__doc__)
    p.add_argument("path", nargs="?", help="graph file")
    p.add_argument("--generate", choices=sorted(GENERATORS), help="a tree instead of a file")
    p.add_argument("--size", type=int, default=10, help="n, or k for caterpillar and full_binary")
    p.add_argument("--format", default="adjacency", choices=["adjacency", "edges", "binary", "parquet"])
    p.add_argument("--weight", choices=["int", "float"], help="type of the weights in the file")
    p.add_argument("--scheme", choices=sorted(SCHEMES))
    p.add_argument("--forest", action="store_true", help="the graph is a forest already")
    p.add_argument("--method", default="auto", choices=["auto", "union_find", "rounds", "rake_compress", "chain"])
    p.add_argument("--rounds", type=int, default=1, help="repeat and print the mean time")
    p.add_argument("--out", help="folder for the dendrogram (Parquet)")
    p.add_argument("--parents", help="folder for the parents alone (text, in the order of the edges)")
    p.add_argument("--write-graph", help="file for the weighted graph (binary)")
    p.add_argument("--write-tree", help="folder for the spanning forest (adjacency text)")
    a = p.parse_args(args)
    if (a.path is None) == (a.generate is None):
        p.error("give a graph file or --generate")
    spark = SparkSession.builder.getOrCreate()
    took = []
    for _ in range(a.rounds):
        start = time.time()
        if a.generate:
            tree = flow.from_generator(spark, a.generate, a.size, a.scheme, a.method)
        else:
            tree = flow.from_file(spark, a.path, a.format, a.weight, a.scheme, a.forest, a.method)
        tree.write.mode("overwrite").format("parquet" if a.out else "noop").save(*([a.out] if a.out else []))
        took.append(time.time() - start)
    if a.parents:
        write_parents(spark.read.parquet(a.out) if a.out else tree, a.parents)
    if a.write_graph or a.write_tree:
        edges = GENERATORS[a.generate](spark, a.size) if a.generate else read_graph(spark, a.path, a.format, a.weight)
        graph = materialize(flow.weighted_graph(edges, a.scheme), "graph")
        if a.write_graph:
            slabs = shared_path(spark, "slabs")
            write_binary(graph, slabs, "float" if dict(graph.dtypes)["w"] in ("float", "double") else "int")
            save_binary(spark, slabs, a.write_graph)
        if a.write_tree:
            write_adjacency(minimum_spanning_forest(graph), a.write_tree)
    print(f"mean time: {sum(took) / len(took):.3f} s")


if __name__ == "__main__":
    main()
