"""The HTTP surface as a pure function: route and parameters to a JSON-ready dict."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphlake import errors
from graphlake.graph import EDGE_CAPACITY, NODE_CAPACITY, Graph
from graphlake.operators import analytics, traversal
from graphlake.sources import export, kg

VERSION = "0.1.0"


class Service:
    """Routes over one graph."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def handle(self, route: str, body: dict | None = None) -> dict:
        body = body or {}
        call = {
            "GET /health": self.health,
            "GET /graph/stats": self.stats,
            "POST /graph/algorithms/bfs": self.bfs,
            "POST /graph/algorithms/dijkstra": self.dijkstra,
            "POST /graph/algorithms/pagerank": self.pagerank,
            "POST /graph/algorithms/community": self.community,
            "GET /graph/visualizer/data": self.visualizer,
            "GET /graph/visualizer/nodes": self.visualizer_nodes,
            "GET /graph/visualizer/edges": self.visualizer_edges,
            "POST /import/csv": self.import_csv,
        }.get(route)
        return call(**body) if call else {"error": 404}

    def _counts(self) -> dict:
        row = self.graph.stats().first()
        return {"database_nodes": row.node_count, "database_edges": row.edge_count}

    def health(self) -> dict:
        return {"status": "healthy", "service": "graphlake", "version": VERSION}

    def stats(self) -> dict:
        c = self._counts()
        return {"nodes": c["database_nodes"], "edges": c["database_edges"], "utilization": 100 * (c["database_nodes"] + c["database_edges"]) / (NODE_CAPACITY + EDGE_CAPACITY)}

    def bfs(self, source: int, target: int | None = None) -> dict:
        tree = traversal.bfs(self.graph.live_edges, source, self.graph.live_nodes)
        rows = tree.orderBy("distance", "id").collect()
        path = traversal.shortest_path(tree, target) if target is not None else None
        return {"visited_nodes": [r.id for r in rows], "path": path or [], "depth": max(r.distance for r in rows)} | self._counts()

    def dijkstra(self, source: int, target: int) -> dict:
        e = self.graph.live_edges
        e = e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0))
        tree = traversal.sssp(e, source, self.graph.live_nodes)
        path = traversal.shortest_path(tree, target) or []
        cost = {r.id: r.distance for r in tree.where(F.col("id").isin(path)).collect()} if path else {}
        return {"shortest_path": path, "total_cost": cost.get(target), "path_details": [{"node": p, "cost": cost[p]} for p in path]} | self._counts()

    def pagerank(self, damping: float = 0.85, max_iter: int = 20, tol: float = 1e-6) -> dict:
        ranks, n, done = analytics.pagerank(self.graph.live_nodes, self.graph.live_edges, damping, max_iter, tol)
        return {"node_scores": {str(r.id): r.rank for r in ranks.collect()}, "iterations": n, "convergence": done} | self._counts()

    def community(self, max_iter: int = 10) -> dict:
        e = self.graph.with_undirected()
        labels = analytics.label_propagation(e, max_iter)
        groups = labels.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members")).orderBy(F.desc(F.size("members")), "community").collect()
        return {"communities": [list(r.members) for r in groups], "modularity": analytics.modularity(e, labels).first()[0]} | self._counts()

    def visualizer(self) -> dict:
        out = json.loads(export.visualizer(self.graph.live_nodes, self.graph.live_edges).first().json)
        m = out["metadata"]
        out["metadata"] = m | {"utilization": (m["node_count"] + m["edge_count"]) / (NODE_CAPACITY + EDGE_CAPACITY), "source": "graph"}
        return out

    def visualizer_nodes(self) -> dict:
        n = self.visualizer()["nodes"]
        return {"nodes": n, "count": len(n), "metadata": {"total_nodes": len(n)}}

    def visualizer_edges(self) -> dict:
        e = self.visualizer()["edges"]
        return {"edges": e, "count": len(e), "metadata": {"total_edges": len(e)}}

    def import_csv(self, path: str) -> dict:
        return kg.import_csv(self.graph.nodes.sparkSession, path)

    def tcp(self, request: str) -> str:
        """The line protocol of the embedded server."""
        return json.dumps(self.visualizer()) if request.strip() == "GET_VISUALIZER" else "ERROR: unknown request"

    def node(self, node_id: int) -> dict:
        try:
            return self.graph.get_node(node_id)
        except errors.NodeNotFound:
            return {"error": 404}
