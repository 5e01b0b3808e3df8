"""The graph engine on small graphs with known answers, and against plain Python."""

import heapq
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphlake import capacity, errors
from graphlake import schema as S
from graphlake.functions import vectors as V
from graphlake.graph import Graph
from graphlake.operators import analytics, columnar, gnn, mutate, traversal, vector
from graphlake.operators.components import connected_components
from graphlake.operators.prefix import running_total
from graphlake.plans import cypher
from graphlake.service import Service
from graphlake.session import cut
from graphlake.sources import export, kg
from graphlake.streaming import ingest

USERS = [(1, "user", "u1"), (2, "user", "u2"), (3, "content", "post"), (4, "content", "comment")]
ACTS = [(1, 3, "CREATED"), (1, 4, "WROTE"), (2, 3, "MODERATED"), (3, 4, "HAS_COMMENT")]


@pytest.fixture(scope="module")
def g(spark):
    return Graph.from_rows(spark, USERS, ACTS, "id bigint, label string, name string")


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_filters_and_lookups(spark, g):
    assert ids(g.nodes_by_label("user")) == [1, 2] and ids(g.nodes_by_label("content", limit=1)) == [3]
    assert ids(g.outgoing(1), "dst") == [3, 4] and ids(g.incoming(4), "src") == [1, 3]
    assert ids(g.edges_by_label("CREATED", "WROTE"), "dst") == [3, 4]
    assert g.get_node(2)["name"] == "u2"
    with pytest.raises(errors.NodeNotFound):
        g.get_node(9)
    with pytest.raises(errors.PropertyNotFound):
        g.nodes_by_property("user", "nope", 1)
    assert ids(g.nodes_by_property("user", "name", "u1")) == [1]
    assert ids(g.lookup(spark.createDataFrame([(2,), (7,)], "id bigint"))) == [2]
    assert ids(g.expand(spark.createDataFrame([(3,)], "id bigint"), "both"), "other") == [1, 2, 4]
    assert {r.id: r.degree for r in g.degrees("in").collect()} == {3: 2, 4: 2}
    assert g.stats().first().utilization == round(8 / 60000, 6)


def test_soft_delete_keeps_edges(spark, g):
    h = g.delete_nodes(spark.createDataFrame([(3,)], "id bigint"))
    assert ids(h.live_nodes) == [1, 2, 4] and h.live_edges.count() == 4


def test_bfs_and_paths(spark):
    e = spark.createDataFrame([(100, 101), (101, 102), (102, 103), (100, 103), (5, 6)], "src bigint, dst bigint")
    n = spark.createDataFrame([(i,) for i in (100, 101, 102, 103, 5, 6)], "id bigint")
    tree = traversal.bfs(e, 100, n)
    assert sorted(tuple(r) for r in tree.collect()) == [(100, 0, None), (101, 1, 100), (102, 2, 101), (103, 1, 100)]
    assert traversal.shortest_path(tree, 102) == [100, 101, 102] and traversal.shortest_path(tree, 5) is None
    assert {r.id: r.distance for r in traversal.with_unreachable(tree, n).collect()}[6] == float("inf")
    with pytest.raises(errors.NodeNotFound):
        traversal.bfs(e, 42, n)
    assert ids(traversal.khop(e, 100, 1)) == [100, 101, 103]
    w = traversal.walks(e, spark.createDataFrame([(100,)], "id bigint"), 2)
    assert [tuple(r) for r in w.collect()] == [(100, 102, 1)]


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 21)], "src bigint, dst bigint")
    assert traversal.bfs(e, 1).agg(F.max("distance")).first()[0] == 20
    c = connected_components(e)
    assert {r.component for r in c.collect()} == {1} and c.count() == 21


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(1, 40), r.randint(1, 40), float(r.randint(1, 9))) for _ in range(70)]
    e = cut(spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"))
    out = defaultdict(list)
    for a, b, w in pairs:
        out[a].append((b, w))
    start = pairs[0][0]
    hops, queue = {start: 0}, [start]
    for a in queue:
        for b, _ in out[a]:
            if b not in hops:
                hops[b] = hops[a] + 1
                queue.append(b)
    assert {x.id: x.distance for x in traversal.bfs(e, start).collect()} == hops
    best, heap = {}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in best:
            best[a] = d
            for b, w in out[a]:
                heapq.heappush(heap, (d + w, b))
    tree = cut(traversal.sssp(e, start))
    assert {x.id: x.distance for x in tree.collect()} == best
    far = max(best, key=best.get)
    path = traversal.shortest_path(tree, far)
    assert path[0] == start and sum(min(w for b, w in out[x] if b == y) for x, y in zip(path, path[1:])) == best[far]
    head = {v: v for a, b, _ in pairs for v in (a, b)}

    def find(v):
        while head[v] != v:
            v = head[v]
        return v

    for a, b, _ in pairs:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    want = {v: find(v) for a, b, _ in pairs if a != b for v in (a, b)}
    assert {x.id: x.component for x in connected_components(e).collect()} == want
    und = {(min(a, b), max(a, b)) for a, b, _ in pairs if a != b}
    tri = sum((a, b) in und and (b, c) in und and (a, c) in und for a in range(1, 41) for b in range(a + 1, 41) for c in range(b + 1, 41))
    assert analytics.triangles(Graph(e, e).with_undirected()).first()[0] == tri


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        traversal.sssp(spark.createDataFrame([(1, 2, -1.0)], "src bigint, dst bigint, weight double"), 1)


def test_pagerank(spark):
    ring = spark.createDataFrame([(i, i % 5 + 1) for i in range(1, 6)] * 4, "src bigint, dst bigint")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "id bigint")
    ranks, _, done = analytics.pagerank(n, ring, max_iter=60, tol=1e-9)
    got = {r.id: r.rank for r in ranks.collect()}
    assert done and abs(got[1] - 1 / 7) < 1e-6 and abs(got[7] - 0.15 / 7) < 1e-9  # two isolated nodes leak their mass
    leak, rounds, done = analytics.pagerank(n, spark.createDataFrame([(1, 2), (1, 99)], "src bigint, dst bigint"), max_iter=1, tol=0)
    assert rounds == 1 and not done and abs({r.id: r.rank for r in leak.collect()}[2] - (0.15 / 7 + 0.85 / 7 / 2)) < 1e-12


def test_communities_and_modularity(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "u bigint, v bigint")
    labels = analytics.label_propagation(e)
    got = defaultdict(set)
    for r in labels.collect():
        got[r.community].add(r.id)
    assert {1, 2, 3} in got.values()
    c = spark.createDataFrame([(i, 1 if i < 4 else 2) for i in range(1, 7)], "id bigint, community bigint")
    assert abs(analytics.modularity(e, c).first()[0] - 2 * (3 / 7 - 0.25)) < 1e-12
    assert [tuple(r) for r in analytics.communities_by_size(c).orderBy("rank").collect()] == [(1, 3, 1), (2, 3, 2)]


REGISTRY = S.Registry().register(S.Schema("Person", (S.Property("name", "string", required=True), S.Property("age", "integer"), S.Property("email", "string", required=True), S.Property("salary", "float"), S.Property("tags", "vector"), S.Property("ok", "boolean"))))


@pytest.mark.parametrize(
    ("label", "props", "error"),
    [
        ("Person", {"name": "A", "age": 3, "email": "e", "salary": 1.5, "tags": [1.0, 2.5], "ok": True}, None),
        ("Person", {"name": "A"}, "MissingRequiredProperty:email"),
        ("Person", {"name": "A", "email": "e", "age": "x"}, "TypeMismatch:age"),
        ("Person", {"name": "A", "email": None}, "TypeMismatch:email"),
        ("Person", {"name": "A", "email": "e", "foo": 1}, "UnknownProperty:foo"),
        ("Dog", {}, "UnknownSchema"),
    ],
)
def test_validation(spark, label, props, error):
    df = spark.createDataFrame([(1, label, json.dumps(props))], "id bigint, label string, properties string")
    assert S.validate(df, REGISTRY).first().error == error
    if error:
        with pytest.raises(getattr(errors, error.partition(":")[0])):
            S.require_valid(df, REGISTRY)
    else:
        assert S.require_valid(df, REGISTRY) is df


def test_mutations(spark, g):
    h = mutate.insert_nodes(g, spark.createDataFrame([(5, "user", "u5")], "id bigint, label string, name string"))
    assert ids(h.nodes) == [1, 2, 3, 4, 5]
    with pytest.raises(errors.DuplicateNode):
        mutate.insert_nodes(g, spark.createDataFrame([(1, "user", "again")], "id bigint, label string, name string"))
    with pytest.raises(errors.NodeNotFound):
        mutate.insert_edges(g, spark.createDataFrame([(1, 77, "X")], "src bigint, dst bigint, label string"))
    with pytest.raises(errors.InvalidEdge):
        mutate.insert_edges(g, spark.createDataFrame([(1, 1, "X")], "src bigint, dst bigint, label string"))
    twice = mutate.insert_edges(g, spark.createDataFrame([(1, 3, "CREATED")], "src bigint, dst bigint, label string"))
    assert twice.edges.count() == 5
    assert mutate.update_property(g.nodes, 1, "name", "new").where("id = 1").first().name == "new"
    with pytest.raises(errors.PropertyNotFound):
        mutate.update_property(g.nodes, 1, "nope", 1)
    with pytest.raises(errors.NodeNotFound):
        mutate.update_property(g.nodes, 99, "name", "x")
    log = mutate.log_entry(g.nodes.withColumn("lsn", F.col("id")), "upsert", "lsn", "id").unionByName(mutate.log_entry(g.nodes.where("id = 2").withColumn("lsn", F.lit(50).cast("long")), "delete", "lsn", "id"))
    assert mutate.intact(log).count() == 5 and ids(mutate.replay(log), "key") == [1, 3, 4]
    assert mutate.intact(log.withColumn("payload", F.lit("x"))).count() == 0


def test_columnar(spark):
    df = spark.createDataFrame([(0, 5, 1.5, "a"), (1, 7, 2.5, "a"), (2, 7, None, "b")], "row_idx bigint, i bigint, f double, s string")
    assert columnar.aggregate(df, "i", "sum") == 19 and columnar.aggregate(df, "f", "average") == 2.0
    with pytest.raises(errors.UnsupportedAggregationType):
        columnar.aggregate(df, "s", "sum")
    with pytest.raises(errors.EmptyColumn):
        columnar.aggregate(df.limit(0), "i", "count")
    assert ids(columnar.rows_equal(df, "i", 7), "row_idx") == [1, 2] and ids(columnar.rows_between(df, "f", 1.5, 2.5), "row_idx") == [0, 1]
    assert columnar.value_at(df, "s", 2) == "b"
    with pytest.raises(errors.IndexOutOfBounds):
        columnar.value_at(df, "s", 3)
    d = columnar.delta_encode(df, "i", "row_idx")
    assert [r.delta for r in d.orderBy("row_idx").collect()] == [5, 2, 0]
    assert [r.value for r in columnar.delta_decode(d, "row_idx").orderBy("row_idx").collect()] == [5, 7, 7]
    assert [tuple(r) for r in columnar.dictionary(df, "s", "row_idx").orderBy("code").collect()] == [("a", 0), ("b", 1)]
    runs = columnar.run_lengths(df.withColumn("k", F.lit(1)), "i", "row_idx", ["k"])
    assert [(r.value, r.length) for r in runs.orderBy("run").collect()] == [(5, 1), (7, 2)]
    assert tuple(columnar.bit_width(df, "i").first()) == (3, 2, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>, z array<float>, m array<float>")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(V.cosine("a", "b")) == 0 and one(V.cosine("a", "z")) == 0 and one(V.cosine("a", "m")) == -1 and one(V.cosine("a", "a")) == 1
    assert one(V.similarity("euclidean", "a", "m")) == pytest.approx(1 / 3) and one(V.distance("manhattan", "a", "b")) == 3
    with pytest.raises(errors.UnsupportedVectorType):
        V.similarity("chebyshev", "a", "b")
    small = spark.createDataFrame([(2000 + i, [(10 * i + j) * 0.01 for j in range(128)]) for i in range(5)], "id bigint, embedding array<float>")
    assert vector.topk(small, [j * 0.01 for j in range(128)], 3).first().id == 2000
    ix = vector.VectorIndexes()
    ix.create("v", 2, "euclidean")
    assert ix.insert(spark, "v", [[0.0, 0.0], [3.0, 4.0]]) == [1, 2] and ix.get("v", 2) == [3.0, 4.0]
    assert [(r.id, r.distance) for r in ix.search("v", [0.0, 0.0], 2).collect()] == [(1, 0.0), (2, 5.0)]
    assert ix.stats() == {"indexes": 1, "vectors": 2, "dimensions": 2, "bytes": 16}
    for bad, error in ((lambda: ix.get("w", 1), errors.IndexNotFound), (lambda: ix.get("v", 9), errors.IndexOutOfBounds), (lambda: ix.create("u", 2, kind="int8"), errors.UnsupportedVectorType), (lambda: ix.search("v", [1.0], 1), ValueError)):
        with pytest.raises(error):
            bad()


def test_gnn(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])], "id bigint, vector array<double>")
    e = spark.createDataFrame([(1, 3), (2, 3)], "src bigint, dst bigint")
    assert {r.id: r.vector for r in gnn.message_passing(f, e).collect()} == {1: [1, 0], 2: [0, 1], 3: [0.5, 0.5]}
    h = {r.id: r.vector for r in gnn.graph_convolution(f, e.select(F.col("src").alias("u"), F.col("dst").alias("v")), [[1.0], [1.0]]).collect()}
    assert h[1][0] == pytest.approx(1 / 2 + 4 / 6**0.5)
    a = gnn.attention(f, spark.createDataFrame([(1, 2), (1, 3)], "src bigint, dst bigint")).first().vector
    w = 2.718281828459045 ** (2 / 2**0.5)
    assert a == pytest.approx([2 * w / (1 + w), (1 + 2 * w) / (1 + w)])


def test_knowledge_graph(spark, tmp_path):
    (tmp_path / "kg.csv").write_text('head,relation,tail\nKRAS,causes, "Pancreatic Cancer"\n\ns,A,B,rel\nx,y\na,,b\nLoop,is,Loop\n')
    t = kg.parse_triples(kg.read_lines(spark, str(tmp_path / "kg.csv"))).collect()
    assert sorted((r.subject, r.predicate, r.object, r.error or "") for r in t if r.error is None) == [("A", "rel", "B", ""), ("KRAS", "causes", "Pancreatic Cancer", ""), ("Loop", "is", "Loop", "")]
    assert Counter(r.error for r in t if r.error) == {"TooFewFields": 1, "EmptyField": 1}
    out = kg.import_csv(spark, str(tmp_path / "kg.csv"))
    assert (out["triples_parsed"], out["database_nodes"], out["database_edges"]) == (3, 5, 2)
    nt = spark.createDataFrame([('<http://a> <http://p> "x y"@en .',), ("s p o",), ("# no",), ("",)], "line string")
    assert sorted(tuple(r) for r in kg.parse_ntriples(nt).collect()) == [("http://a", "http://p", "x y"), ("s", "p", "o")]
    ents, rels = kg.parse_wide(spark.createDataFrame([("1,N,T",), ("2,M,T,1,x,L",), ("3,Z",)], "line string"))
    assert sorted(tuple(r) for r in ents.collect()) == [(1, "N", "T"), (2, "M", "T")] and [tuple(r) for r in rels.collect()] == [(1, 0, "L")]
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a"}],\n"edges":[{"source":"a","target":"b"}]}')
    n, e = kg.read_json_graph(spark, str(tmp_path / "g.json"))
    assert n.first().id == "a" and e.first().target == "b"
    names = spark.createDataFrame([("Pancreatic cancer",), ("KRAS gene",), ("new therapy",), ("thing",), ("pain inhibitor",)], "name string")
    assert [r.g for r in names.select(kg.group_of("name").alias("g")).collect()] == ["disease", "gene", "drug", "other", "symptom"]


SOCIAL_N = [(1, "Person", "Ann", 30), (2, "Person", "Bob", 28), (3, "Person", "Cy", 35), (4, "Movie", "Up", None), (5, "Movie", "Jaws", None)]
SOCIAL_E = [(1, 2, "KNOWS", 2020), (2, 3, "FRIENDS", 2019), (3, 1, "KNOWS", 2021), (1, 4, "WATCHED", None), (2, 4, "WATCHED", None), (2, 5, "WATCHED", None)]


@pytest.fixture(scope="module")
def social(spark):
    return Graph.from_rows(spark, SOCIAL_N, SOCIAL_E, "id bigint, label string, name string, age bigint", "src bigint, dst bigint, label string, since bigint")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (p:Person) WHERE p.age > 28 AND NOT p.name = 'Cy' RETURN p.name", {("Ann",)}),
        ("MATCH (a {name: 'Ann'})-[r]-(b) RETURN type(r) AS t, b.name", {("KNOWS", "Bob"), ("KNOWS", "Cy"), ("WATCHED", "Up")}),
        ("MATCH (a)-[:KNOWS|FRIENDS]->(b)-[:KNOWS|FRIENDS]->(c) RETURN a.name, c.name", {("Ann", "Cy"), ("Bob", "Ann"), ("Cy", "Bob")}),
        ("MATCH (u:Person {name: 'Ann'})-[:WATCHED]->(m)<-[:WATCHED]-(o) MATCH (o)-[:WATCHED]->(x) WHERE NOT (u)-[:WATCHED]->(x) RETURN DISTINCT x.name", {("Jaws",)}),
        ("MATCH (p)-[r:WATCHED]->(m) WITH m.name AS movie, count(r) AS n WHERE n > 1 RETURN movie, n ORDER BY n DESC LIMIT 5", {("Up", 2)}),
        ("MATCH (a {name: 'Ann'})-[:KNOWS|FRIENDS*2..3]->(b) RETURN b.name", {("Cy",), ("Ann",)}),
        ("MATCH p = shortestPath((a {name: 'Ann'})-[:KNOWS*]-(b:Person)) WHERE a.name <> b.name RETURN b.name, length(p)", {("Bob", 1), ("Cy", 1)}),
        ("MATCH (a:Person)<-[r:KNOWS]-(b:Person) WHERE r.since >= 2021 OR a.age / 2 = 14 RETURN b.name, r.since", {("Ann", 2020), ("Cy", 2021)}),
        ("MATCH (p:Person) RETURN count(*) AS n, avg(p.age) AS age", {(3, 31.0)}),
        ("MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 1", {("Cy",)}),
    ],
)
def test_cypher(social, text, want):
    assert {tuple(r) for r in cypher.query(social, text).collect()} == want


def test_long_paths_are_not_cut_off(spark):
    n = 18
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint")
    assert [tuple(r) for r in traversal.paths(e, 0, n).collect()] == [(list(range(n + 1)), n)]
    g = Graph(
        spark.createDataFrame([(i, "P", f"n{i}") for i in range(n + 1)], "id bigint, label string, name string"),
        spark.createDataFrame([(i, i, i + 1, "R") for i in range(n)], "edge_id bigint, src bigint, dst bigint, label string"),
    )
    walked = cypher.query(g, "MATCH (a {name: 'n0'})-[:R*]->(b) RETURN b.name").collect()
    assert {r[0] for r in walked} == {f"n{i}" for i in range(1, n + 1)}
    for stars, longest in (("*", n), ("*1..15", 15)):
        hops = cypher.query(g, f"MATCH p = shortestPath((a {{name: 'n0'}})-[:R{stars}]->(b)) RETURN length(p)").collect()
        assert max(r[0] for r in hops) == longest


def test_cypher_create_and_errors(social):
    h = cypher.create(social, "MATCH (a:Person {name: 'Ann'}) CREATE (a)-[:KNOWS {since: 2024}]->(d:Person {name: 'Di', age: 20})")
    assert {tuple(r) for r in cypher.query(h, "MATCH (a)-[r:KNOWS]->(d {name: 'Di'}) RETURN a.name, r.since, d.age").collect()} == {("Ann", 2024, 20)}
    whole = cypher.query(social, "MATCH (m:Movie {name: 'Up'}) RETURN m").first().m
    assert whole.id == 4
    for bad in ("MATCH (a RETURN a", "RETURN 1", "MATCH (a)<-[r]->(b) RETURN a", "MATCH (a) RETURN a LIMIT", "FROM x"):
        with pytest.raises(errors.ParseError):
            cypher.query(social, bad)


def test_exports_and_service(spark, g):
    s = Service(g)
    assert s.handle("GET /health")["status"] == "healthy" and s.handle("GET /nope") == {"error": 404}
    assert s.handle("GET /graph/stats")["nodes"] == 4
    b = s.handle("POST /graph/algorithms/bfs", {"source": 1, "target": 4})
    assert b["visited_nodes"] == [1, 3, 4] and b["path"] == [1, 4] and b["depth"] == 1
    assert s.handle("POST /graph/algorithms/dijkstra", {"source": 2, "target": 4})["total_cost"] == 2.0
    assert set(s.handle("POST /graph/algorithms/pagerank", {"max_iter": 3})["node_scores"]) == {"1", "2", "3", "4"}
    assert sum(map(len, s.handle("POST /graph/algorithms/community")["communities"])) == 4
    v = s.handle("GET /graph/visualizer/data")
    assert v["metadata"]["node_count"] == 4 and len(v["edges"]) == 4 and v["edges"][0]["source"] == "1"
    assert s.handle("GET /graph/visualizer/edges")["count"] == 4 and s.tcp("GET_VISUALIZER").startswith("{") and s.tcp("x").startswith("ERROR")
    assert s.node(9) == {"error": 404}
    assert export.coo(g.edges.unionByName(g.edges)).where("row = 1 AND col = 3").first().value == 2
    assert len(export.chain_documents(g.nodes, g.edges)["relationships"]) == 4


def test_capacity():
    assert capacity.pool_size(1000) == 4096 and capacity.pool_size(0) == 1 and capacity.pool_size(1) == 4
    p = capacity.plan(1000, 5000, "recommendation")
    assert (p["nodes"], p["edges"], p["embeddings"], p["properties"]) == (4096, 16384, 4096, 16384)
    assert set(capacity.WORKLOADS) >= {w for _, _, w, _ in capacity.PRESETS.values()} and len(capacity.PRESETS) == 8


def test_running_total_spreads_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), (F.col("id") / 100).cast("int").alias("cell"), F.col("id"), (F.col("id") % 3).alias("v"))
    out = running_total(df, ["g"], "cell", [F.col("id")], "v", "before").orderBy("id").collect()
    total = 0
    for r in out:
        assert r.before == total
        total += r.v


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "c", 12), (None, "d", 13)], "id bigint, v string, lsn bigint").write.parquet(str(src))
    for _ in range(2):
        q = ingest.append_log(spark.readStream.schema("id bigint, v string, lsn bigint").parquet(str(src)), str(tmp_path / "log"), str(tmp_path / "cp"), "upsert", "id", "lsn")
        q.awaitTermination()
    state = mutate.replay(ingest.read_log(spark, str(tmp_path / "log")))
    assert sorted((r.key, r.lsn) for r in state.collect()) == [(1, 11), (2, 12)]


def test_heartbeats(spark):
    hb = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:08"), (2, "2024-01-01 00:00:01")], "id bigint, t string").select("id", F.to_timestamp("t").alias("last_heartbeat"))
    assert ids(ingest.alive(hb, F.to_timestamp(F.lit("2024-01-01 00:00:10")))) == [1]


def test_text_and_json_functions(spark):
    from graphlake.functions import text as X

    df = spark.createDataFrame([('{"a":1,"b":2,"c":3}',), ("[1,2,3,4,5]",), ('{"name":"John"',), (None,)], "j string")
    got = df.select(X.json_valid("j").alias("v"), X.json_has("j", "a").alias("h"), X.json_size("j").alias("n"), X.json_get("j", "$.b", "bigint").alias("b")).collect()
    assert [tuple(r) for r in got][:2] == [(True, True, 3, 2), (True, False, 5, None)] and [r.v for r in got][2:] == [False, False]
    h = 0
    for c in b"KNOWS":
        h = (h ^ c) * 31 % 256
    assert spark.range(1).select(X.label_hash8(F.lit("KNOWS")).alias("h")).first().h == h
    assert spark.range(1).select(X.trim_field(F.lit('\t "x" ')).alias("x")).first().x == "x"
    for bad in ('{"name":"John"', '["a","b"', '{"name":@}', '{"name""John"}'):
        with pytest.raises(errors.ParseError):
            X.parse_json(bad)
    assert X.parse_json('["hello",42,true,null]') == ["hello", 42, True, None]


def test_edge_csv_and_embeddings(spark, tmp_path, g):
    (tmp_path / "e.csv").write_text("label,source,target\nKNOWS,a,b\nKNOWS,b,c\nX,,c\n")
    n, e = kg.read_edge_csv(spark, str(tmp_path / "e.csv"))
    assert sorted(r.name for r in n.collect()) == ["a", "b", "c"] and e.count() == 2 and e.first().label == "KNOWS"
    h = Graph(g.nodes, g.edges, spark.createDataFrame([(1, [1.0, 2.0])], "node_id bigint, vector array<double>"))
    assert h.embedding(1) == [1.0, 2.0] and h.embedding(2) is None and g.embedding(1) is None
    with pytest.raises(ValueError):
        S.check_dimension(0)
    with pytest.raises(ValueError):
        S.check_rate(1.5)


def test_cypher_plans_hold_no_product(spark, sf):
    from graphlake.plans import catalog

    for name in [n for n in catalog.QUERIES if n.startswith("cy_")]:
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Cartesian" not in plan, name


def test_cypher_tables_and_walks_from_the_middle(spark):
    r = cypher.define(S.Registry(), "CREATE NODE TABLE Person(id INT64, name STRING, score DOUBLE, PRIMARY KEY(id))")
    r = cypher.define(r, "CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    assert [(p.name, p.type, p.required) for p in r.get("Person").properties] == [("id", "integer", True), ("name", "string", False), ("score", "float", False)]
    assert [p.name for p in r.get("KNOWS").properties] == ["since"]
    with pytest.raises(errors.ParseError):
        cypher.define(r, "CREATE NODE TABLE X(id WHAT)")
    g = Graph.from_rows(spark, [(i, "N") for i in range(1, 7)], [(1, 2, "R"), (1, 2, "R"), (2, 3, "R"), (3, 4, "S"), (5, 3, "R")])
    two = cypher.query(g, "MATCH (a)-[x:R]->(b)<-[y:R]-(c) WHERE id(b) = 2 RETURN id(a) AS a, id(c) AS c").collect()
    assert [tuple(r) for r in two] == [(1, 1), (1, 1)]
    middle = cypher.query(g, "MATCH (b)-[:S]->(d) MATCH (a)-[:R]->(b)-[:S]->(e) RETURN id(a) AS a, id(b) AS b, id(e) AS e").collect()
    assert sorted(tuple(r) for r in middle) == [(2, 3, 4), (5, 3, 4)]
    back = cypher.query(g, "MATCH (b)-[:S]->(d) MATCH p = (a)-[:R*1..2]->(b) RETURN id(a) AS a, length(p) AS n").collect()
    assert sorted(tuple(r) for r in back) == [(1, 2), (1, 2), (2, 1), (5, 1)]
    end = cypher.query(g, "MATCH (b)-[:S]->(d) MATCH p = shortestPath((a)-[:R*]->(b)) RETURN id(a) AS a, length(p) AS n").collect()
    assert sorted(tuple(r) for r in end) == [(1, 2), (2, 1), (5, 1)]
    left = g.delete_edges(spark.createDataFrame([(1, 2)], "src bigint, dst bigint"))
    assert left.live_edges.count() == 3
    v = g.add_embeddings(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "node_id bigint, vector array<float>")).add_embeddings(spark.createDataFrame([(2, [3.0])], "node_id bigint, vector array<float>"))
    assert v.embedding(2) == [3.0] and v.embedding(1) == [1.0]


@pytest.mark.parametrize("colour", [4, 7, 1000])
def test_triangles_of_groups(spark, monkeypatch, colour):
    """Against plain Python: ids with equal groups, ids alone, missing values, and several colours."""
    rng = random.Random(colour)
    rows = [(i, rng.randrange(9)) for i in range(26) for _ in range(rng.choice((1, 1, 2)))]
    rows += [(i + 100, g) for i, g in rows if i % 3 == 0] + [(i + 200, g) for i, g in rows if i % 6 == 0] + [(500, 77), (None, 1), (501, None), rows[0]]
    of = defaultdict(set)
    for i, g in rows:
        if i is not None and g is not None:
            of[i].add(g)
    v = sorted(of)
    near = {a: {b for b in v if b > a and of[a] & of[b]} for a in v}
    monkeypatch.setattr(analytics, "COLOUR", colour)
    got = analytics.clique_triangles(spark.createDataFrame(rows, "id bigint, group bigint"))
    assert got.first().triangles == sum(len(near[a] & near[b]) for a in v for b in near[a])
    assert analytics.clique_triangles(spark.createDataFrame([], "id bigint, group bigint")).first().triangles == 0


COUNTED = [
    "MATCH (a:S)-[:IN]->(n:N)<-[:IN]-(b:S) MATCH (p:P)-[:BY]->(b) WHERE NOT (p)-[:BY]->(a) RETURN a.name AS a, count(p) AS n",
    "MATCH (a:S)-[:IN]->(n:N)<-[:IN]-(b:S) MATCH (p:P)-[:BY]->(b) WHERE (p)-[:BY]->(a) AND b.w > 2 RETURN a.name AS a, count(*) AS n, count(p) AS m",
    "MATCH (p:P)-[x:BY]->(a)<-[y:BY]-(q) WHERE p.w < 4 RETURN p.name AS a, q.name AS b, count(y) AS n",
    "MATCH (p)-[x]->(a)-[y]->(q) RETURN p.label AS a, count(y) AS n",
    "MATCH (p)<-[x]-(a:S)<-[y:BY]-(q) WHERE NOT (q)-[:BY]->(:S {w: 1}) RETURN p.name AS a, count(y) AS n",
    "MATCH (p:P)-[x:BY]->(a)<-[y]-(q) MATCH (q)-[:IN]->(m) RETURN m.name AS a, count(x) AS n",
]


@pytest.mark.parametrize("text", COUNTED)
def test_counts_without_listing(spark, monkeypatch, text):
    """The same counts as from all matches, with parallel edges, loops and repeated names; and no plan that lists them."""
    rng = random.Random(5)
    nodes = [(i, "N", f"n{i}", i) for i in range(3)] + [(10 + i, "S", f"s{i // 2}", i) for i in range(8)] + [(30 + i, "P", f"p{i // 2}", i) for i in range(9)]
    edges = [(10 + i, i % 3, "IN") for i in range(8)] + [(rng.randrange(30, 39), rng.randrange(10, 18), "BY") for _ in range(45)]
    edges += [(x, x, "BY") for x in (11, 11, 12, 31)] + [(30, 1, "IN"), (30, 1, "IN"), (99, 10, "BY"), (12, 13, "BY"), (31, 12, "IN")]
    g = Graph.from_rows(spark, nodes, edges, "id bigint, label string, name string, w int")
    calls = []
    real = cypher.Compiler.project
    monkeypatch.setattr(cypher.Compiler, "project", lambda self, *a: calls.append(1) or real(self, *a))
    got = cypher.query(g, text)
    assert not calls
    got = Counter(map(tuple, got.collect()))
    monkeypatch.setattr(cypher, "count_matches", lambda *a: None)
    want = Counter(map(tuple, cypher.query(g, text).collect()))
    assert calls and want and got == want


def test_equal_relationships_are_written_once(spark, monkeypatch):
    """Relationships of one pattern with the same types and properties share one table, also where both are the same one."""
    from graphlake.plans import counting

    nodes = [(1, "S", "s"), (2, "P", "p"), (3, "P", "q")]
    g = Graph.from_rows(spark, nodes, [(2, 1, "BY"), (2, 1, "BY"), (3, 1, "BY"), (3, 1, "IN")], "id bigint, label string, name string")
    calls = []
    real = counting.cut
    monkeypatch.setattr(counting, "cut", lambda df: calls.append(1) or real(df))
    got = cypher.query(g, "MATCH (p:P)-[x:BY]->(a)<-[y:BY]-(q) RETURN p.name AS a, count(y) AS n")
    assert {tuple(r) for r in got.collect()} == {("p", 4), ("q", 2)} and len(calls) == 1
    calls.clear()
    got = cypher.query(g, "MATCH (p:P)-[x:BY]->(a)<-[y]-(q) RETURN p.name AS a, count(y) AS n")
    assert {tuple(r) for r in got.collect()} == {("p", 6), ("q", 3)} and len(calls) == 3


def test_ranges_of_vectors(spark, monkeypatch):
    """Several ranges: every pair and every neighbour as in plain Python, with copies, a zero vector and a missing one; no vector is sent once for each block."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((90, 4)), 1)
    x[5], x[60], x[61] = x[7], 0, x[7]
    rows = [(i + 1, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    monkeypatch.setattr(vector, "RANGE", 20)
    n = np.linalg.norm(x, axis=1)
    c = x @ x.T / np.outer(np.where(n, n, 1), np.where(n, n, 1))
    got = sorted((r.a, r.b) for r in vector.similarity_join(df, 0.8).collect())
    assert got == [(i + 1, j + 1) for i in range(90) for j in range(i + 1, 90) if c[i, j] >= 0.8]
    for queries in (None, df.where("id % 50 = 0")):
        got = sorted((r.id, r["rank"], r.other) for r in vector.knn_join(df, 3, queries=queries).collect())
        want = [(i + 1, k + 1, j + 1) for i in range(90) if queries is None or (i + 1) % 50 == 0 for k, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-round(c[i, j], 12), j))[:3])]
        assert got == want


def test_blocks_are_read_and_not_shuffled(spark, monkeypatch):
    """Blocks meet without an exchange of copies, each written once; rows without id are left out, and double precision decides at the threshold."""
    x = [[1.0, 0.0], [3.0, 4.0], [0.6, 0.8], [4.0, 3.0], [0.6000001, 0.8], [0.5999999, 0.8]] * 3
    rows = [(i, v) for i, v in enumerate(x)] + [(None, [1.0, 0.0])]
    monkeypatch.setattr(vector, "RANGE", 3)
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id bigint, embedding array<{kind}>")
        out = vector.similarity_join(df, 0.6)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        u = [[float(c) for c in r.embedding] for r in df.where("id IS NOT NULL").orderBy("id").collect()]
        u = [[c / (r[0] ** 2 + r[1] ** 2) ** 0.5 for c in r] for r in u]
        c = {(i, j): u[i][0] * u[j][0] + u[i][1] * u[j][1] for i in range(18) for j in range(i + 1, 18)}
        got = {(r.a, r.b) for r in out.collect()}
        assert {p for p in c if c[p] >= 0.6 + 1e-12} <= got <= {p for p in c if c[p] >= 0.6 - 1e-12} and out.count() == len(got) < len(c)
        near = vector.knn_join(df, 2, queries=df.where("id < 4"))
        assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted((r.id, r["rank"]) for r in near.collect()) == [(i, k) for i in range(4) for k in (1, 2)]


def test_tasks_follow_the_input(spark, sf, monkeypatch):
    """The shuffles of bought and supplied edges have as many tasks as the size of the input asks for, whatever the session's number."""
    from graphlake import session
    from graphlake.sources import tables

    monkeypatch.setattr(session, "fan_out", lambda *a, **k: 13)
    for label in ("PURCHASED", "SUPPLIED_BY"):
        assert tables.edges(spark, sf, label).rdd.getNumPartitions() == 13
