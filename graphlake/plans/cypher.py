"""A Cypher subset, compiled to DataFrame operations.

``MATCH`` (several, undirected, alternatives, variable length), ``WHERE`` (comparisons, AND, OR, NOT, NOT pattern), ``WITH`` and
``RETURN`` (DISTINCT, count, properties, type, length, nodes), ``shortestPath``, ``ORDER BY``, ``LIMIT``, ``CREATE`` and the definition of node and relationship tables.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.errors import ParseError
from graphlake.graph import Graph
from graphlake.operators.traversal import bfs_from_each, undirected
from graphlake.plans.counting import count_matches
from graphlake.schema import Property, Registry, Schema
from graphlake.session import cut

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?!\w))|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op>\.\.|<>|<=|>=|[-()\[\]{}:,.|*=<>+/]))""")
_KEYWORDS = {"match", "where", "with", "return", "create", "order", "limit", "and", "or", "not", "as", "distinct", "by", "asc", "desc", "true", "false", "null"}


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None = None
    props: tuple = ()


@dataclass(frozen=True)
class Rel:
    var: str
    types: tuple[str, ...] = ()
    direction: str = "out"
    low: int | None = None
    high: int | None = None
    props: tuple = ()


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[Node, ...]
    rels: tuple[Rel, ...]
    path: str | None = None
    shortest: bool = False


@dataclass
class Query:
    parts: list = field(default_factory=list)
    create: list = field(default_factory=list)
    items: list = field(default_factory=list)
    distinct: bool = False
    order: list = field(default_factory=list)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.toks, at, text = [], 0, text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"at {text[at:at + 20]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.i, self.fresh = 0, itertools.count()

    def peek(self, k: int = 0) -> str:
        if self.i + k >= len(self.toks):
            return ""
        kind, t = self.toks[self.i + k]
        return t.lower() if kind == "name" and t.lower() in _KEYWORDS else t

    def take(self, *want: str) -> str:
        t = self.peek()
        if want and t not in want:
            raise ParseError(f"expected {' or '.join(want)}, found {t or 'the end'}")
        if not t:
            raise ParseError("unexpected end")
        self.i += 1
        return t

    def maybe(self, *want: str) -> bool:
        if self.peek() in want:
            self.i += 1
            return True
        return False

    def name(self) -> str:
        kind, t = self.toks[self.i] if self.i < len(self.toks) else ("", "")
        if kind != "name":
            raise ParseError(f"expected a name, found {t or 'the end'}")
        self.i += 1
        return t.strip("`")

    def query(self) -> Query:
        q = Query()
        while self.peek() in ("match", "with", "create"):
            word = self.take()
            if word == "match":
                patterns = [self.pattern()]
                while self.maybe(","):
                    patterns.append(self.pattern())
                q.parts.append(("match", patterns, self.expr() if self.maybe("where") else None))
            elif word == "with":
                items, distinct = self.projection()
                q.parts.append(("with", items, distinct, self.expr() if self.maybe("where") else None))
            else:
                q.create.append(self.pattern())
                while self.maybe(","):
                    q.create.append(self.pattern())
        if self.maybe("return"):
            q.items, q.distinct = self.projection()
            if self.maybe("order"):
                self.take("by")
                while True:
                    e = self.additive()
                    q.order.append((e, self.take() == "desc" if self.peek() in ("asc", "desc") else False))
                    if not self.maybe(","):
                        break
            if self.maybe("limit"):
                q.limit = int(self.take())
        if self.peek():
            raise ParseError(f"unexpected {self.peek()}")
        if not (q.items or q.create):
            raise ParseError("a query needs RETURN or CREATE")
        return q

    def projection(self) -> tuple[list, bool]:
        distinct, items = self.maybe("distinct"), []
        while True:
            start = self.i
            e = self.expr()
            text = "".join(t if t != "," else ", " for _, t in self.toks[start : self.i])
            items.append((e, self.name() if self.maybe("as") else text))
            if not self.maybe(","):
                return items, distinct

    def pattern(self) -> Pattern:
        path = None
        if self.peek(1) == "=" and self.toks[self.i][0] == "name":
            path = self.name()
            self.take("=")
        if self.peek().lower() == "shortestpath":
            self.i += 1
            self.take("(")
            p = self.pattern()
            self.take(")")
            return replace(p, path=path or p.path, shortest=True)
        nodes, rels = [self.node()], []
        while self.peek() in ("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Pattern(tuple(nodes), tuple(rels), path)

    def node(self) -> Node:
        self.take("(")
        var = self.name() if self.peek() not in (":", ")", "{") else f"_n{next(self.fresh)}"
        label = self.name() if self.maybe(":") else None
        props = self.props()
        self.take(")")
        return Node(var, label, props)

    def props(self) -> tuple:
        out = []
        if self.maybe("{"):
            while not self.maybe("}"):
                k = self.name()
                self.take(":")
                out.append((k, self.additive()))
                self.maybe(",")
        return tuple(out)

    def rel(self) -> Rel:
        back = self.maybe("<")
        self.take("-")
        var, types, low, high, props = f"_r{next(self.fresh)}", [], None, None, ()
        if self.maybe("["):
            if self.peek() not in (":", "*", "]", "{"):
                var = self.name()
            if self.maybe(":"):
                types.append(self.name())
                while self.maybe("|"):
                    self.maybe(":")
                    types.append(self.name())
            if self.maybe("*"):
                low = 1
                if self.peek().isdigit():
                    low = high = int(self.take())
                if self.maybe(".."):
                    high = int(self.take()) if self.peek().isdigit() else None
            props = self.props()
            self.take("]")
        self.take("-")
        on = self.maybe(">")
        if back and on:
            raise ParseError("a relationship has one direction")
        return Rel(var, tuple(types), "in" if back else "out" if on else "both", low, high, props)

    def expr(self):
        e = self.conjunction()
        while self.maybe("or"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.maybe("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self):
        if self.maybe("not"):
            return ("not", self.negation())
        return self.comparison()

    def comparison(self):
        if self.peek() == "(":
            start = self.i
            try:
                p = self.pattern()
                if p.rels:
                    return ("pattern", p)
            except ParseError:
                pass
            self.i = start
            self.take("(")
            e = self.expr()
            self.take(")")
            return e
        e = self.additive()
        if self.peek() in ("=", "<>", "<", "<=", ">", ">="):
            return ("cmp", self.take(), e, self.additive())
        return e

    def additive(self):
        e = self.atom()
        while self.peek() in ("+", "/", "*") or (self.peek() == "-" and self.peek(1) not in ("[", "-", ">")):
            e = ("arith", self.take(), e, self.atom())
        return e

    def atom(self):
        kind, t = self.toks[self.i] if self.i < len(self.toks) else ("", "")
        if kind == "num":
            self.i += 1
            return ("lit", float(t) if "." in t else int(t))
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if t == "-":
            self.i += 1
            return ("arith", "-", ("lit", 0), self.atom())
        if self.peek() in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[self.take()])
        var = self.name()
        if self.peek() == "(":
            self.take("(")
            if self.maybe("*"):
                arg, distinct = None, False
            else:
                distinct = self.maybe("distinct")
                arg = self.expr()
            self.take(")")
            return ("call", var.lower(), arg, distinct)
        if self.maybe("."):
            return ("prop", var, self.name())
        return ("var", var)


_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


def _aggregates(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "call" and e[1] in _AGGREGATES or any(_aggregates(x) for x in e[1:]))


class Compiler:
    """Rows bind variables to structs: ``(id, label, ...)`` for nodes, ``(edge_id, src, dst, label, ...)`` for relationships. No relationship is used twice in one match."""

    def __init__(self, graph: Graph):
        self.g = graph
        self.edges = graph.live_edges
        self.own_ids = "edge_id" not in self.edges.columns
        if self.own_ids:
            self.edges = self.edges.withColumn("edge_id", F.xxhash64(*self.edges.columns))
        self.nodes = graph.live_nodes
        self.tags = itertools.count()

    def run(self, q: Query) -> DataFrame:
        rows: DataFrame | None = None
        self.kinds: dict[str, str] = {}
        counted = count_matches(self, q)
        for part in q.parts if counted is None else []:
            if part[0] == "match":
                for p in part[1]:
                    rows = self.match(rows, p)
                if part[2] is not None:
                    rows = self.where(rows, part[2])
            else:
                rows = self.project(rows, part[1], part[2])
                if part[3] is not None:
                    rows = self.where(rows, part[3])
        if rows is None and counted is None:
            raise ParseError("RETURN without MATCH")
        order = [(e, d) for e, d in q.order]
        names = [n for _, n in q.items]
        if order and not any(_aggregates(e) for e, _ in q.items) and not q.distinct:
            keys = [self._order_key(e, q.items, rows) for e, _ in order]
            rows = rows.orderBy(*[k.desc() if d else k.asc() for k, (_, d) in zip(keys, order, strict=True)])
            out = self.project(rows.limit(q.limit) if q.limit is not None else rows, q.items, False)
            return out.select(*[F.col(f"`{n}`") for n in names])
        out = self.project(rows, q.items, q.distinct) if counted is None else counted
        if order:
            texts = {self._text(e): n for e, n in q.items} | {n: n for n in names}
            keys = [F.col(f"`{texts[self._text(e)]}`") for e, _ in order]
            out = out.orderBy(*[k.desc() if d else k.asc() for k, (_, d) in zip(keys, order, strict=True)])
        return out.limit(q.limit) if q.limit is not None else out

    @staticmethod
    def _text(e) -> str:
        return e[1] if e[0] == "var" else f"{e[1]}.{e[2]}" if e[0] == "prop" else repr(e)

    def _order_key(self, e, items, rows) -> Column:
        for x, n in items:
            if e == ("var", n):
                return self.value(x)
        return self.value(e)

    def _node(self, n: Node, alias: str) -> DataFrame:
        df = self.nodes
        if n.label:
            df = df.where(F.col("label") == n.label)
        for k, v in n.props:
            df = df.where(F.col(k) == self.value(v))
        return df.select(F.struct(*df.columns).alias(alias))

    def _rels(self, r: Rel, alias: str, apart: bool = False) -> DataFrame:
        """``(_from, _to, alias)`` in the direction of the pattern. With ``apart`` equal rows have ids of their own."""
        e = self.edges
        if r.types:
            e = e.where(F.col("label").isin(*r.types))
        if apart and self.own_ids and not self.g.simple:
            names = e.drop("edge_id").columns
            e = e.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
            e = e.select(*names, F.xxhash64(*names, "_nth").alias("edge_id"))
        for k, v in r.props:
            e = e.where(F.col(k) == self.value(v))
        s = F.struct(*e.columns).alias(alias)
        out, back = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), s), e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), s)
        return out if r.direction == "out" else back if r.direction == "in" else out.unionByName(back.where("_from <> _to"))

    def match(self, rows: DataFrame | None, p: Pattern) -> DataFrame:
        if p.shortest:
            return self.shortest(rows, p)
        bound = [i for i, n in enumerate(p.nodes) if rows is not None and n.var in rows.columns]
        start = bound[0] if bound else 0  # a walk begins at a variable that has a value, so that nothing is crossed with all nodes
        rows = self._bind(rows, p.nodes[start])
        apart = len(p.rels) > 1 or any(r.low is not None for r in p.rels)
        used: dict[int, Column] = {}
        for k in range(start, len(p.rels)):
            rows = self._step(rows, p.rels[k], p.nodes[k], p.nodes[k + 1], used, k, apart)
        for k in range(start - 1, -1, -1):
            back = replace(p.rels[k], direction={"in": "out", "out": "in"}.get(p.rels[k].direction, "both"))
            rows = self._step(rows, back, p.nodes[k + 1], p.nodes[k], used, k, apart)
            if back.low is not None:
                rows = rows.withColumn(back.var, F.reverse(F.col(f"`{back.var}`")))
        if p.path:
            rows = rows.withColumn(p.path, F.concat(*[used[k] for k in sorted(used)]) if used else F.array().cast("array<bigint>"))
            self.kinds[p.path] = "path"
        return rows

    def _step(self, rows: DataFrame, r: Rel, here: Node, nxt: Node, used: dict[int, Column], k: int, apart: bool) -> DataFrame:
        """One relationship further, from a node that has a value to the next."""
        at = F.col(f"`{here.var}`.id")
        if r.low is None:
            rows = rows.join(self._rels(r, r.var, apart), at == F.col("_from")).drop("_from")
            for u in used.values():
                rows = rows.where(~F.array_contains(u, F.col(f"`{r.var}`.edge_id")))
            used[k] = F.array(F.col(f"`{r.var}`.edge_id"))
            self.kinds[r.var] = "rel"
        else:
            rows = self._var_length(rows, r, at, list(used.values()))
            used[k] = F.col(f"`{r.var}`")
            self.kinds[r.var] = "path"
        to = F.col("_to")
        if nxt.var in rows.columns:
            rows = self._filtered(rows.where(F.col(f"`{nxt.var}`.id") == to).drop("_to"), nxt)
        else:
            rows = rows.join(self._node(nxt, nxt.var), to == F.col(f"`{nxt.var}`.id")).drop("_to")
        self.kinds[nxt.var] = "node"
        return rows

    def _filtered(self, rows: DataFrame, n: Node) -> DataFrame:
        if n.label:
            rows = rows.where(F.col(f"`{n.var}`.label") == n.label)
        for k, v in n.props:
            rows = rows.where(F.col(f"`{n.var}`.`{k}`") == self.value(v))
        return rows

    def _bind(self, rows: DataFrame | None, n: Node) -> DataFrame:
        if rows is not None and n.var in rows.columns:
            return self._filtered(rows, n)
        self.kinds[n.var] = "node"
        own = self._node(n, n.var)
        return own if rows is None else rows.crossJoin(own)

    def _var_length(self, rows: DataFrame, r: Rel, here: Column, used: list[Column]) -> DataFrame:
        """One join a step; the edges of the path so far are an array column, and none comes twice. Without an upper bound, steps go on until no path is left to extend."""
        cur = rows.withColumn(r.var, F.array().cast("array<bigint>")).withColumn("_to", here)
        found = [cur] if r.low == 0 else []
        step = self._rels(r, "_e", True).select(F.col("_from"), F.col("_to").alias("_next"), F.col("_e.edge_id").alias("_id"))
        for k in itertools.count(1) if r.high is None else range(1, r.high + 1):
            nxt = cur.join(step, F.col("_to") == F.col("_from")).where(~F.array_contains(F.col(f"`{r.var}`"), F.col("_id")))
            for u in used:
                nxt = nxt.where(~F.array_contains(u, F.col("_id")))
            cur = nxt.withColumn(r.var, F.array_append(F.col(f"`{r.var}`"), F.col("_id"))).withColumn("_to", F.col("_next")).drop("_from", "_next", "_id")
            if r.high is None:
                cur = cut(cur)
            if k >= r.low:
                found.append(cur)
            if r.high is None and k >= r.low and cur.isEmpty():
                break
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def shortest(self, rows: DataFrame | None, p: Pattern) -> DataFrame:
        """Least distances from all matching starts at once; the length is bound to the path's name."""
        a, b, r = p.nodes[0], p.nodes[-1], p.rels[0]
        if rows is not None and a.var not in rows.columns and b.var in rows.columns:  # begin at the end that has a value
            a, b, r = b, a, replace(r, direction={"in": "out", "out": "in"}.get(r.direction, "both"))
        rows = self._bind(rows, a)
        e = self.edges.where(F.col("label").isin(*r.types)) if r.types else self.edges
        e = e.select("src", "dst")
        if r.direction == "in":
            e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        elif r.direction == "both":
            e = undirected(e)
        name = p.path or f"_p{len(self.kinds)}"
        starts = rows.select(F.col(f"`{a.var}`.id").alias("id")).distinct()
        d = bfs_from_each(e, starts, r.high).select(F.col("start").alias("_start"), F.col("id").alias("_end"), F.col("distance").cast("long").alias(name))
        d = d.where(F.col(name) >= (r.low if r.low is not None else 1))
        self.kinds[name] = "length"
        self.kinds[b.var] = "node"
        on = F.col(f"`{a.var}`.id") == F.col("_start")
        if b.var in rows.columns:
            return self._filtered(rows.join(d, on & (F.col(f"`{b.var}`.id") == F.col("_end"))), b).drop("_start", "_end")
        return rows.join(d, on).join(self._node(b, b.var), F.col("_end") == F.col(f"`{b.var}`.id")).drop("_start", "_end")

    def where(self, rows: DataFrame, e) -> DataFrame:
        if e[0] == "and":
            return self.where(self.where(rows, e[1]), e[2])
        if e[0] == "pattern" or e[0] == "not" and e[1][0] == "pattern":
            hit, cond = self._ends(rows, e[1] if e[0] == "pattern" else e[1][1])
            return rows.join(hit, cond, "left_semi" if e[0] == "pattern" else "left_anti")
        columns = rows.columns
        rows, e = self._flags(rows, e)
        return rows.where(self.value(e)).select(*[F.col(f"`{c}`") for c in columns])

    def _ends(self, rows: DataFrame, p: Pattern) -> tuple[DataFrame, Column]:
        """The bound ends, once each, of all matches of a pattern in WHERE, and the condition that joins them to ``rows``."""
        tag = f"_k{next(self.tags)}_"
        hit = self.ends(p, rows.columns, tag)
        cond = None
        for i, n in enumerate(p.nodes):
            if n.var in rows.columns:
                c = F.col(f"`{n.var}`.id") == F.col(f"{tag}{i}")
                cond = c if cond is None else cond & c
        return hit, cond

    def ends(self, p: Pattern, bound, tag: str) -> DataFrame:
        """The ids of the nodes named in ``bound`` in all matches of a pattern, once each, in its order."""
        if not any(n.var in bound for n in p.nodes):
            raise ParseError("a pattern in WHERE needs a bound variable")
        sub = Compiler(self.g)
        sub.kinds = {}
        fresh = tuple(replace(n, var=f"_s{i}") for i, n in enumerate(p.nodes))
        hit = sub.match(None, replace(p, nodes=fresh))
        return hit.select(*[F.col(f"`_s{i}`.id").alias(f"{tag}{i}") for i, n in enumerate(p.nodes) if n.var in bound]).distinct()

    def _flags(self, rows: DataFrame, e) -> tuple[DataFrame, tuple]:
        """Patterns within a larger expression become columns that say whether they match."""
        if not isinstance(e, tuple):
            return rows, e
        if e[0] == "pattern":
            hit, cond = self._ends(rows, e[1])
            flag = f"_hit{next(self.tags)}"
            keys = hit.columns
            rows = rows.join(hit.withColumn(flag, F.lit(True)), cond, "left").drop(*keys).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
            return rows, ("var", flag)
        out = []
        for x in e:
            rows, x = self._flags(rows, x)
            out.append(x)
        return rows, tuple(out)

    def project(self, rows: DataFrame, items: list, distinct: bool) -> DataFrame:
        if any(_aggregates(e) for e, _ in items):
            keys = [self.value(e).alias(n) for e, n in items if not _aggregates(e)]
            aggs = [self.value(e).alias(n) for e, n in items if _aggregates(e)]
            out = (rows.groupBy(*keys) if keys else rows).agg(*aggs).select(*[F.col(f"`{n}`") for _, n in items])
        else:
            out = rows.select(*[self.value(e).alias(n) for e, n in items])
        kinds = {n: self.kinds.get(e[1], "value") if e[0] == "var" else "value" for e, n in items}
        self.kinds = kinds
        return out.distinct() if distinct else out

    def value(self, e) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "var":
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            return F.col(f"`{e[1]}`.`{e[2]}`")
        if kind in ("and", "or"):
            a, b = self.value(e[1]), self.value(e[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.value(e[1])
        if kind == "cmp":
            a, b = self.value(e[2]), self.value(e[3])
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
        if kind == "arith":
            a, b = self.value(e[2]), self.value(e[3])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[e[1]]()
        if kind == "call":
            name, arg, distinct = e[1], e[2], e[3]
            if name == "type":
                return F.col(f"`{arg[1]}`.label")
            if name == "id":
                return F.col(f"`{arg[1]}`.id")
            if name == "length":
                return F.col(f"`{arg[1]}`") if self.kinds.get(arg[1]) == "length" else F.size(F.col(f"`{arg[1]}`")).cast("long")
            if name == "count":
                if arg is None:
                    return F.count(F.lit(1))
                return F.count_distinct(self.value(arg)) if distinct else F.count(self.value(arg))
            fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list, "tolower": F.lower, "toupper": F.upper, "abs": F.abs}.get(name)
            if fn:
                return fn(self.value(arg))
        raise ParseError(f"cannot evaluate {e}")


def query(graph: Graph, text: str) -> DataFrame:
    """The rows of a Cypher query over ``graph``. Properties are columns of its frames."""
    q = Parser(text).query()
    if not q.items:
        raise ParseError("use create() for CREATE")
    return Compiler(graph).run(q)


def create(graph: Graph, text: str) -> Graph:
    """The graph with what a CREATE query makes: nodes with a property ``id`` (or new ids after the greatest one) and relationships between them and matched nodes."""
    q = Parser(text).query()
    spark = graph.nodes.sparkSession
    new_nodes, new_edges, known = [], [], {}
    if q.parts:
        items = [(("var", n.var), n.var) for part in q.parts for p in part[1] for n in p.nodes]
        rows = Compiler(graph).run(Query(parts=q.parts, items=list(dict.fromkeys(items)))).collect()
    else:
        rows = [None]
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    for row in rows:
        known = {k: row[k].id for k in row.asDict()} if row is not None else {}
        for p in q.create:
            for n in p.nodes:
                if n.var not in known:
                    values = {k: v[1] for k, v in n.props}
                    top = top if "id" in values else top + 1
                    known[n.var] = values.setdefault("id", top)
                    new_nodes.append(values | {"label": n.label})
            for i, r in enumerate(p.rels):
                a, b = known[p.nodes[i].var], known[p.nodes[i + 1].var]
                a, b = (b, a) if r.direction == "in" else (a, b)
                new_edges.append({k: v[1] for k, v in r.props} | {"src": a, "dst": b, "label": r.types[0] if r.types else None})
    nodes, edges = graph.nodes, graph.edges
    if new_nodes:
        nodes = nodes.unionByName(_rows(spark, new_nodes, nodes), allowMissingColumns=True)
    if new_edges:
        edges = edges.unionByName(_rows(spark, new_edges, edges), allowMissingColumns=True)
    return replace(graph, nodes=nodes, edges=edges)


def _rows(spark, rows: list[dict], like: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for n in names:
        some = next((r[n] for r in rows if r.get(n) is not None), "")
        fields.append(T.StructField(n, like.schema[n].dataType if n in like.columns else kinds[type(some)]))
    values = [tuple(float(r[f.name]) if isinstance(f.dataType, T.DoubleType) and r.get(f.name) is not None else r.get(f.name) for f in fields) for r in rows]
    return spark.createDataFrame(values, T.StructType(fields))


_TABLE = re.compile(r"\s*CREATE\s+(NODE|REL)\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_KINDS = {"int64": "integer", "int32": "integer", "int": "integer", "serial": "integer", "double": "float", "float": "float", "string": "string", "bool": "boolean", "boolean": "boolean"}


def define(registry: Registry, text: str) -> Registry:
    """``registry`` with the table of a ``CREATE NODE TABLE name(prop TYPE, ..., PRIMARY KEY (prop))`` or ``CREATE REL TABLE name(FROM a TO b, prop TYPE, ...)``. A primary key is required and indexed."""
    m = _TABLE.match(text)
    if not m:
        raise ParseError("expected CREATE NODE TABLE or CREATE REL TABLE")
    keys = {k.strip() for k in re.findall(r"PRIMARY\s+KEY\s*\(([^)]*)\)", m[3], re.I)}
    properties = []
    for part in re.sub(r",?\s*PRIMARY\s+KEY\s*\([^)]*\)", "", m[3], flags=re.I).split(","):
        words = part.split()
        if not words or words[0].lower() == "from" and m[1].lower() == "rel":
            continue
        kind = words[1].lower() if len(words) > 1 else ""
        vector = re.fullmatch(r"(float|double)\[\d*\]", kind)
        if not vector and kind not in _KINDS:
            raise ParseError(f"unknown type {part.strip()!r}")
        properties.append(Property(words[0], "vector" if vector else _KINDS[kind], required=words[0] in keys, indexed=words[0] in keys))
    if keys - {p.name for p in properties}:
        raise ParseError("a primary key is one of the properties")
    return registry.register(Schema(m[2], tuple(properties)))
