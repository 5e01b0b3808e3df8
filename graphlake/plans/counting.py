"""Counting matches of a pattern without listing them: variables are summed out one after another, as in a join tree.

A query that returns only counts beside expressions of a few variables is a sum of products. Each relationship and node
is a factor, a bag of rows over one or two variables with a number ``_m``; a variable that is not returned is removed by joining
the factors that hold it and adding up. What a match excludes is subtracted: the same relationship twice in one pattern, and NOT pattern.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.session import cut


@dataclass
class Factor:
    """``rows`` with one column of ids for each of ``on`` (a tuple of variables) and ``_m``, how often they count."""

    on: tuple[str, ...]
    rows: DataFrame

    def renamed(self, names: dict[str, str]) -> Factor:
        """Over other variables; two that become one must be equal."""
        first: dict[str, str] = {}
        rows = self.rows
        for v in self.on:
            if first.setdefault(names.get(v, v), v) != v:
                rows = rows.where(F.col(v) == F.col(first[names.get(v, v)]))
        return Factor(tuple(first), rows.select(*[F.col(v).alias(to) for to, v in first.items()], "_m"))


def _joined(a: Factor, b: Factor) -> Factor:
    common = [v for v in a.on if v in b.on]
    right = b.rows.withColumnRenamed("_m", "_by")
    rows = a.rows.join(right, common) if common else a.rows.crossJoin(right)
    on = a.on + tuple(v for v in b.on if v not in a.on)
    return Factor(on, rows.select(*on, (F.col("_m") * F.col("_by")).alias("_m")))


def _meeting(a: Factor, b: Factor) -> float:
    """The rows of the join of two factors."""
    common = [v for v in a.on if v in b.on]
    if not common:
        return float("inf")
    each = [Factor(tuple(common), f.rows.groupBy(*common).agg(F.count("*").cast("double").alias("_m"))) for f in (a, b)]
    return _joined(*each).rows.agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("n")).first().n


def _ordered(wide: list[Factor]) -> tuple[float, list[Factor]]:
    """The factors, the two first whose join has the fewest rows, and how many these are."""
    pairs = [(_meeting(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(wide), 2)]
    cost, i, j = min(pairs) if pairs else (0.0, 0, 0)
    return cost, [wide[x] for x in dict.fromkeys((i, j))] + [f for x, f in enumerate(wide) if x not in (i, j)]


def _product(factors: list[Factor]) -> Factor:
    """Joined on their common variables, wide ones in the order given; those over one variable as soon as it is there."""
    wide, narrow = [f for f in factors if len(f.on) > 1], [f for f in factors if len(f.on) < 2]
    out = wide.pop(0) if wide else narrow.pop(0)
    while True:
        for f in [f for f in narrow if set(f.on) <= set(out.on)]:
            narrow.remove(f)
            out = _joined(out, f)
        if not wide and not narrow:
            return out
        nxt = next((f for f in wide if set(f.on) & set(out.on)), (wide + narrow)[0])
        (wide if nxt in wide else narrow).remove(nxt)
        out = _joined(out, nxt)


def _summed(f: Factor, on: tuple[str, ...]) -> Factor:
    return Factor(on, f.rows.groupBy(*on).agg(F.coalesce(F.sum("_m"), F.lit(0).cast("long")).alias("_m")))


def eliminate(factors: list[Factor], keep: tuple[str, ...]) -> Factor:
    """The product of ``factors``, summed over all variables but ``keep``.

    A variable with at most one other beside it goes first, as what is left is then no larger than that one; of the rest, the one whose
    product begins with the smallest join. Wide factors between the variables beside it join that product, so that cycles stay small.
    """
    factors = list(factors)
    while rest := sorted({v for f in factors for v in f.on} - set(keep)):
        beside = {v: set().union(*[f.on for f in factors if v in f.on]) - {v} for v in rest}
        wide = {v: [f for f in factors if len(f.on) > 1 and set(f.on) <= beside[v] | {v}] for v in rest}
        easy = [v for v in rest if len(beside[v]) < 2]
        if easy:
            v = min(easy)
        else:
            if len(rest) > 1 or len(wide[rest[0]]) > 2:
                ranked = {v: _ordered(wide[v]) for v in rest}
                v = min(rest, key=lambda x: (ranked[x][0], x))
                wide[v] = ranked[v][1]
            else:
                v = rest[0]
        some = [f for f in factors if f.on == (v,)] + wide[v]
        done = _summed(_product(some), tuple(sorted(beside[v])))
        if not easy and len(rest) > 1:
            done = Factor(done.on, cut(done.rows))
        factors = [f for f in factors if not any(f is x for x in some)] + [done]
    return _summed(_product(factors), keep)


def count_matches(compiler, q) -> DataFrame | None:
    """The keys and counts that ``q`` returns, in its order of columns and without ORDER BY and LIMIT; None if it is of another form (see :func:`_plan`)."""
    spec = _plan(compiler, q)
    if spec is None:
        return None
    nodes, terms = spec
    total = None
    for sign, factors, names in terms:
        f = eliminate(factors, tuple(dict.fromkeys(names.get(v, v) for v in nodes))).rows
        f = f.select(*[F.col(names.get(v, v)).alias(f"_id_{v}") for v in nodes], (F.col("_m") * sign).alias("_m"))
        total = f if total is None else total.unionByName(f)
    rows = total.groupBy(*[f"_id_{v}" for v in nodes]).agg(F.sum("_m").alias("_m")).where("_m > 0")
    for v, n in nodes.items():
        rows = rows.join(n, F.col(f"_id_{v}") == F.col(f"`{v}`.id")).drop(f"_id_{v}")
    counts = {n for e, n in q.items if e[:2] == ("call", "count")}
    out = rows.groupBy(*[compiler.value(e).alias(n) for e, n in q.items if n not in counts]).agg(F.coalesce(F.sum("_m"), F.lit(0).cast("long")).alias("_m"))
    return out.select(*[F.col("_m").alias(n) if n in counts else F.col(f"`{n}`") for _, n in q.items])


def _plan(compiler, q):
    """``(rows of the variables in keys, signed terms)`` for a query of plain MATCHes that returns keys and counts, else None.

    Not for variable length, paths, undirected relationships, more than two of them in a pattern, keys or conditions over relationships, WITH,
    and conditions over several variables.
    """
    if not q.parts or any(p[0] != "match" for p in q.parts) or q.distinct or not compiler.own_ids:
        return None
    patterns = [p for part in q.parts for p in part[1]]
    nodes: dict[str, list] = {}
    rels: list[str] = []
    for p in patterns:
        if p.shortest or p.path or not p.rels or len(p.rels) > 2 or any(r.low is not None or r.direction == "both" for r in p.rels):
            return None
        rels += [r.var for r in p.rels]
        for n in p.nodes:
            nodes.setdefault(n.var, []).append(n)
    if len(set(rels)) < len(rels) or set(rels) & set(nodes):
        return None
    from graphlake.plans.cypher import _aggregates

    counts = [e for e, _ in q.items if _aggregates(e)]
    keys = [e for e, _ in q.items if not _aggregates(e)]
    known = set(rels) | set(nodes)
    if not counts or any(e[0] != "call" or e[1] != "count" or e[3] or e[2] is not None and (e[2][0] != "var" or e[2][1] not in known) for e in counts):
        return None
    used = set().union(*[_names(e) for e in keys]) if keys else set()
    if not keys or not used <= set(nodes):
        return None
    where: dict[str, list] = {}
    hits, bound = [], {}
    for at, part in enumerate(q.parts):
        for p in part[1]:
            bound |= {n.var: None for n in p.nodes}
        for c in _conjuncts(part[2]):
            no = c[0] == "not" and c[1][0] == "pattern"
            if c[0] == "pattern" or no:
                hits.append((no, c[1][1] if no else c[1], tuple(bound)))
                continue
            names = _names(c)
            if _patterns(c) or len(names) != 1 or not names <= set(bound):
                return None
            where.setdefault(next(iter(names)), []).append(c)
    if any(r.var in known for _, p, _ in hits for r in p.rels):
        return None

    if 2 ** (len(hits) + sum(len(p.rels) == 2 for p in patterns)) > 16:
        return None
    base, kept = [], {}
    for v, mentions in nodes.items():
        rows = compiler._node(mentions[0], v)
        for n in mentions[1:]:
            rows = compiler._filtered(rows, n)
        for c in where.get(v, []):
            rows = rows.where(compiler.value(c))
        ids = rows.select(F.col(f"`{v}`.id").alias(v)).groupBy(v).agg(F.count("*").alias("_m"))
        if v in used:  # its rows are joined at the end
            kept[v], ids = rows, ids.withColumn("_m", F.lit(1).cast("long"))
        base.append(Factor((v,), ids))
    tables: dict = {}

    def edges(a: str, b: str, *both) -> Factor:
        """The relationships that fit all of ``both``, from ``a`` to ``b`` as the first one points."""
        e = compiler.edges
        key = frozenset((tuple(r.types), tuple(r.props)) for r in both)
        if key not in tables:
            for types, props in key:
                if types:
                    e = e.where(F.col("label").isin(*types))
                for k, x in props:
                    e = e.where(F.col(k) == compiler.value(x))
            tables[key] = cut(e.select("src", "dst"))
        s, t = (a, b) if both[0].direction == "out" else (b, a)
        return Factor((s, t), tables[key].select(F.col("src").alias(s), F.col("dst").alias(t), F.lit(1).cast("long").alias("_m")))

    choices = []  # for each pattern its ways: sign, factors, names that become one
    for p in patterns:
        n = [x.var for x in p.nodes]
        ways = [(1, [_edge(edges, n[i], n[i + 1], r) for i, r in enumerate(p.rels)], [])]
        if len(p.rels) == 2:
            turned = p.rels[0].direction != p.rels[1].direction
            ways.append((-1, [_edge(edges, n[0], n[1], *p.rels)], [(n[2], n[0])] if turned else [(n[2], n[0]), (n[1], n[0])]))
        choices.append(ways)
    for no, p, vars_ in hits:
        f = _hit(compiler, p, vars_)
        if f is None:
            return None
        choices.append([(1, [], []), (-1, [f], [])] if no else [(1, [f], [])])
    terms = []
    for ways in itertools.product(*choices):
        sign, factors, same = 1, list(base), []
        for s, fs, pairs in ways:
            sign, factors, same = sign * s, factors + fs, same + pairs
        names = _merged(same)
        terms.append((sign, [f.renamed(names) for f in factors], names))
    return kept, terms


def _edge(edges, a: str, b: str, *both) -> Factor:
    if a != b:
        return edges(a, b, *both)
    return edges(a, "_other", *both).renamed({"_other": a})


def _hit(compiler, p, vars_: tuple[str, ...]) -> Factor | None:
    ends = [n.var for n in p.nodes if n.var in vars_]
    if not ends or len(set(ends)) < len(ends):
        return None
    rows = compiler.ends(p, vars_, "_k_")
    return Factor(tuple(ends), cut(rows.toDF(*ends).withColumn("_m", F.lit(1).cast("long"))))


def _merged(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """For each variable the one that stands for it and all its equals."""
    of: dict[str, str] = {}

    def top(v):
        while of.get(v, v) != v:
            v = of[v]
        return v

    for a, b in pairs:
        if top(a) != top(b):
            of[top(a)] = top(b)
    return {v: top(v) for v in of}


def _conjuncts(e) -> list:
    return [] if e is None else _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _patterns(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "pattern" or any(_patterns(x) for x in e[1:]))


def _names(e) -> set[str]:
    """The variables of an expression."""
    if not isinstance(e, tuple):
        return set()
    if e[0] in ("var", "prop"):
        return {e[1]}
    if e[0] == "lit":
        return set()
    return set().union(*[_names(x) for x in e[1:]])
