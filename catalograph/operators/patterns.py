"""Graph-pattern operators over a quad table.

A pattern term is a variable (`"?name"`), or a constant: a full IRI, `prefix:local`, a bare vocabulary name in
predicate position, or `literal("text")`. Solutions are rows with one string column per variable, plus `store`:
patterns never match across stores.

A predicate constant is a filter on `p`, so on a stored table it prunes partitions. Joins are left to Catalyst
(broadcast or sort-merge by size, AQE splitting skewed keys); `bgp` only puts the most bound pattern first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import instant
from catalograph.session import cut_lineage


@dataclass(frozen=True)
class literal:
    """A literal object constant; without it a constant object is an IRI."""
    value: str


def resolve(name: str, prefixes: dict[str, str] = N.PREFIXES, default: str = N.DEFAULT_PREFIX) -> str:
    """A name to its full IRI: full IRIs as they are, `prefix:local` by the map, bare names by the default."""
    if name.startswith(("http://", "https://", "urn:")):
        return name
    short, colon, local = name.partition(":")
    if not colon:
        short, local = default, name
    if short not in prefixes:
        raise ValueError(f"unknown prefix {short!r}")
    return prefixes[short] + local


def resolve_names(df: DataFrame, col: str, prefixes: dict[str, str] = N.PREFIXES, out: str = "iri",
                  default: str = N.DEFAULT_PREFIX) -> DataFrame:
    """`resolve` over a column of names; an unknown prefix fails the job. Prefixes are configuration: a literal map."""
    name = F.col(col)
    short = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise(default)
    local = F.when(name.contains(":"), F.substr(name, F.instr(name, ":") + 1)).otherwise(name)
    ns = F.try_element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), short)
    return df.withColumn(out, F.when(name.rlike("^(https?://|urn:)"), name).when(ns.isNotNull(), F.concat(ns, local))
                         .otherwise(F.raise_error(F.concat(F.lit("unknown prefix in "), name))))


def is_var(t) -> bool:
    return isinstance(t, str) and t.startswith("?")


def pattern(q: DataFrame, s, p, o, g: str | None = None, kinds: bool = False) -> DataFrame:
    """One triple pattern. With `kinds`, an object variable also yields `<var>__kind` (term kind and datatype)."""
    cond: list[Column] = []
    for col, t in (("s", s), ("p", p)):
        if not is_var(t):
            cond.append(F.col(col) == resolve(t))
    if isinstance(o, literal):
        cond += [F.col("o_kind") == "literal", F.col("o") == o.value]
    elif not is_var(o):
        cond += [F.col("o_kind") != "literal", F.col("o") == resolve(o)]
    if g is not None and not is_var(g):
        cond.append(F.col("g") == g)
    out: dict[str, Column] = {}
    for col, t in (("s", s), ("p", p), ("o", o), ("g", g)):
        if is_var(t):
            if t[1:] in out:
                cond.append(F.col(col) == out[t[1:]])
                if col == "o":
                    cond.append(F.col("o_kind") != "literal")
            else:
                out[t[1:]] = F.col(col)
    df = q.filter(reduce(lambda a, b: a & b, cond)) if cond else q
    cols = [F.col("store"), *[c.alias(n) for n, c in out.items()]]
    if kinds and is_var(o):
        cols.append(F.concat_ws(" ", "o_kind", "dt").alias(f"{o[1:]}__kind"))
    return df.select(*cols)


def _vars(t) -> list[str]:
    return [x[1:] for x in t[:3] if is_var(x)]


def bgp(q: DataFrame, triples: list[tuple]) -> DataFrame:
    """Natural join of triple patterns. The most bound pattern goes first, connected ones next."""
    if not triples:
        raise ValueError("a basic graph pattern needs at least one triple")
    bound = lambda t: (is_var(t[0]), is_var(t[2]), is_var(t[1]))
    todo, order, seen = list(triples), [], set()
    while todo:
        linked = [t for t in todo if seen & set(_vars(t))] or (todo if not order else [])
        if not linked:
            raise ValueError("patterns share no variable: that would be a cross product")
        best = min(linked, key=bound)
        order.append(best)
        seen |= set(_vars(best))
        todo.remove(best)
    subjects = {t[0] for t in triples} | {t[1] for t in triples}
    objects = [t[2] for t in triples if is_var(t[2])]
    shared = {o for o in objects if objects.count(o) > 1 and o not in subjects}
    dfs = []
    for s, p, o, *g in order:
        src = q if not (is_var(o) and o in subjects) else q.filter(F.col("o_kind") != "literal")
        dfs.append(pattern(src, s, p, o, *(g or [None]), kinds=o in shared))
    out = reduce(join, dfs)
    return out.drop(*[c for c in out.columns if c.endswith("__kind")])


def shared_vars(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every shared variable."""
    return a.join(b, shared_vars(a, b), "inner")


def optional(left: DataFrame, right: DataFrame, maybe_unbound: tuple[str, ...] = ()) -> DataFrame:
    """Left outer join; a shared variable that may be unbound on the left is compatible with any value.

    Rows are split by which of those variables they bind: each part joins on all keys it has, by equality.
    """
    on = shared_vars(left, right)
    loose = [c for c in maybe_unbound if c in on]
    if not loose:
        return left.join(right, on, "left")
    parts = []
    for bound in product((True, False), repeat=len(loose)):
        free = [c for c, b in zip(loose, bound) if not b]
        mine = left.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() if b else F.col(c).isNull() for c, b in zip(loose, bound)]))
        parts.append(mine.drop(*free).join(right, [c for c in on if c not in free], "left").select(
            *left.columns, *[c for c in right.columns if c not in on]))
    return reduce(lambda x, y: x.unionByName(y), parts)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


SHORT_LIST = 10_000  # values joined as a broadcast table; a longer list joins by the planner's choice

_COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__,
            ">": Column.__gt__, ">=": Column.__ge__}


def where_typed(df: DataFrame, var: str, op: str, value, as_type: str) -> DataFrame:
    """FILTER with a declared type. A text that is no such value drops its row, as a type error does."""
    c = F.col(var)
    typed = instant(c) if as_type == "dateTime" else (
        F.when(c.isin("true", "false"), c == "true") if as_type == "boolean" else c.try_cast(as_type))
    want = instant(F.lit(value)) if as_type == "dateTime" else F.lit(value)
    return df.filter(_COMPARE[op](typed, want))


def check_zoned(text: str) -> str:
    """A cursor must be RFC 3339 with a zone."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text):
        raise ValueError(f"not a date and time with its zone: {text!r}")
    datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    return text


def where_since(df: DataFrame, var: str, since: str) -> DataFrame:
    """Instants at or after `since`; an unreadable date is dropped."""
    return df.filter(instant(F.col(var)) >= instant(F.lit(check_zoned(since))))


def where_in(df: DataFrame, var: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(var).isin(list(values)))


def where_str(df: DataFrame, var: str, contains: str | None = None, starts: str | None = None) -> DataFrame:
    if contains is not None:
        df = df.filter(F.col(var).contains(contains))
    if starts is not None:
        df = df.filter(F.col(var).startswith(starts))
    return df


def where_exists(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other, shared_vars(df, other), "left_semi")


def where_not_exists(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other, shared_vars(df, other), "left_anti")


def minus(df: DataFrame, other: DataFrame) -> DataFrame:
    """MINUS: without a shared variable (store aside) it removes nothing."""
    on = shared_vars(df, other)
    return df.join(other, on, "left_anti") if [c for c in on if c != "store"] else df


def distinct(df: DataFrame, *cols: str) -> DataFrame:
    return (df.select(*cols) if cols else df).dropDuplicates()


def count_distinct(df: DataFrame, var: str, by: tuple[str, ...] = ("store",), name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(var).alias(name))


_AGGS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
         "sample": lambda c: F.min(c), "count_distinct": F.count_distinct}


def aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple], having: Column | None = None) -> DataFrame:
    """GROUP BY / HAVING. `aggs`: output -> (function, column, type). SAMPLE takes the least value, so runs agree.

    GROUP_CONCAT joins the group's distinct values in order with the separator given as third item: a cell is as
    long as its values, so group by a key with few of them.
    """
    cols = []
    for out, (fn, var, *rest) in aggs.items():
        if fn == "group_concat":
            cols.append(F.array_join(F.sort_array(F.collect_set(var)), rest[0] if rest else " ").alias(out))
        else:
            c = F.col(var) if not rest else F.col(var).try_cast(rest[0])
            cols.append(_AGGS[fn](c).alias(out))
    out = df.groupBy(*keys).agg(*cols)
    return out.filter(having) if having is not None else out


def order(df: DataFrame, keys: list[tuple[str, str]], instants: tuple[str, ...] = ()) -> DataFrame:
    """ORDER BY; unbound sorts lowest. Names in `instants` sort by the instant of their text."""
    cols = []
    for name, way in keys:
        c = instant(F.col(name)) if name in instants else F.col(name)
        cols.append(c.asc_nulls_first() if way == "asc" else c.desc_nulls_last())
    return df.orderBy(*cols)


def slice_rows(df: DataFrame, keys: list[tuple[str, str]], limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT / OFFSET: a limit over an order is a distributed top-k, no full sort."""
    out = order(df, keys)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def ask(df: DataFrame) -> DataFrame:
    """One row: does any solution exist. The limit stops the scan at the first hit."""
    return df.limit(1).agg((F.count("*") > 0).alias("answer"))


def construct(df: DataFrame, template: list[tuple]) -> DataFrame:
    """CONSTRUCT: each solution fills the template; triples with an unbound term are left out."""
    def cell(t, object_side=False) -> Column:
        if is_var(t):
            return F.col(t[1:])
        return F.lit(t.value if isinstance(t, literal) else resolve(t))

    def kind(o) -> Column:
        if isinstance(o, literal):
            return F.lit("literal")
        return F.when(cell(o).rlike("^(https?://|urn:)"), "iri").otherwise("literal") if is_var(o) else F.lit("iri")

    triples = F.array(*[F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o"), kind(o).alias("o_kind"))
                        for s, p, o in template])
    out = df.select("store", F.explode(triples).alias("t")).select("store", "t.*")
    return out.dropna(subset=["s", "p", "o"]).dropDuplicates()


def describe(q: DataFrame, iris: DataFrame) -> DataFrame:
    """All quads whose subject is in `iris(s[, store])`."""
    return q.join(iris, shared_vars(iris, q), "left_semi")


def bind(df: DataFrame, var: str, expr: Column) -> DataFrame:
    return df.withColumn(var, expr)


def values(df: DataFrame, var: str, items: list[str]) -> DataFrame:
    """VALUES of one variable, from a list in the query text; a short one is joined as a broadcast table."""
    rows = df.sparkSession.createDataFrame([(x,) for x in items], f"{var} string")
    return df.join(F.broadcast(rows) if len(items) <= SHORT_LIST else rows, var, "inner")


def path(q: DataFrame, expr) -> DataFrame:
    """Property path to `(store, s, o)`.

    `expr` is a predicate name, `("/", a, b, …)` sequence, `("|", a, b, …)` alternative or `("^", a)` inverse.
    A sequence keeps one row per way through, an alternative one per branch, as the path algebra says.
    """
    if isinstance(expr, str):
        return pattern(q, "?s", expr, "?o")
    op, *args = expr
    if op == "^":
        return path(q, args[0]).select("store", F.col("o").alias("s"), F.col("s").alias("o"))
    if op == "|":
        return reduce(lambda a, b: a.unionByName(b), [path(q, a) for a in args])
    if op == "/":
        out = path(q, args[0])
        for a in args[1:]:
            nxt = path(q, a).select("store", F.col("s").alias("o"), F.col("o").alias("__o"))
            out = out.join(nxt, ["store", "o"]).select("store", "s", F.col("__o").alias("o"))
        return out
    raise ValueError(f"unknown path operator {op!r}")


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Transitive closure `+` over `edges(store, s, o)`: `(store, s, o, depth)` with the least depth, however deep.

    Pairs already reached are dropped, so cycles end, and every round is written out, so a lost executor costs one round at most.
    From all nodes, a round doubles the depth: the pairs at the full depth of the last round are joined with all pairs found, since
    a shortest path up to twice as long passes such a node; rounds grow with the logarithm of the longest path. From given `start` nodes a round
    is one step of their frontier, so work follows what they reach and rounds the longest path from them.
    """
    edges = cut_lineage(edges.select("store", "s", "o").dropDuplicates())
    first = edges if start is None else cut_lineage(edges.join(start, shared_vars(start, edges), "left_semi"))
    rounds, depth = [first.withColumn("depth", F.lit(1))], 1
    while True:
        reached = reduce(lambda a, b: a.unionByName(b), rounds)
        hop = reached if start is None else edges.withColumn("depth", F.lit(1))
        front = rounds[-1].filter(F.col("depth") == depth)
        nxt = (front.select("store", "s", F.col("o").alias("__via"))
               .join(hop.select("store", F.col("s").alias("__via"), "o", "depth"), ["store", "__via"])
               .groupBy("store", "s", "o").agg((F.min("depth") + depth).alias("depth")))
        found = cut_lineage(nxt.join(reached, ["store", "s", "o"], "left_anti"))
        if found.isEmpty():
            return reached
        rounds.append(found)
        depth += depth if start is None else 1


def insert(q: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT with set semantics: `q` is a set already and passes as it is, only what it lacks is added."""
    return q.unionByName(fresh_quads(q, new).select(*q.columns))


def _anti(q: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `q` without an equal row in `other`; an absent datatype equals an absent datatype."""
    if "dt" not in on:
        return q.join(other, on, "left_anti").select(*q.columns)
    keys = [c for c in on if c != "dt"] + ["__dt"]
    right = other.withColumn("__dt", F.coalesce("dt", F.lit(""))).select(*keys)
    return q.withColumn("__dt", F.coalesce("dt", F.lit(""))).join(right, keys, "left_anti").select(*q.columns)


def fresh_quads(q: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that `q` does not hold. `q` is first reduced to the subjects and predicates of `new`, so a small `new` does not
    shuffle the graph."""
    new = new.select(*N.QUAD_COLS).dropDuplicates()
    near = q.join(new.select("store", "s", "p").dropDuplicates(), ["store", "s", "p"], "left_semi")
    return _anti(new, near, N.QUAD_COLS)


def delete_where(q: DataFrame, matched: DataFrame) -> DataFrame:
    """DELETE WHERE: quads matched on the columns `matched` carries go."""
    return _anti(q, matched, shared_vars(matched, q))
