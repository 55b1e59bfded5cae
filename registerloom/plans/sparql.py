"""A SPARQL subset, parsed here and compiled to DataFrame plans that Catalyst optimises.

Graph patterns, OPTIONAL, UNION, MINUS, FILTER, BIND, VALUES, sub-selects, property paths (/ | ^ + * ?), GROUP BY with
aggregates, HAVING, DISTINCT, ORDER BY, LIMIT and OFFSET; of named graphs, FROM, FROM NAMED and GRAPH.

A term is one string while a query runs: '<' and the IRI, or '"' and the literal's text, then, after a control character,
'^' and its datatype or '@' and its language. Results show texts only.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.graph import closure

_SEP = "\u0001"
#: Stands between a node and its graph while a path is followed within each graph.
_IN = "\u0002"
#: The column of the graph that a pattern was found in, below GRAPH with a variable.
_GRAPH = "_graph"
_TOKENS = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)
    |(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>\d+\.\d+|\d+)|(?P<pname>(?:[A-Za-z_][\w.-]*)?:(?:[\w-]|\.(?=[\w-]))*)|(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|\|\||&&|!=|<=|>=|[{}().;,*/+!=<>|^?\[\]-])""",
    re.X,
)
#: Relations of texts to the words and entities that they hold.
CONTAINS_WORD, CONTAINS_ENTITY = S.QL + "contains-word", S.QL + "contains-entity"
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


class SparqlError(ValueError):
    """A query that is not in the subset."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Path:
    kind: str  # inv, seq, alt, plus, star, opt
    parts: tuple


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()
    distinct: bool = False
    separator: str = " "


@dataclass
class Query:
    items: list = field(default_factory=list)  # (name, expression); none: all variables
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list | None = None
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    sources: list = field(default_factory=list)  # (IRI, named) of FROM and FROM NAMED


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise SparqlError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.fresh = 0, dict(S.PREFIXES), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def is_(self, *values: str) -> bool:
        kind, text = self.peek()
        return kind in ("op", "word") and (text in values or text.upper() in values)

    def take(self, *values: str) -> bool:
        if self.is_(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise SparqlError(f"{value} expected at {self.peek()[1]!r}")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def query(self) -> Query:
        while self.take("PREFIX"):
            name, iri = self.next()[1], self.next()[1]
            self.prefixes[name[:-1]] = iri[1:-1]
        q = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def select(self) -> Query:
        self.need("SELECT")
        q = Query(distinct=self.take("DISTINCT"))
        if not self.take("*"):
            while True:
                if self.peek()[0] == "var":
                    name = self.next()[1][1:]
                    q.items.append((name, Var(name)))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.items.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
        while self.take("FROM"):
            named = self.take("NAMED")
            source = self.term()
            if not isinstance(source, Iri):
                raise SparqlError("a graph is named by an IRI")
            q.sources.append((source.value, named))
        self.take("WHERE")
        q.where = self.group()
        if self.take("GROUP"):
            self.need("BY")
            q.group = []
            while self.peek()[0] == "var" or self.is_("("):
                if self.take("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.take("AS") else self.name()
                    self.need(")")
                    q.group.append((name, e))
                else:
                    name = self.next()[1][1:]
                    q.group.append((name, Var(name)))
        if self.take("HAVING"):
            while self.is_("("):
                q.having.append(self.primary())
        if self.is_("INTERNAL"):
            self.at += 1
            self.need("SORT")
            self.need("BY")
            q.order = self.order_keys()
        elif self.take("ORDER"):
            self.need("BY")
            q.order = self.order_keys()
        while self.is_("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                q.limit = int(self.next()[1])
            else:
                self.at += 1
                q.offset = int(self.next()[1])
        return q

    def order_keys(self) -> list:
        keys = []
        while self.peek()[0] == "var" or self.is_("(", "ASC", "DESC"):
            down = self.take("DESC")
            if not down:
                self.take("ASC")
            keys.append((self.primary(), down))
        return keys

    def name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def group(self) -> list:
        """Elements of a group: ('triples', list), ('filter', e), ('optional', g), ('union', [g]), ('minus', g), ('bind', e, v),
        ('values', names, rows), ('select', q), ('group', g), ('graph', term, g)."""
        self.need("{")
        out: list = []
        if self.is_("SELECT"):
            inner = self.select()
            if inner.sources:
                raise SparqlError("FROM stands in the outermost query only")
            out.append(("select", inner))
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("."):
                continue
            if self.is_("{"):
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.take("GRAPH"):
                name = self.term()
                if isinstance(name, Literal):
                    raise SparqlError("a graph is named by an IRI or a variable")
                out.append(("graph", name, self.group()))
            elif self.take("FILTER"):
                out.append(("filter", self.primary()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.take("VALUES"):
                out.append(self.values())
            else:
                triples = self.triples()
                if out and out[-1][0] == "triples":
                    out[-1][1].extend(triples)
                else:
                    out.append(("triples", triples))
        return out

    def values(self) -> tuple:
        many = self.take("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.term())
                rows.append(row)
            else:
                rows.append([None if self.take("UNDEF") else self.term()])
        return ("values", names, rows)

    def triples(self) -> list:
        out, s = [], self.term()
        while True:
            p = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return out
            if self.is_(".", "}"):
                return out

    def path(self):
        left = self.sequence()
        while self.take("|"):
            left = Path("alt", (left, self.sequence()))
        return left

    def sequence(self):
        left = self.step()
        while self.take("/"):
            left = Path("seq", (left, self.step()))
        return left

    def step(self):
        if self.take("^"):
            return Path("inv", (self.step(),))
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.peek() == ("word", "a"):
            self.at += 1
            p = Iri(S.A)
        else:
            p = self.term()
        for sign, kind in (("+", "plus"), ("*", "star"), ("?", "opt")):
            if self.take(sign):
                p = Path(kind, (p,))
        return p

    def term(self):
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Iri(text[1:-1])
        if kind == "pname":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}")
            return Iri(self.prefixes[prefix] + local)
        if kind == "string":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1])
            if self.peek()[0] == "lang":
                return Literal(value, lang=self.next()[1][1:])
            if self.take("^^"):
                return Literal(value, self.term().value)
            return Literal(value)
        if kind == "number":
            return Literal(text, S.XSD + ("decimal" if "." in text else "integer"))
        if kind == "word" and text.lower() in ("true", "false"):
            return Literal(text.lower(), S.XSD + "boolean")
        raise SparqlError(f"a term expected at {text!r}")

    def expression(self) -> Expr:
        left = self.conjunction()
        while self.take("||"):
            left = Expr("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.comparison()
        while self.take("&&"):
            left = Expr("and", (left, self.comparison()))
        return left

    def comparison(self):
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return Expr(op, (left, self.sum()))
        negated = self.is_("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.at += 1
        if self.take("IN"):
            self.need("(")
            e = Expr("in", (left, *self.arguments()))
            return Expr("not", (e,)) if negated else e
        return left

    def sum(self):
        left = self.product()
        while self.is_("+", "-"):
            op = self.next()[1]
            left = Expr(op, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while self.is_("*", "/"):
            op = self.next()[1]
            left = Expr(op, (left, self.unary()))
        return left

    def unary(self):
        if self.take("!"):
            return Expr("not", (self.unary(),))
        if self.take("-"):
            return Expr("-", (Literal("0", S.XSD + "integer"), self.unary()))
        return self.primary()

    def arguments(self) -> list:
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return args

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.peek()
        name = text.upper()
        if kind == "word" and name in _AGGREGATES and self.peek(1)[1] == "(":
            self.at += 2
            distinct = self.take("DISTINCT")
            e = None if self.take("*") else self.expression()
            separator = " "
            if self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = self.term().value
            self.need(")")
            return Expr("agg:" + name, () if e is None else (e,), distinct, separator)
        if kind == "word" and self.peek(1)[1] == "(":
            self.at += 2
            return Expr("call:" + name, tuple(self.arguments()))
        if kind == "pname" and self.peek(1)[1] == "(":
            function = self.term().value
            self.at += 1
            return Expr("cast:" + function, tuple(self.arguments()))
        return self.term()


def parse(text: str) -> Query:
    return Parser(text).query()


@dataclass
class Rel:
    """A table with a column for each variable; kind: term, or number, string or bool for computed ones; maybe: those that
    may be unbound."""

    df: DataFrame
    kinds: dict[str, str]
    maybe: set[str] = field(default_factory=set)


def encode(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    tail = F.coalesce(F.concat(F.lit(_SEP + "^"), F.nullif(datatype, F.lit(S.XSD + "string"))), F.concat(F.lit(_SEP + "@"), lang), F.lit(""))
    return F.when(kind == "iri", F.concat(F.lit("<"), value)).otherwise(F.concat(F.lit('"'), value, tail))


def constant(term) -> str:
    if isinstance(term, Iri):
        return "<" + term.value
    tail = f"{_SEP}^{term.datatype}" if term.datatype and term.datatype != S.XSD + "string" else f"{_SEP}@{term.lang}" if term.lang else ""
    return f'"{term.value}{tail}'


def lexical(c: Column) -> Column:
    return F.substring_index(F.substring(c, 2, 2**31 - 1), _SEP, 1)


class Graph:
    """Triples (s, p, o, o_kind, o_dt, o_lang) that queries run on.

    wide, if given, is a table of subjects (s) with a column for each of some properties that have at most one value, and the
    columns' names by property; a star of such properties is then one scan instead of joins. With strict_types, numbers are
    only what has a numeric datatype; by default, text that reads as a number is one.

    Triples with a column g, the IRI of their graph, are quads: GRAPH reads its graph's statements only, which is a partition
    filter where they are stored by g; all else reads the statements of all graphs, or of those in FROM, each once. FROM
    without FROM NAMED leaves GRAPH no graph and the other way round, as the language says. wide must then hold for all."""

    def __init__(self, triples: DataFrame, wide: tuple[DataFrame, dict[str, str]] | None = None, strict_types: bool = False):
        self.quads = triples if "g" in triples.columns else None
        self.triples, self.wide, self.strict = triples, wide, strict_types
        if self.quads is not None:
            self.triples = self.quads.drop("g").distinct()
        self.spark, self.by_graph = triples.sparkSession, False

    def over(self, sources: list) -> Graph:
        """The same with FROM and FROM NAMED."""
        if not sources:
            return self
        default, named = (list(dict.fromkeys(iri for iri, n in sources if n is kind)) for kind in (False, True))
        out = self.part(self.quads_of(default).drop("g"))
        if len(default) > 1:  # what two graphs state is one statement
            out.triples = out.triples.distinct()
        out.quads = self.quads_of(named)
        return out

    def quads_of(self, graphs: list[str]) -> DataFrame:
        if self.quads is None:
            raise SparqlError("these triples belong to no named graphs")
        return self.quads.filter(F.col("g").isin(graphs) if graphs else F.lit(False))

    def part(self, triples: DataFrame, by_graph: bool = False) -> Graph:
        """This graph with other triples for patterns to be found in, each within its own g if by_graph."""
        out = copy.copy(self)
        out.triples, out.wide, out.by_graph = triples, None, by_graph
        return out

    def named(self, name, elements: list) -> Rel:
        """GRAPH: a group found in one graph, or in each by itself, whose name is then the variable's value."""
        if isinstance(name, Iri):
            return self.part(self.quads_of([name.value]).drop("g")).group(elements)
        if self.quads is None:
            raise SparqlError("these triples belong to no named graphs")
        rel = self.part(self.quads, True).group(elements)
        kinds = {n: k for n, k in rel.kinds.items() if n != _GRAPH}
        of = Rel(rel.df.withColumnRenamed(_GRAPH, name.name), {**kinds, name.name: "term"}, rel.maybe)
        if name.name not in kinds:
            return of
        if kinds[name.name] != "term":
            raise SparqlError(f"?{name.name} is a graph and computed")
        own = F.col(f"`{name.name}`")  # the group has a variable of that name too
        same = own == F.col(_GRAPH)
        df = rel.df.filter(same | own.isNull() if name.name in rel.maybe else same).withColumn(name.name, F.col(_GRAPH)).drop(_GRAPH)
        return Rel(df, kinds, rel.maybe - {name.name})

    def placed(self, rel: Rel) -> Rel:
        """rel with the graph that it holds in; what came from no pattern holds in each."""
        if not self.by_graph or _GRAPH in rel.kinds:
            return rel
        graphs = Rel(self.graphs(), {_GRAPH: "term"})
        return self.join(rel, graphs, "inner") if rel.kinds else graphs

    def graphs(self) -> DataFrame:
        return self.triples.select(F.concat(F.lit("<"), F.col("g")).alias(_GRAPH)).distinct()

    def query(self, text: str, cap: int | None = None) -> DataFrame:
        """The result of a query; with cap, at most so many rows where the query itself sets no limit."""
        q = parse(text)
        if cap is not None and q.limit is None:
            q.limit = cap
        rel = self.over(q.sources).run(q)
        names = [n for n, _ in q.items] or list(rel.kinds)
        out = [(lexical(F.col(f"`{n}`")) if rel.kinds[n] == "term" else F.col(f"`{n}`")).alias(n) for n in names]
        return rel.df.select(*out)

    def run(self, q: Query) -> Rel:
        rel = self.group(q.where)
        items = q.items or [(n, Var(n)) for n in rel.kinds if not n.startswith("_")]
        aggregated = q.group is not None or any(_has_aggregate(e) for _, e in items)
        if self.by_graph:
            if q.limit is not None or q.offset:
                raise SparqlError("LIMIT and OFFSET do not go below GRAPH with a variable")
            if aggregated and not q.group:
                raise SparqlError("below GRAPH with a variable, aggregates need GROUP BY")
            items = [*items, (_GRAPH, Var(_GRAPH))]
            q = replace(q, group=[*q.group, (_GRAPH, Var(_GRAPH))] if aggregated else None)
        if aggregated:
            rel, items, having, order = self.aggregate(rel, q, items)
        else:
            having, order = q.having, q.order
        for e in having:
            rel = replace(rel, df=rel.df.filter(self.truth(e, rel)))
        known = dict(rel.kinds)
        for name, e in items:
            if e != Var(name):
                c, kind = self.value(e, rel)
                rel = Rel(rel.df.withColumn(name, c), {**rel.kinds, name: kind}, rel.maybe | {name})
            elif name not in known:
                rel = Rel(rel.df.withColumn(name, F.lit(None).cast("string")), {**rel.kinds, name: "term"}, rel.maybe | {name})
        names = [n for n, _ in items]
        if q.distinct:
            rel = Rel(rel.df.select(*[F.col(f"`{n}`") for n in names]).distinct(), {n: rel.kinds[n] for n in names}, rel.maybe & set(names))
        keys = []
        for e, down in order:
            c, kind = self.value(e, rel)
            for k in [self.number(c, kind), lexical(c)] if kind == "term" else [c]:
                keys.append(k.desc() if down else k.asc())
        df = rel.df.orderBy(*keys) if keys else rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df.select(*[F.col(f"`{n}`") for n in names]), {n: rel.kinds[n] for n in names}, rel.maybe & set(names))

    def aggregate(self, rel: Rel, q: Query, items: list):
        found: dict[Expr, str] = {}

        def lift(e):
            if isinstance(e, Expr) and e.op.startswith("agg:"):
                return Var(found.setdefault(e, f"_agg{len(found)}"))
            return replace(e, args=tuple(map(lift, e.args))) if isinstance(e, Expr) else e

        items = [(n, lift(e)) for n, e in items]
        having, order = [lift(e) for e in q.having], [(lift(e), d) for e, d in q.order]
        keys = []
        for name, e in q.group or []:
            c, kind = self.value(e, rel)
            rel = Rel(rel.df.withColumn(name, c), {**rel.kinds, name: kind}, rel.maybe | ({name} if e != Var(name) else set()))
            keys.append(name)
        kinds, aggs = {k: rel.kinds[k] for k in keys}, []
        for e, name in found.items():
            c, kinds[name] = self.aggregated(e, rel)
            aggs.append(c.alias(name))
        columns = [F.col(f"`{k}`") for k in keys]
        df = rel.df.groupBy(*columns).agg(*aggs) if aggs else rel.df.select(*columns).distinct()
        return Rel(df, kinds, rel.maybe & set(keys) | set(found.values())), items, having, order

    def aggregated(self, e: Expr, rel: Rel) -> tuple[Column, str]:
        op = e.op[4:]
        if not e.args:
            return (F.count_distinct(F.struct(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(_SEP)) for n in rel.kinds])) if e.distinct else F.count("*")), "number"
        c, kind = self.value(e.args[0], rel)
        if op == "COUNT":
            return (F.count_distinct(c) if e.distinct else F.count(c)), "number"
        if op in ("SUM", "AVG"):
            n = self.number(c, kind)
            if op == "SUM":
                return F.coalesce(F.sum_distinct(n) if e.distinct else F.sum(n), F.lit(0.0)), "number"
            return (F.sum_distinct(n) / F.count_distinct(n) if e.distinct else F.avg(n)), "number"
        if op == "GROUP_CONCAT":
            text = self.string(c, kind)
            return F.array_join(F.array_sort(F.collect_set(text) if e.distinct else F.collect_list(text)), e.separator), "string"
        if kind != "term":
            return (F.max(c) if op == "MAX" else F.min(c)), kind
        if op == "SAMPLE":  # any value will do; the least is the same each time
            return F.min(c), "term"
        pick = F.struct(self.number(c, kind).alias("n"), c.alias("t"))
        return (F.max if op == "MAX" else F.min)(F.when(c.isNotNull(), pick))["t"], "term"

    def group(self, elements: list) -> Rel:
        rel, filters = None, []
        for e in elements:
            kind = e[0]
            if kind == "filter":
                filters.append(e[1])
            elif kind == "optional":
                inner = [x for x in e[1] if x[0] != "filter"]
                rel = self.join(self.placed(self.unit() if rel is None else rel), self.group(inner), "left", [x[1] for x in e[1] if x[0] == "filter"])
            elif kind == "minus":
                rel = self.minus(self.placed(self.unit() if rel is None else rel), self.group(e[1]))
            elif kind == "bind":
                rel = self.unit() if rel is None else rel
                c, k = self.value(e[1], rel)
                rel = Rel(rel.df.withColumn(e[2], c), {**rel.kinds, e[2]: k}, rel.maybe | {e[2]})
            elif kind == "graph":
                new = self.named(e[1], e[2])
                rel = new if rel is None else self.join(rel, new, "inner")
            else:
                new = {"triples": self.basic, "union": self.union, "group": self.group, "select": self.run}[kind](e[1]) if kind != "values" else self.table(e[1], e[2])
                rel = new if rel is None else self.join(rel, new, "inner")
        rel = self.placed(self.unit() if rel is None else rel)
        for f in filters:
            rel = replace(rel, df=rel.df.filter(self.truth(f, rel)))
        return rel

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(), {})

    def table(self, names: list[str], rows: list[list]) -> Rel:
        data = [tuple(None if t is None else constant(t) for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
        return Rel(df, dict.fromkeys(names, "term"), {n for i, n in enumerate(names) if any(r[i] is None for r in data)})

    def union(self, groups: list) -> Rel:
        rels = [self.group(g) for g in groups]
        names = list(dict.fromkeys(n for r in rels for n in r.kinds))
        kinds = {n: next(r.kinds[n] for r in rels if n in r.kinds) for n in names}
        for n in names:
            if len({r.kinds[n] for r in rels if n in r.kinds}) > 1:
                kinds[n] = "term"
                for r in rels:
                    if n in r.kinds and r.kinds[n] != "term":
                        r.df = r.df.withColumn(n, F.concat(F.lit('"'), F.col(f"`{n}`").cast("string")))
        df = rels[0].df
        for r in rels[1:]:
            df = df.unionByName(r.df, allowMissingColumns=True)
        return Rel(df, kinds, {n for n in names if any(n not in r.kinds or n in r.maybe for r in rels)})

    def join(self, left: Rel, right: Rel, how: str, conditions: list | None = None) -> Rel:
        """Join on shared variables; one that may be unbound is compatible with any value."""
        shared = [n for n in right.kinds if n in left.kinds]
        for n in shared:
            if left.kinds[n] != right.kinds[n]:
                raise SparqlError(f"?{n} is a term in one pattern and computed in the other")
        unsure = [n for n in shared if n in left.maybe or n in right.maybe]
        if how == "inner" and unsure and not conditions:
            return self.apart(left, right, unsure)
        r = right.df.select(*[F.col(f"`{n}`").alias(f"__r_{n}") for n in right.kinds])
        on = None
        for n in shared:
            a, b = F.col(f"`{n}`"), F.col(f"`__r_{n}`")
            test = a == b
            if n in left.maybe:
                test = test | a.isNull()
            if n in right.maybe:
                test = test | b.isNull()
            on = test if on is None else on & test
        kinds = {**left.kinds, **right.kinds}
        if conditions:
            both = Rel(left.df, kinds)
            names = {n: F.coalesce(F.col(f"`{n}`"), F.col(f"`__r_{n}`")) if n in left.maybe else F.col(f"`{n}`") if n in left.kinds else F.col(f"`__r_{n}`") for n in kinds}
            for e in conditions:
                test = self.truth(e, both, names)
                on = test if on is None else on & test
        # patterns that share nothing have a product for a result, as the language says
        df = left.df.join(r, on, how) if on is not None else left.df.crossJoin(r) if how == "inner" else left.df.join(r, F.lit(True), how)
        out = []
        for n in kinds:
            a, b = F.col(f"`{n}`"), F.col(f"`__r_{n}`")
            out.append((a if n not in right.kinds else b if n not in left.kinds else F.coalesce(a, b) if n in left.maybe else a).alias(n))
        return Rel(df.select(*out), kinds, self._maybe(left, right, how, kinds))

    @staticmethod
    def _maybe(left: Rel, right: Rel, how: str, kinds) -> set[str]:
        if how == "inner":
            return {n for n in kinds if (n not in left.kinds or n in left.maybe) and (n not in right.kinds or n in right.maybe)}
        return left.maybe | {n for n in right.kinds if n not in left.kinds}

    def apart(self, left: Rel, right: Rel, unsure: list[str]) -> Rel:
        """An inner join by cases of which shared variables are bound on either side, so that each case joins on equal values."""
        n = unsure[0]
        out = []
        for a in (True, False) if n in left.maybe else (True,):
            for b in (True, False) if n in right.maybe else (True,):
                x, y = (self.case(rel, n, bound) if n in rel.maybe else rel for rel, bound in ((left, a), (right, b)))
                out.append(self.join(x, y, "inner"))
        kinds = {**left.kinds, **right.kinds}
        df = out[0].df
        for rel in out[1:]:
            df = df.unionByName(rel.df, allowMissingColumns=True)
        return Rel(df.select(*[F.col(f"`{k}`") for k in kinds]), kinds, self._maybe(left, right, "inner", kinds))

    @staticmethod
    def case(rel: Rel, n: str, bound: bool) -> Rel:
        """Rows with ?n bound, or those without, which then have no such variable."""
        c = F.col(f"`{n}`")
        if bound:
            return Rel(rel.df.filter(c.isNotNull()), rel.kinds, rel.maybe - {n})
        return Rel(rel.df.filter(c.isNull()).drop(n), {k: v for k, v in rel.kinds.items() if k != n}, rel.maybe - {n})

    def minus(self, left: Rel, right: Rel) -> Rel:
        shared = [n for n in right.kinds if n in left.kinds]
        if not set(shared) - {_GRAPH}:
            return left
        r = right.df.select(*[F.col(f"`{n}`").alias(f"__r_{n}") for n in shared]).distinct()
        on, bound = None, None
        for n in shared:
            a, b = F.col(f"`{n}`"), F.col(f"`__r_{n}`")
            test = a == b
            if n in left.maybe or n in right.maybe:
                test = test | a.isNull() | b.isNull()
                some = a.isNotNull() & b.isNotNull()
                bound = some if bound is None else bound | some
            elif n != _GRAPH:
                bound = F.lit(True)
            on = test if on is None else on & test
        return replace(left, df=left.df.join(r, on & bound, "left_anti"))

    def basic(self, patterns: list) -> Rel:
        """Joins of a basic graph pattern; stars over single-valued properties become one scan where there is a wide table."""
        patterns, rels = list(patterns), []
        if self.wide:
            table, columns = self.wide
            for s in dict.fromkeys(p[0] for p in patterns if isinstance(p[0], Var)):
                star = [p for p in patterns if p[0] == s and isinstance(p[1], Iri) and p[1].value in columns]
                if len(star) > 1 and len({p[1] for p in star}) == len(star) and len({p[2] for p in star if isinstance(p[2], Var)}) == sum(isinstance(p[2], Var) for p in star):
                    rels.append(self.star(table, columns, s, star))
                    patterns = [p for p in patterns if p not in star]
        weight = lambda p: sum(isinstance(t, Var) for t in p) + 2 * isinstance(p[1], Path)
        rels += [self.scan(p) for p in sorted(patterns, key=weight)]
        rel, rest = rels[0], rels[1:]
        while rest:  # the next one that shares a variable, if any
            i = next((i for i, r in enumerate(rest) if set(r.kinds) & set(rel.kinds)), 0)
            rel = self.join(rel, rest.pop(i), "inner")
        return rel

    def star(self, table: DataFrame, columns: dict[str, str], s: Var, star: list) -> Rel:
        df = table
        out, kinds = [F.concat(F.lit("<"), F.col("s")).alias(s.name)], {s.name: "term"}
        for _, p, o in star:
            c = F.col(f"`{columns[p.value]}`")
            if isinstance(o, Var):
                df = df.filter(c.isNotNull())
                if o == s:
                    df = df.filter(c == F.concat(F.lit("<"), F.col("s")))
                else:
                    out.append(c.alias(o.name))
                    kinds[o.name] = "term"
            else:
                df = df.filter(c == constant(o))
        return Rel(df.select(*out), kinds)

    def scan(self, pattern: tuple) -> Rel:
        s, p, o = pattern
        if isinstance(p, Iri) and p.value in (CONTAINS_WORD, CONTAINS_ENTITY):
            return self.mentions(s, p.value, o)
        if isinstance(p, Path):
            df = self.ends(s, p, o)
            columns = [(s, F.col("a")), (o, F.col("b"))]
            if self.by_graph:
                columns = [(t, F.substring_index(c, _IN, 1)) for t, c in columns] + [(Var(_GRAPH), F.concat(F.lit("<"), F.substring_index("a", _IN, -1)))]
        else:
            df = self.triples
            if isinstance(p, Iri):
                df = df.filter(F.col("p") == p.value)
            if isinstance(s, Iri):
                df = df.filter(F.col("s") == s.value)
            if isinstance(o, (Iri, Literal)):
                df = df.filter(F.col("o") == o.value)  # reaches the scan; the whole term is compared below
            columns = [(s, F.concat(F.lit("<"), F.col("s"))), (p, F.concat(F.lit("<"), F.col("p"))), (o, encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")))]
            if self.by_graph:
                columns.append((Var(_GRAPH), F.concat(F.lit("<"), F.col("g"))))
        names: dict[str, Column] = {}
        for term, c in columns:
            if isinstance(term, Var):
                if term.name in names:
                    df = df.filter(names[term.name] == c)
                else:
                    names[term.name] = c
            elif isinstance(p, Path) or term is o:  # subjects and properties are compared already
                df = df.filter(c == constant(term))
        return Rel(df.select(*[c.alias(n) for n, c in names.items()]), dict.fromkeys(names, "term"))

    def mentions(self, s, relation: str, o) -> Rel:
        """Texts, the literals of the graph, that hold words (all of a literal's; one ending in * is a beginning), or that belong
        to an entity's own statements."""
        if not isinstance(s, Var):
            raise SparqlError("a text is a variable")
        place = [F.concat(F.lit("<"), F.col("g")).alias(_GRAPH)] if self.by_graph else []
        texts = self.triples.filter("o_kind = 'literal'").select(F.concat(F.lit("<"), F.col("s")).alias("entity"), encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("text"), F.col("o"), *place)

        def found(rows: DataFrame, *columns: Column, names: tuple) -> Rel:
            names = (*names, _GRAPH) if place else names
            return Rel(rows.select(*columns, *([F.col(_GRAPH)] if place else [])).distinct(), dict.fromkeys(names, "term"))

        text = F.col("text").alias(s.name)
        if relation == CONTAINS_ENTITY:
            if isinstance(o, Var):
                return found(texts, text, F.col("entity").alias(o.name), names=(s.name, o.name))
            return found(texts.filter(F.col("entity") == constant(o)), text, names=(s.name,))
        if not isinstance(o, Literal):
            raise SparqlError("the words are a literal")
        words = F.split(F.lower("o"), r"[^\p{L}\p{N}]+")
        for word in o.value.lower().split():
            texts = texts.filter(_begins(words, word[:-1]) if word.endswith("*") else F.array_contains(words, word))
        return found(texts, text, names=(s.name,))

    def ends(self, s, path: Path, o) -> DataFrame:
        """Ends (a, b) of a path between two terms; it is followed from a bound one, backwards if only the object is."""
        if isinstance(o, (Iri, Literal)) and not isinstance(s, (Iri, Literal)):
            return self.pairs(Path("inv", (path,)), self.one(o)).select(F.col("b").alias("a"), F.col("a").alias("b"))
        return self.pairs(path, self.one(s) if isinstance(s, (Iri, Literal)) else None)

    def one(self, term) -> DataFrame:
        if self.by_graph:
            return self.triples.select(F.concat(F.lit(constant(term)), F.lit(_IN), F.col("g")).alias("node")).distinct()
        return self.spark.createDataFrame([(constant(term),)], "node string")

    def node(self, c: Column) -> Column:
        """A term as an end of a path; with by_graph, together with its graph."""
        return F.concat(c, F.lit(_IN), F.col("g")) if self.by_graph else c

    def pairs(self, path, starts: DataFrame | None = None) -> DataFrame:
        """Ends (a, b) of a property path; only those with a in starts (node), if given."""
        if isinstance(path, Iri):
            found = self.triples.filter(F.col("p") == path.value)
            found = found.select(self.node(F.concat(F.lit("<"), F.col("s"))).alias("a"), self.node(encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))).alias("b"))
            return found if starts is None else found.join(starts, found["a"] == starts["node"], "left_semi")
        if path.kind == "inv":
            inner = path.parts[0]
            if isinstance(inner, Path):  # the parts are followed backwards, in reverse order
                parts = tuple(Path("inv", (p,)) for p in inner.parts)
                return self.pairs(inner.parts[0] if inner.kind == "inv" else Path(inner.kind, parts[::-1] if inner.kind == "seq" else parts), starts)
            found = self.pairs(inner).select(F.col("b").alias("a"), F.col("a").alias("b"))
            return found if starts is None else found.join(starts, found["a"] == starts["node"], "left_semi")
        if path.kind == "seq":
            left = self.pairs(path.parts[0], starts).select("a", F.col("b").alias("m"))
            right = self.pairs(path.parts[1], left.select(F.col("m").alias("node")).distinct() if _repeats(path.parts[1]) else None)
            return left.join(right.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        if path.kind == "alt":
            return self.pairs(path.parts[0], starts).unionByName(self.pairs(path.parts[1], starts))
        same = self.nodes()
        same = same if starts is None else same.join(starts, same["a"] == starts["node"], "left_semi")
        if path.kind == "opt":
            return self.pairs(path.parts[0], starts).unionByName(same).distinct()
        reached = closure(self.pairs(path.parts[0]).select(F.col("a").alias("src"), F.col("b").alias("dst")), starts=starts).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return reached if path.kind == "plus" else reached.unionByName(same).distinct()

    def nodes(self) -> DataFrame:
        ends = [F.concat(F.lit("<"), F.col("s")), encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))]
        ends = self.triples.select(self.node(ends[0]).alias("a")).unionByName(self.triples.select(self.node(ends[1]).alias("a"))).distinct()
        return ends.select("a", F.col("a").alias("b"))

    def number(self, c: Column, kind: str) -> Column:
        if kind == "number":
            return c.cast("double")
        if kind != "term":
            return F.try_to_number(c, F.lit("S999999999999999.999999")).cast("double") if kind == "string" else c.cast("double")
        value = lexical(c).try_cast("double")
        if self.strict:
            numeric = [S.XSD + t for t in ("integer", "decimal", "double", "float", "int", "long")]
            value = F.when(F.substring_index(c, _SEP + "^", -1).isin(numeric), value)
        return F.when(c.startswith('"'), value)

    def string(self, c: Column, kind: str) -> Column:
        return lexical(c) if kind == "term" else c.cast("string")

    def truth(self, e, rel: Rel, names: dict[str, Column] | None = None) -> Column:
        c, kind = self.value(e, rel, names)
        if kind == "bool":
            return c
        if kind == "number":
            return c != 0
        if kind == "string":
            return c != ""
        return F.when(c.endswith(_SEP + "^" + S.XSD + "boolean"), lexical(c) == "true").otherwise(lexical(c) != "")

    def value(self, e, rel: Rel, names: dict[str, Column] | None = None) -> tuple[Column, str]:
        if isinstance(e, Var):
            if e.name not in rel.kinds:
                return F.lit(None).cast("string"), "term"
            return (names[e.name] if names else F.col(f"`{e.name}`")), rel.kinds[e.name]
        if isinstance(e, Literal) and e.datatype in (S.XSD + "integer", S.XSD + "decimal"):
            return F.lit(int(e.value) if e.datatype.endswith("integer") else float(e.value)), "number"
        if isinstance(e, (Iri, Literal)):
            return F.lit(constant(e)), "term"
        if e.op in ("or", "and", "not"):
            parts = [self.truth(a, rel, names) for a in e.args]
            return (~parts[0] if e.op == "not" else parts[0] | parts[1] if e.op == "or" else parts[0] & parts[1]), "bool"
        if e.op.startswith("agg:"):
            raise SparqlError("an aggregate stands where there are no groups")
        args = [self.value(a, rel, names) for a in e.args]
        if e.op in ("+", "-", "*", "/"):
            a, b = (self.number(*x) for x in args)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e.op], "number"
        if e.op in ("=", "!=", "<", ">", "<=", ">="):
            return self.compared(e.op, *args), "bool"
        if e.op == "in":
            tests = [self.compared("=", args[0], x) for x in args[1:]]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return out, "bool"
        if e.op.startswith("cast:"):
            target = e.op[5:].removeprefix(S.XSD)
            if target in ("integer", "int", "long"):
                return self.number(*args[0]).try_cast("bigint"), "number"
            if target in ("decimal", "double", "float"):
                return self.number(*args[0]), "number"
            if target == "string":
                return self.string(*args[0]), "string"
            raise SparqlError(f"no cast to {target}")
        return self.called(e.op[5:], e, args, rel, names)

    def compared(self, op: str, x: tuple[Column, str], y: tuple[Column, str]) -> Column:
        signs = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
        sign = signs[op]
        if "number" in (x[1], y[1]):
            return sign(self.number(*x), self.number(*y))
        if x[1] == y[1] == "term":
            if op in ("=", "!="):
                return sign(x[0], y[0])
            a, b = self.number(*x), self.number(*y)
            return F.when(a.isNotNull() & b.isNotNull(), sign(a, b)).otherwise(sign(lexical(x[0]), lexical(y[0])))
        if x[1] == y[1] == "bool":
            return sign(x[0], y[0])
        return sign(self.string(*x), self.string(*y))

    def called(self, name: str, e: Expr, args: list, rel: Rel, names) -> tuple[Column, str]:
        text = [self.string(*a) for a in args]
        if name in ("TEXT", "SCORE"):  # of a text: itself, and the number of its words
            if not (args and args[0][1] == "term"):
                raise SparqlError(f"{name} is of a text")
            score = f"_score_{e.args[0].name}" if isinstance(e.args[0], Var) else None
            if name == "SCORE" and score in rel.kinds:  # from an index of words
                return F.col(f"`{score}`"), "number"
            return (text[0], "string") if name == "TEXT" else (F.size(F.split(text[0], r"[^\p{L}\p{N}]+")), "number")
        if name == "BOUND":
            return args[0][0].isNotNull(), "bool"
        if name == "STR":
            return text[0], "string"
        if name == "REGEX":
            if not all(isinstance(a, Literal) for a in e.args[1:]):
                raise SparqlError("the pattern and the flags of REGEX are literals")
            flags = "(?iu)" if len(e.args) > 2 and "i" in e.args[2].value else ""
            return F.regexp_like(text[0], F.lit(flags + e.args[1].value)), "bool"
        simple = {
            "CONTAINS": lambda: (F.contains(text[0], text[1]), "bool"),
            "STRSTARTS": lambda: (F.startswith(text[0], text[1]), "bool"),
            "STRENDS": lambda: (F.endswith(text[0], text[1]), "bool"),
            "LCASE": lambda: (F.lower(text[0]), "string"),
            "UCASE": lambda: (F.upper(text[0]), "string"),
            "STRLEN": lambda: (F.length(text[0]), "number"),
            "CONCAT": lambda: (F.concat(*text), "string"),
            "ISIRI": lambda: (args[0][0].startswith("<"), "bool"),
            "ISLITERAL": lambda: (args[0][0].startswith('"'), "bool"),
            "LANG": lambda: (F.when(args[0][0].startswith('"'), F.regexp_extract(args[0][0], _SEP + r"@([^\x01]*)$", 1)), "string"),
            "DATATYPE": lambda: (F.when(args[0][0].startswith('"'), F.concat(F.lit("<"), F.coalesce(F.nullif(F.regexp_extract(args[0][0], _SEP + r"\^([^\x01]*)$", 1), F.lit("")), F.lit(S.XSD + "string")))), "term"),
            "LANGMATCHES": lambda: (F.when(text[1] == "*", text[0] != "").otherwise((F.lower(text[0]) == F.lower(text[1])) | F.lower(text[0]).startswith(F.concat(F.lower(text[1]), F.lit("-")))), "bool"),
        }
        if name in simple:
            return simple[name]()
        if name in ("COALESCE", "IF"):
            branches = args if name == "COALESCE" else args[1:]
            kind = branches[0][1] if len({k for _, k in branches}) == 1 else "string"
            columns = [c if kind == branches[0][1] and k == kind else self.string(c, k) for c, k in branches]
            return (F.coalesce(*columns) if name == "COALESCE" else F.when(self.truth(e.args[0], rel, names), columns[0]).otherwise(columns[1])), kind
        raise SparqlError(f"no function {name}")


def _begins(words: Column, start: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(start)))


def _repeats(path) -> bool:
    return isinstance(path, Path) and (path.kind in ("plus", "star") or any(map(_repeats, path.parts)))


def _has_aggregate(e) -> bool:
    return isinstance(e, Expr) and (e.op.startswith("agg:") or any(map(_has_aggregate, e.args)))


def single_valued(triples: DataFrame) -> list[str]:
    """Properties that no subject has two values of; as many rows as there are properties are fetched."""
    per = triples.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.max("n").alias("n"))
    return sorted(r["p"] for r in per.filter("n = 1").collect())


def wide_table(triples: DataFrame, properties: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """A row for each subject with the encoded values of properties that have at most one each, in columns named by the
    properties; store it before use."""
    value = encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    rows = triples.filter(F.col("p").isin(properties)).groupBy("s").agg(*[F.max(F.when(F.col("p") == p, value)).alias(p) for p in properties])
    return rows, wide_columns(rows)


def wide_columns(wide: DataFrame) -> dict[str, str]:
    return {c: c for c in wide.columns if c != "s"}


def expand(template: str, values: dict[str, str], flags: set[str] = frozenset()) -> str:
    """A query from a template with lines '# IF A AND !B #', '# ELSE #', '# ENDIF #' and placeholders %NAME%.

    Placeholders may expand to text with further ones."""
    out, stack = [], []  # stack: [taken so far, now on]
    for line in template.split("\n"):
        m = re.fullmatch(r"\s*#\s*(IF|ELSE|ENDIF)\b(.*?)#?\s*", line)
        if not m:
            if all(on for _, on in stack):
                out.append(line)
        elif m[1] == "IF":
            parts = [p.strip() for p in m[2].split(" AND ")]
            on = all((p.lstrip("!") in flags) != p.startswith("!") for p in parts)
            stack.append((on, on))
        elif m[1] == "ELSE":
            taken, _ = stack.pop()
            stack.append((True, not taken))
        else:
            stack.pop()
    if stack:
        raise SparqlError("IF without ENDIF")
    text, depth = "\n".join(out), 0
    while re.search(r"%[A-Z][A-Z0-9_]*%", text) and depth < 10:
        text = re.sub(r"%([A-Z][A-Z0-9_]*)%", lambda m: values.get(m[1], ""), text)
        depth += 1
    return text
