"""Semantic layer V01-V08: declared views compiled to DataFrame plans.

A :class:`SemanticView` names tables (by alias), the relationships from facts to
dimensions, dimensions, row-level facts and metrics.  :func:`query` turns a request
(metrics x dimensions x filters) into one plan per base fact:

* only the dimension tables a request touches are joined (join pruning, V03);
* each dimension is narrowed to its key plus the used columns before the join and
  broadcast only behind a row-count check;
* metrics of different facts are aggregated separately and the *aggregates* are
  combined on the requested dimensions by ``unionByName`` + one aggregation, a full
  outer combine in which NULL dimension values match (drill-across, V04);
  facts are never joined to each other, so there is no fan-out;
* a dimension not reachable from a metric's fact raises ``ValueError`` (V05);
* role-playing dimensions (one date table reached through different keys) resolve per
  fact (V06); names resolve through synonyms, case-insensitively (V07).

Expressions are Python callables over a resolver ``r(table, column) -> Column``; the
builder calls them once with a recording resolver to learn which tables they touch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Expr = Callable[["Resolver"], Column]


@dataclass(frozen=True)
class Table:
    alias: str
    source: str                 # key in the ``tables`` dict handed to query()
    primary_key: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""


@dataclass(frozen=True)
class Relationship:
    name: str
    fact: str                   # table alias holding the foreign key
    fact_key: str
    dim: str                    # table alias referenced (joined on its primary key)


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    column: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""


@dataclass(frozen=True)
class RowFact:
    name: str
    table: str
    column: str
    comment: str = ""


@dataclass(frozen=True)
class Metric:
    name: str
    table: str                  # base fact
    expr: Expr
    synonyms: tuple[str, ...] = ()
    comment: str = ""
    apart: bool = False         # its state holds values (a percentile): see query()


@dataclass(frozen=True)
class DerivedMetric:
    """A metric computed from other metrics after drill-across (may span facts)."""
    name: str
    inputs: tuple[str, ...]
    fn: Callable[[dict[str, Column]], Column]
    comment: str = ""


@dataclass
class SemanticView:
    name: str
    tables: Sequence[Table]
    relationships: Sequence[Relationship]
    dimensions: Sequence[Dimension]
    facts: Sequence[RowFact]
    metrics: Sequence[Metric]
    derived: Sequence[DerivedMetric] = ()
    comment: str = ""
    _index: dict = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self):
        self._tables = {t.alias.upper(): t for t in self.tables}
        for rel in self.relationships:
            if rel.fact.upper() not in self._tables or rel.dim.upper() not in self._tables:
                raise ValueError(f"{self.name}: relationship {rel.name} names an unknown table")
        self._dims = self._names(self.dimensions)
        self._metrics = self._names(self.metrics)
        self._derived = {d.name.upper(): d for d in self.derived}
        self._facts = self._names(self.facts)

    @staticmethod
    def _names(items) -> dict:
        out = {}
        for it in items:
            out[it.name.upper()] = it
            for s in getattr(it, "synonyms", ()):
                out.setdefault(s.upper(), it)
        return out

    def table(self, alias: str) -> Table:
        try:
            return self._tables[alias.upper()]
        except KeyError:
            raise ValueError(f"{self.name}: unknown table {alias}") from None

    def dimension(self, name: str) -> Dimension:
        key = name.upper()
        if key in self._dims:
            return self._dims[key]
        if key in self._facts:  # row-level facts may be used as group-by columns
            f = self._facts[key]
            return Dimension(f.name, f.table, f.column)
        raise ValueError(f"{self.name}: unknown dimension {name}")

    def metric(self, name: str):
        key = name.upper()
        if key in self._metrics:
            return self._metrics[key]
        if key in self._derived:
            return self._derived[key]
        raise ValueError(f"{self.name}: unknown metric {name}")

    def relationship(self, fact: str, dim: str) -> Relationship | None:
        for rel in self.relationships:
            if rel.fact.upper() == fact.upper() and rel.dim.upper() == dim.upper():
                return rel
        return None

    def describe(self) -> dict:
        """Metadata (comments and synonyms) for catalog or documentation use."""
        return {
            "view": self.name, "comment": self.comment,
            "dimensions": {d.name: {"table": d.table, "synonyms": d.synonyms, "comment": d.comment}
                           for d in self.dimensions},
            "metrics": {m.name: {"table": m.table, "synonyms": m.synonyms, "comment": m.comment}
                        for m in self.metrics},
        }


class Resolver:
    """Maps (table alias, column) to the column of the joined frame; records usage."""

    def __init__(self):
        self.used: dict[str, set[str]] = {}

    @staticmethod
    def name(table: str, column: str) -> str:
        return f"{table.upper()}__{column.lower()}"

    def __call__(self, table: str, column: str) -> Column:
        self.used.setdefault(table.upper(), set()).add(column.lower())
        return F.col(self.name(table, column))


def _refs(exprs: Sequence[Expr]) -> tuple[Resolver, list[Column]]:
    r = Resolver()
    cols = [e(r) for e in exprs]
    return r, cols


def _fact_frame(view: SemanticView, tables: dict[str, DataFrame], fact: str,
                used: dict[str, set[str]]) -> DataFrame:
    """Fact columns (+ join keys) with only the dimension tables that are used joined on."""
    fact_t = view.table(fact)
    joins = []
    for alias, cols in used.items():
        if alias == fact.upper():
            continue
        rel = view.relationship(fact, alias)
        if rel is None:
            raise ValueError(f"{view.name}: {alias} is not reachable from {fact}")
        joins.append((rel, view.table(alias), cols))
    # a star joins some dimensions to build the fact: take their columns from those joins
    known = tables.carries(fact_t.source) if hasattr(tables, "carries") else {}
    carried = {dim_t.source: {c: Resolver.name(dim_t.alias, c) for c in sorted(cols)} for rel, dim_t, cols in joins
               if known.get(dim_t.source) == rel.fact_key and dim_t.primary_key == rel.fact_key}
    joins = [j for j in joins if j[1].source not in carried]
    fact_cols = sorted(set(used.get(fact.upper(), set())) | {rel.fact_key.lower() for rel, _, _ in joins})
    src = tables.narrow(fact_t.source, fact_cols, carried) if known else tables[fact_t.source]
    df = src.select(*[F.col(c).alias(Resolver.name(fact, c)) for c in fact_cols], *[a for spec in carried.values() for a in spec.values()])
    for rel, dim_t, cols in sorted(joins, key=lambda j: j[0].name):
        pk = f"__pk_{dim_t.alias.upper()}"
        src = tables[dim_t.source]
        d = src.select(F.col(dim_t.primary_key).alias(pk),
                       *[F.col(c).alias(Resolver.name(dim_t.alias, c)) for c in sorted(cols)])
        df = df.join(d, F.col(Resolver.name(fact, rel.fact_key)) == F.col(pk), "left").drop(pk)
    return df


def resolve_request(view: SemanticView, metrics: Sequence[str], dimensions: Sequence[str]):
    dims = [view.dimension(d) for d in dimensions]
    base, derived = [], []
    for name in metrics:
        m = view.metric(name)
        (derived if isinstance(m, DerivedMetric) else base).append(m)
    for d in derived:
        for i in d.inputs:
            m = view.metric(i)
            if isinstance(m, DerivedMetric):
                raise ValueError("derived metrics may only use base metrics")
            if m not in base:
                base.append(m)
    return dims, base, derived


def query(view: SemanticView, tables: dict[str, DataFrame], metrics: Sequence[str] = (),
          dimensions: Sequence[str] = (), filters: Sequence[Expr] = (),
          order_by: Sequence[str | tuple[str, bool]] = (), limit: int | None = None,
          keep: Sequence[str] | None = None) -> DataFrame:
    """Compile a metrics x dimensions request to one DataFrame.

    ``filters`` are row-level predicates evaluated before aggregation, in every fact
    group (they may only touch tables reachable from each group's fact).
    ``order_by`` items are names or ``(name, descending)``; NULLs sort last.
    ``keep`` selects which metrics appear in the output (defaults to ``metrics``).

    Metrics ``apart`` are aggregated beside the others of their fact, over the same rows: next to a
    distinct count Spark would keep one state of theirs for every distinct value of every group.
    """
    dims, base, derived = resolve_request(view, metrics, dimensions)
    groups: dict[tuple[str, bool], list[Metric]] = {}
    for m in base:
        groups.setdefault((m.table.upper(), m.apart), []).append(m)
    if not groups:
        raise ValueError("at least one metric is required")

    dim_names = [d.name.upper() for d in dims]
    parts = []
    for (fact, _), ms in groups.items():
        r, dim_cols = _refs([(lambda rr, d=d: rr(d.table, d.column)) for d in dims])
        for m in base:  # the same rows for all groups of a fact, whatever they join
            if m.table.upper() == fact:
                m.expr(r)
        metric_cols = [m.expr(r) for m in ms]
        filter_cols = [f(r) for f in filters]
        df = _fact_frame(view, tables, fact, r.used)
        for fc in filter_cols:
            df = df.filter(fc)
        aggs = [c.alias(m.name.upper(), metadata={"comment": m.comment, "base_fact": m.table}) if m.comment
                else c.alias(m.name.upper()) for c, m in zip(metric_cols, ms)]
        if dims:
            part = df.groupBy(*[c.alias(n) for c, n in zip(dim_cols, dim_names)]).agg(*aggs)
        else:
            part = df.agg(*aggs)
        parts.append(part)

    out = combine_aggregates(parts, dim_names)

    if derived:
        env = {m.name.upper(): F.col(m.name.upper()) for m in base}
        out = out.select("*", *[d.fn(env).alias(d.name.upper()) for d in derived])
    wanted = [view.metric(m).name.upper() for m in (keep if keep is not None else metrics)]
    out = out.select(*dim_names, *wanted)
    if order_by:
        keys = []
        for o in order_by:
            name, desc = (o, False) if isinstance(o, str) else o
            c = F.col(name.upper())
            keys.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
        out = out.orderBy(*keys)
    if limit is not None:
        out = out.limit(limit)
    return out


def combine_aggregates(parts: list[DataFrame], dim_names: list[str]) -> DataFrame:
    """Drill-across: stack per-fact aggregates and take each metric from the fact that
    computed it, per dimension combination.

    Each part has one row per dimension combination and its own metric columns, so a
    ``unionByName`` followed by one aggregation on the dimensions (NULL keys group
    together, like ``<=>``) is a full outer combine without any join -- one shuffle of
    the (already small) aggregates, and no nested-loop plan when there are no dimensions.
    """
    if len(parts) == 1:
        return parts[0]
    metrics: list[str] = []
    for p in parts:
        metrics += [c for c in p.columns if c not in dim_names]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    aggs = [F.first(F.col(m), ignorenulls=True).alias(m) for m in metrics]
    return u.groupBy(*dim_names).agg(*aggs) if dim_names else u.agg(*aggs)


def _combine(a: DataFrame, b: DataFrame, dim_names: list[str]) -> DataFrame:
    return combine_aggregates([a, b], dim_names)


def flat(view: SemanticView, tables: dict[str, DataFrame], fact: str, columns: Sequence[str],
         filters: Sequence[Expr] = ()) -> DataFrame:
    """Row-level access — one fact joined to the dimensions the columns need."""
    dims = [view.dimension(c) for c in columns]
    r = Resolver()
    cols = [r(d.table, d.column).alias(d.name.upper()) for d in dims]
    fcols = [f(r) for f in filters]
    df = _fact_frame(view, tables, fact, r.used)
    for fc in fcols:
        df = df.filter(fc)
    return df.select(*cols)


def register_sql_view(view: SemanticView, tables, fact: str, name: str | None = None,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """V08 for SQL users: expose a view's row-level join (one fact + the dimensions its
    columns need) as a temporary view, e.g. ``SELECT customer_segment, COUNT(*) FROM
    sem_customer_behavior GROUP BY 1``.  Defaults to every dimension and row-level fact
    reachable from ``fact``."""
    if columns is None:
        reachable = {fact.upper()} | {r.dim.upper() for r in view.relationships if r.fact.upper() == fact.upper()}
        columns = [d.name for d in list(view.dimensions) + list(view.facts) if d.table.upper() in reachable]
    df = flat(view, tables, fact, columns)
    df.createOrReplaceTempView(name or view.name)
    return df
