"""The query builder over DataFrames: selection, edges, aggregates, ordering and functional writes.

Every step is a lazy DataFrame transformation, so filters and projections reach the scan. Writes give the table's next
state and how many rows they touched; store.Snapshots makes such states durable, all tables of a change at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.schemas import EngineError, NotFound, NotSingular


@dataclass(frozen=True)
class Edge:
    """A foreign-key relation: child.fk refers to parent.pk."""

    name: str
    fk: str
    pk: str = "id"


@dataclass(frozen=True)
class Term:
    """An ordering term; by default nulls come as PostgreSQL has them: last ascending, first descending."""

    column: str
    desc: bool = False
    nulls_first: bool | None = None

    def order(self) -> Column:
        c = F.col(self.column)
        first = self.desc if self.nulls_first is None else self.nulls_first
        if self.desc:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


def asc(*columns: str) -> list[Term]:
    return [Term(c) for c in columns]


def desc(*columns: str) -> list[Term]:
    return [Term(c, desc=True) for c in columns]


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown column {missing[0]!r}")


@dataclass(frozen=True)
class Query:
    """An immutable query; every method gives a new one, so a copy is free."""

    table: DataFrame
    pk: str = "id"
    where_: tuple = ()
    terms: tuple = ()
    n: int | None = None
    skip: int = 0
    columns: tuple = ()
    unique_: bool | None = None
    traversed: bool = False
    interceptors: tuple = ()

    def where(self, *predicates: Column | Callable[[DataFrame], DataFrame]) -> Query:
        """ANDs predicates: columns, or functions of the DataFrame such as has_edge(...)."""
        return replace(self, where_=self.where_ + predicates)

    def order(self, *terms: Term | Sequence[Term]) -> Query:
        flat = [t for x in terms for t in (x if isinstance(x, (list, tuple)) else [x])]
        check_columns(self.table, [t.column for t in flat])
        return replace(self, terms=self.terms + tuple(flat))

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def unique(self, on: bool = True) -> Query:
        return replace(self, unique_=on)

    def select(self, *columns: str) -> Query:
        check_columns(self.table, columns)
        return replace(self, columns=tuple(columns))

    def intercept(self, fn: Callable[[DataFrame], DataFrame]) -> Query:
        """A function that the query's rows pass through first."""
        return replace(self, interceptors=(*self.interceptors, fn))

    def clone(self) -> Query:
        return replace(self)

    def _rows(self) -> DataFrame:
        df = self.table
        for fn in self.interceptors:
            df = fn(df)
        for p in self.where_:
            df = df.where(p) if isinstance(p, Column) else p(df)
        return df

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.terms:
            df = df.orderBy(*[t.order() for t in self.terms])
        if self.skip:
            df = df.offset(self.skip)
        return df if self.n is None else df.limit(self.n)

    def df(self) -> DataFrame:
        """The query's rows; chosen columns with the key added, as entity reads have it."""
        df = self._rows()
        if self.columns:
            df = df.select(*dict.fromkeys([*self.columns, self.pk, *[t.column for t in self.terms]]))
        if self.unique_ or (self.unique_ is None and self.traversed):
            df = df.distinct()
        df = self._cut(df)
        return df.select(*dict.fromkeys([*self.columns, self.pk])) if self.columns else df

    all = df

    def scan(self, *columns: str) -> DataFrame:
        """Chosen columns alone; distinct only where unique(True) asked for it."""
        check_columns(self.table, columns)
        df = self._rows()
        if self.unique_:
            order = [t.column for t in self.terms]
            df = df.select(*dict.fromkeys([*columns, *order])).distinct()
        return self._cut(df).select(*columns)

    def ids(self) -> DataFrame:
        df = self._rows()
        if self.unique_ or (self.unique_ is None and self.traversed):
            df = df.select(*dict.fromkeys([self.pk, *[t.column for t in self.terms]])).distinct()
        return self._cut(df).select(self.pk)

    def values(self, column: str) -> list:
        """A column's values, on the driver."""
        return [r[0] for r in self.scan(column).collect()]

    def value(self, column: str):
        got = self.limit(2).values(column) if self.n is None else self.values(column)
        if not got:
            raise NotFound(column)
        if len(got) > 1:
            raise NotSingular(column)
        return got[0]

    def first(self):
        rows = self.limit(1).df().collect()
        if not rows:
            raise NotFound()
        return rows[0]

    def only(self):
        """The one row: none and two are errors, and no more than two are read."""
        rows = self.limit(2).df().collect()
        if not rows:
            raise NotFound()
        if len(rows) > 1:
            raise NotSingular()
        return rows[0]

    def first_id(self):
        return self.first()[self.pk]

    def only_id(self):
        return self.only()[self.pk]

    def get(self, key):
        return self.where(F.col(self.pk) == key).only()

    def exist(self) -> bool:
        """Whether the query has a first row, its offset and limit included."""
        return not self._cut(self._rows()).isEmpty()

    def count(self) -> int:
        df = self._cut(self._rows()) if self.n is not None or self.skip else self._rows()
        if self.columns and self.unique_:
            return df.select(*self.columns).distinct().count()
        if self.unique_ or (self.unique_ is None and self.traversed):
            return df.select(self.pk).distinct().count()
        return df.count()

    def group_by(self, *columns: str, aggregates: Sequence[Column] = ()) -> DataFrame:
        """Groups the query's rows; no aggregates give the distinct groups."""
        check_columns(self.table, columns)
        grouped = self._cut(self._rows()).groupBy(*columns)
        return grouped.agg(*aggregates) if aggregates else self._cut(self._rows()).select(*columns).distinct()

    def aggregate(self, *aggregates: Column) -> DataFrame:
        return self._cut(self._rows()).agg(*aggregates)

    def traverse_to_children(self, children: DataFrame, edge: Edge, pk: str = "id") -> Query:
        """Children of the query's rows; a semi-join, so nothing has to be made distinct."""
        parents = self.df().select(F.col(edge.pk).alias("__pk"))
        return Query(children.join(parents, F.col(edge.fk) == F.col("__pk"), "left_semi"), pk)

    def traverse_to_parent(self, parents: DataFrame, edge: Edge, pk: str = "id") -> Query:
        fks = self.df().select(F.col(edge.fk).alias("__fk")) if not self.columns else self._cut(self._rows()).select(F.col(edge.fk).alias("__fk"))
        return Query(parents.join(fks, F.col(edge.pk) == F.col("__fk"), "left_semi"), pk)


def has_children(children: DataFrame, edge: Edge, *predicates: Column, negate: bool = False) -> Callable[[DataFrame], DataFrame]:
    """EXISTS over the children that meet the predicates; NOT EXISTS with negate."""

    def apply(df: DataFrame) -> DataFrame:
        side = children
        for p in predicates:
            side = side.where(p)
        side = side.select(F.col(edge.fk).alias("__fk"))
        return df.join(side, df[edge.pk] == side["__fk"], "left_anti" if negate else "left_semi")

    return apply


def has_parent(parents: DataFrame, edge: Edge, *predicates: Column, negate: bool = False) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        side = parents
        for p in predicates:
            side = side.where(p)
        side = side.select(F.col(edge.pk).alias("__pk"))
        return df.join(side, df[edge.fk] == side["__pk"], "left_anti" if negate else "left_semi")

    return apply


def with_parent(df: DataFrame, parents: DataFrame, edge: Edge, name: str | None = None) -> DataFrame:
    """df with its parent as a struct; null where there is none."""
    name = name or edge.name
    side = parents.select(F.col(edge.pk).alias("__pk"), F.struct(*parents.columns).alias(name))
    return df.join(side, df[edge.fk] == side["__pk"], "left").drop("__pk")


def with_children(df: DataFrame, children: DataFrame, edge: Edge, name: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df with its children as a sorted array of structs; an empty array where there are none.

    The array is the result, so its size is that of a parent's children; children are pruned to what they hold first.
    """
    name = name or edge.name
    first = list(order)
    fields = [*first, *[c for c in children.columns if c not in first]]
    lists = children.groupBy(F.col(edge.fk).alias("__fk")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__list"))
    back = F.transform("__list", lambda x: F.struct(*[x[c].alias(c) for c in children.columns]))
    empty = F.array().cast(f"array<{children.schema.simpleString()}>")
    met = df.join(lists, df[edge.pk] == lists["__fk"], "left")
    return met.select(*[df[c] for c in df.columns], F.coalesce(back, empty).alias(name))


def order_by_children_count(df: DataFrame, children: DataFrame, edge: Edge, desc: bool = False, tie: Sequence[str] = (), name: str = "n_children") -> DataFrame:
    counts = children.groupBy(F.col(edge.fk).alias("__fk")).agg(F.count("*").alias(name))
    met = df.join(counts, df[edge.pk] == counts["__fk"], "left").drop("__fk").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    key = F.col(name).desc() if desc else F.col(name).asc()
    return met.orderBy(key, *tie)


def order_by_children(df: DataFrame, children: DataFrame, edge: Edge, term: Column, desc: bool = False, tie: Sequence[str] = (), name: str = "child_term") -> DataFrame:
    """Orders parents by an aggregate of their children, such as max(field)."""
    agg = children.groupBy(F.col(edge.fk).alias("__fk")).agg(term.alias(name))
    met = df.join(agg, df[edge.pk] == agg["__fk"], "left").drop("__fk")
    return met.orderBy(Term(name, desc).order(), *tie)


def order_by_parent_field(df: DataFrame, parents: DataFrame, edge: Edge, field: str, desc: bool = False, tie: Sequence[str] = (), name: str | None = None) -> DataFrame:
    name = name or f"{edge.name}_{field}"
    side = parents.select(F.col(edge.pk).alias("__pk"), F.col(field).alias(name))
    return df.join(side, df[edge.fk] == side["__pk"], "left").drop("__pk").orderBy(Term(name, desc).order(), *tie)


# Aggregates by name, for group_by() and aggregate().
def count_rows() -> Column:
    return F.count(F.lit(1))


AGGREGATES = {"count": lambda _=None: count_rows(), "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}


def as_(aggregate: Column, name: str) -> Column:
    return aggregate.alias(name)


# Writes.


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """table with rows added; absent columns get their default, else null."""
    defaults = defaults or {}
    filled = rows
    for c in table.columns:
        if c not in filled.columns:
            filled = filled.withColumn(c, defaults.get(c, F.lit(None)))
        elif c in defaults:
            filled = filled.withColumn(c, F.coalesce(F.col(c), defaults[c]))
    if required and not filled.where(" or ".join(f"`{c}` is null" for c in required)).isEmpty():
        raise EngineError("VALIDATION", "missing required field")
    types = {f.name: f.dataType for f in table.schema.fields}
    return table.unionByName(filled.select(*[F.col(c).cast(types[c]).alias(c) for c in table.columns]))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], mode: str = "new_values", keep: Sequence[str] = ("id", "created_at"), set_: dict[str, Callable[[Column, Column], Column]] | None = None, first_by: Sequence[str] = ()) -> DataFrame:
    """table after inserting rows with conflicts on keys.

    mode new_values: matches take the new values but for the columns in keep; ignore and nothing: matches stay as they
    are; update: matches take set_[column](old, new) for the columns named there. Of rows that share a key the first by
    first_by counts (all columns in their order if none is given).
    """
    order = list(first_by) or list(rows.columns)
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__new")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__new")
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    if mode in ("ignore", "nothing"):
        have = table.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
        fresh = packed.join(have, [F.col(f"__k_{k}") == F.col(f"__h_{k}") for k in keys], "left_anti").select("__new.*")
        return table.unionByName(fresh.select(*table.columns))
    met = table.select(F.struct(*table.columns).alias("__old"), *keys).join(packed, on, "full")
    out = []
    for c in table.columns:
        old, new = F.col("__old")[c], F.col("__new")[c]
        if mode == "update":
            matched = set_[c](old, new) if set_ and c in set_ else old
        else:
            matched = old if c in keep or c in keys else new
        out.append(F.when(F.col("__old").isNull(), new).when(F.col("__new").isNull(), old).otherwise(matched).alias(c))
    return met.select(*out)


def upserted(before: DataFrame, after: DataFrame, rows: DataFrame, keys: Sequence[str], pk: str = "id") -> DataFrame:
    """keys, pk and __new for each of rows, as `after` has them: pk is the row's that was there where there was one."""
    asked = rows.select(*keys).distinct()
    had = before.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(True).alias("__had"))
    met = after.select(*keys, pk).join(asked, list(keys), "left_semi")
    met = met.join(had, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left")
    return met.select(*keys, pk, F.col("__had").isNull().alias("__new"))


def update(table: DataFrame, predicate: Column, changes: dict[str, Column]) -> DataFrame:
    """table with changes where predicate is true, and a column __changed for counting; see changed() and settled()."""
    hit = F.coalesce(predicate, F.lit(False))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    check_columns(table, list(changes))
    return table.select(*[(F.when(hit, changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in table.columns], hit.alias("__changed"))


def changed(updated: DataFrame) -> int:
    return updated.where("__changed").count()


def settled(updated: DataFrame) -> DataFrame:
    return updated.drop("__changed")


def update_one(table: DataFrame, key, changes: dict[str, Column], pk: str = "id", where: Column | None = None) -> DataFrame:
    out = update(table, (F.col(pk) == key) & (F.lit(True) if where is None else where), changes)
    if out.where("__changed").isEmpty():
        raise NotFound(str(key))
    return settled(out)


def add(name: str, amount) -> Column:
    return F.col(name) + amount


def clear() -> Column:
    return F.lit(None)


def append(name: str, values: Sequence) -> Column:
    """An array column with values after what it holds; a null array counts as empty."""
    new = F.array(*[F.lit(v) for v in values])
    return F.concat(F.coalesce(F.col(name), F.slice(new, 1, 0)), new)


def delete(table: DataFrame, predicate: Column) -> DataFrame:
    """The rows that stay: a null predicate keeps its row."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def delete_one(table: DataFrame, key, pk: str = "id") -> DataFrame:
    if table.where(F.col(pk) == key).isEmpty():
        raise NotFound(str(key))
    return delete(table, F.col(pk) == key)


def cascade(children: DataFrame, parents: DataFrame, edge: Edge) -> DataFrame:
    """The children whose parent is still there."""
    left = parents.select(F.col(edge.pk).alias("__pk"))
    return children.join(left, F.col(edge.fk) == F.col("__pk"), "left_semi")


def set_parent(children: DataFrame, predicate: Column, edge: Edge, parent) -> DataFrame:
    """Edge mutation: the children that meet predicate get a parent, or none."""
    return settled(update(children, predicate, {edge.fk: F.lit(parent)}))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often: a unique constraint's violations."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# Hooks around mutations: functions of (operation, table, go on) -> table.
Hook = Callable[[str, DataFrame, Callable[[str, DataFrame], DataFrame]], DataFrame]


def chain(*hooks: Hook) -> Hook:
    """One hook that runs hooks in order, the first outermost."""

    def run(op: str, df: DataFrame, go: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        call = go
        for h in reversed(hooks):
            call = (lambda h, nxt: lambda o, d: h(o, d, nxt))(h, call)
        return call(op, df)

    return run


def on(hook: Hook, *ops: str) -> Hook:
    return lambda op, df, go: hook(op, df, go) if op in ops else go(op, df)


def unless(hook: Hook, *ops: str) -> Hook:
    return lambda op, df, go: go(op, df) if op in ops else hook(op, df, go)


#: A condition of a hook: (operation, table) -> whether it holds.
Condition = Callable[[str, DataFrame], bool]


def has_op(*ops: str) -> Condition:
    return lambda op, df: op in ops


def has_fields(*names: str) -> Condition:
    """Whether the mutation's rows have all these columns."""
    return lambda op, df: all(n in df.columns for n in names)


def all_of(*conditions: Condition) -> Condition:
    return lambda op, df: all(c(op, df) for c in conditions)


def any_of(*conditions: Condition) -> Condition:
    return lambda op, df: any(c(op, df) for c in conditions)


def not_(condition: Condition) -> Condition:
    return lambda op, df: not condition(op, df)


def if_(hook: Hook, condition: Condition) -> Hook:
    return lambda op, df, go: hook(op, df, go) if condition(op, df) else go(op, df)


def reject(*ops: str) -> Hook:
    def run(op: str, df: DataFrame, go):
        if op in ops:
            raise EngineError("REJECTED", f"{op} is not allowed")
        return go(op, df)

    return run
