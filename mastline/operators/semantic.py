"""Named dimensions and metrics over one table, queried by name."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Dimension:
    """A grouping column: a base column or an expression over base columns and variables."""

    name: str
    expr: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""
    is_time: bool = False
    enum_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Metric:
    """An aggregate over base columns, or with ``over`` a formula on other metrics."""

    name: str
    expr: str
    synonyms: tuple[str, ...] = ()
    comment: str = ""
    over: tuple[str, ...] = ()


@dataclass(frozen=True)
class Variable:
    name: str
    default: Any
    comment: str = ""


@dataclass(frozen=True)
class SemanticView:
    name: str
    alias: str
    key: tuple[str, ...]
    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]
    variables: tuple[Variable, ...] = ()
    synonyms: tuple[str, ...] = ()
    comment: str = ""
    _index: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        names = [x.name for x in (*self.dimensions, *self.metrics)]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a dimension or metric name occurs twice")
        known = {m.name for m in self.metrics}
        for metric in self.metrics:
            if not set(metric.over) <= known:
                raise ValueError(f"{metric.name} is derived from unknown metrics")
        for kind, items in (("dimension", self.dimensions), ("metric", self.metrics)):
            for item in items:
                self._index[kind, item.name.lower()] = item
            for item in items:
                for synonym in item.synonyms:
                    self._index.setdefault((kind, synonym.lower()), item)

    def resolve(self, kind: str, name: str) -> Dimension | Metric:
        """A dimension or metric by name, ``alias.name`` or synonym, in any case."""
        plain = name.strip().lower().removeprefix(f"{self.alias.lower()}.")
        if (kind, plain) not in self._index:
            have = sorted({item.name for (k, _), item in self._index.items() if k == kind})
            raise ValueError(f"{self.name} has no {kind} {name!r}; it has {have}")
        return self._index[kind, plain]

    def query(
        self,
        df: DataFrame,
        dimensions: Sequence[str] = (),
        metrics: Sequence[str] = (),
        *,
        variables: Mapping[str, Any] | None = None,
        where: str | Column | None = None,
        order_by: Sequence[str | Column] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Group by dimensions and compute metrics; the other clauses see the output columns.

        All names are checked before any work is planned.
        """
        dims = self._pick("dimension", dimensions)
        wanted = self._pick("metric", metrics)
        if not dims and not wanted:
            raise ValueError("ask for at least one dimension or metric")
        bound = self._bind(variables or {})
        grouped = df.withColumns(bound) if bound else df
        keys = [F.expr(dim.expr).alias(f"_dim_{dim.name}") for dim in dims]
        grouped = grouped.select("*", *keys).groupBy(*[f"_dim_{dim.name}" for dim in dims])
        plan = self._with_dependencies(wanted)
        direct = [m for m in plan if not m.over]
        # a result without metrics lists the dimension values that occur
        result = grouped.agg(
            *([F.expr(m.expr).alias(m.name) for m in direct] or [F.count("*").alias("_rows")])
        ).withColumnsRenamed({f"_dim_{dim.name}": dim.name for dim in dims})
        for metric in plan:
            if metric.over:
                result = result.withColumn(metric.name, F.expr(metric.expr))
        result = result.select(*[x.name for x in (*dims, *wanted)])
        if where is not None:
            result = result.filter(where)
        if order_by:
            result = result.orderBy(*[_ordering(term) for term in order_by])
        return result if limit is None else result.limit(limit)

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row per part of the view."""
        rows = [("view", self.name, None, self.synonyms, self.comment, None, None, ())]
        rows += [("key", k, None, (), "", None, None, ()) for k in self.key]
        rows += [
            ("variable", v.name, None, (), v.comment, str(v.default), None, ())
            for v in self.variables
        ]
        rows += [
            ("dimension", d.name, d.expr, d.synonyms, d.comment, None, d.is_time, d.enum_values)
            for d in self.dimensions
        ]
        rows += [
            ("derived metric" if m.over else "metric", m.name, m.expr, m.synonyms, m.comment,
             None, None, ())
            for m in self.metrics
        ]
        return spark.createDataFrame(
            [(k, n, e, list(s), c, d, t, list(v)) for k, n, e, s, c, d, t, v in rows],
            "kind string, name string, expr string, synonyms array<string>, comment string,"
            " default_value string, is_time boolean, enum_values array<string>",
        )

    def _pick(self, kind: str, names: Sequence[str]) -> list:
        return list(dict.fromkeys(self.resolve(kind, name) for name in names))

    def _bind(self, given: Mapping[str, Any]) -> dict[str, Column]:
        known = {v.name: v.default for v in self.variables}
        unknown = set(given) - set(known)
        if unknown:
            raise ValueError(f"{self.name} has no variable {sorted(unknown)}")
        return {name: F.lit(value) for name, value in {**known, **given}.items()}

    def _with_dependencies(self, wanted: Sequence[Metric]) -> list[Metric]:
        """Wanted metrics and what they are derived from, dependencies first."""
        ordered: dict[str, Metric] = {}

        def add(metric: Metric, above: tuple[str, ...]) -> None:
            if metric.name in above:
                raise ValueError(f"metric {metric.name} is derived from itself")
            for name in metric.over:
                add(self.resolve("metric", name), (*above, metric.name))
            ordered.setdefault(metric.name, metric)

        for metric in wanted:
            add(metric, ())
        return list(ordered.values())


def _ordering(term: str | Column) -> Column:
    """``name``, ``name ASC`` or ``name DESC``; unknown values come last either way."""
    if isinstance(term, Column):
        return term
    name, _, direction = term.strip().partition(" ")
    direction = direction.strip().upper() or "ASC"
    if direction not in ("ASC", "DESC"):
        raise ValueError(f"order by {term!r}: use ASC or DESC")
    column = F.col(name)
    return column.desc_nulls_last() if direction == "DESC" else column.asc_nulls_last()


def parse_names(text: str) -> list[str]:
    """Names from a comma-separated list."""
    return [name.strip() for name in text.split(",") if name.strip()]


def ask(
    view: SemanticView,
    df: DataFrame,
    dimensions: str,
    metrics: str,
    where: str = "",
    order_by: str = "",
    limit: int = 24,
) -> DataFrame:
    """The analyst's form of a query: plain text in, 24 rows unless told otherwise."""
    return view.query(
        df,
        parse_names(dimensions),
        parse_names(metrics),
        where=where or None,
        order_by=parse_names(order_by),
        limit=limit,
    )


# Network usage per cell-hour. unique_subscribers adds up per-cell numbers, so a
# subscriber seen in two cells counts twice, on purpose.
NETWORK_USAGE = SemanticView(
    name="network_usage",
    alias="usage",
    key=("event_hour", "cell_id", "rat"),
    synonyms=("cell usage", "network usage", "hourly usage"),
    comment="Hourly usage per cell and radio technology, from current records",
    variables=(
        Variable(
            "late_threshold_records", 1, "very late records that make a cell-hour provisional"
        ),
    ),
    dimensions=(
        Dimension("event_hour", "event_hour", comment="hour of the sessions", is_time=True),
        Dimension("cell", "cell_id", ("cell", "site", "cell id"), "serving cell"),
        Dimension(
            "radio", "rat", ("RAT", "technology"), "radio technology", enum_values=("4G", "5G")
        ),
        Dimension(
            "reliability",
            "CASE WHEN very_late_records >= late_threshold_records"
            " THEN 'PROVISIONAL' ELSE 'SETTLED' END",
            comment="whether late roaming records may still change the hour",
        ),
    ),
    metrics=(
        Metric("sessions", "sum(sessions)", comment="session count"),
        Metric("unique_subscribers", "sum(uniq_subs)", comment="sum of per-cell subscribers"),
        Metric(
            "data_gb",
            "CAST(sum(bytes_dl + bytes_ul) AS DOUBLE) / 1073741824.0D",
            comment="data volume in units of 2^30 bytes",
        ),
        Metric("revenue", "sum(revenue)", comment="rated revenue"),
        Metric(
            "gb_per_session",
            "try_divide(data_gb, sessions)",
            comment="average volume of a session",
            over=("data_gb", "sessions"),
        ),
    ),
)
