"""Small column, aggregation and join helpers.

Operators with many similar columns write them as SQL text, which goes to the
JVM in one call per DataFrame step instead of several per column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.names import quote


def col(name: str) -> Column:
    return F.col(quote(name))


def cols(names: Sequence[str]) -> list[str]:
    """The names, quoted, as ``select``, ``groupBy`` and windows take them."""
    return [quote(n) for n in names]


def finite(name: str) -> str:
    """SQL: a number that is neither null, NaN nor infinite.

    NaN sorts above infinity in Spark, so one comparison covers both.
    """
    return f"coalesce(abs({quote(name)}) < double('Infinity'), false)"


def window(by: Sequence[str], order: Sequence[str], descending: bool = False) -> str:
    """SQL: an OVER clause."""
    partition = f"PARTITION BY {', '.join(cols(by))} " if by else ""
    direction = " DESC" if descending else ""
    return f"OVER ({partition}ORDER BY {', '.join(c + direction for c in cols(order))})"


def aggregate(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Group by ``by`` with SQL aggregates by name; one row in all without ``by``."""
    packed = ", ".join(f"{sql} AS {quote(name)}" for name, sql in values.items())
    grouped = df.groupBy(*cols(by)).agg(F.expr(f"struct({packed}) AS __values"))
    return grouped.select(*cols(by), "__values.*")


def stacked(df: DataFrame, keep: Sequence[str], rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """For each row the ``keep`` columns with each of ``rows``, SQL values by name."""
    structs = ", ".join(
        "struct(" + ", ".join(f"{sql} AS {quote(name)}" for name, sql in row.items()) + ")"
        for row in rows
    )
    return df.selectExpr(*cols(keep), f"inline(array({structs}))")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match, keeping the left key columns."""
    renamed = right.selectExpr(
        *[f"{quote(c)} AS {quote('__r_' + c)}" if c in on else quote(c) for c in right.columns]
    )
    condition = F.expr(" AND ".join(f"{quote(c)} <=> {quote('__r_' + c)}" for c in on))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{c}" for c in on])


def join_back(
    rows: DataFrame, by: Sequence[str], summary: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Join ``summary(rows)``, which has one row per ``by`` group, to the rows.

    An equi-join needs non-null keys on its summary side only, and Spark then
    filters that side alone; the two sides no longer match, and everything
    below is computed twice. So rows with null keys go round the join (they
    belong to no group and get nulls), and both sides of it share one exchange.
    """
    if not by:
        return rows.crossJoin(summary(rows))
    nullable = [f.name for f in rows.schema.fields if f.name in by and f.nullable]
    has_keys = " AND ".join(f"{quote(c)} IS NOT NULL" for c in nullable)
    keyed = rows.filter(has_keys) if nullable else rows
    groups = summary(keyed)
    added = [c for c in groups.columns if c not in by]
    joined = keyed.join(groups, list(by), "left").select(*cols([*rows.columns, *added]))
    if not nullable:
        return joined
    rest = rows.filter(f"NOT ({has_keys})")
    return joined.unionByName(rest, allowMissingColumns=True)
