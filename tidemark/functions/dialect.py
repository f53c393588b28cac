"""Column expressions as SQL text. The same definition serves Spark (``F.expr``) and, where the dialects differ, DuckDB."""

from __future__ import annotations

import re
from dataclasses import dataclass

BY_SYMBOL = "PARTITION BY symbol ORDER BY ts"


def doubles(sql: str) -> str:
    """The same with every literal that has a point as a double; plain it would be a decimal, with a decimal's scale."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def rows(n: int) -> str:
    """The frame of the last n rows, this one included."""
    return f"({BY_SYMBOL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    """agg over the last n rows, NULL unless all n values are there."""
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {agg}({x}) OVER {rows(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY_SYMBOL})"


def div(a: str, b: str) -> str:
    """a / b, NULL where b is 0."""
    return f"(({a}) / nullif(({b}), 0))"


def log_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) > 0 AND ({b}) > 0 THEN ln(({a}) / ({b})) END"


def zscore(x: str, n: int) -> str:
    return div(f"{x} - ({full('avg', x, n)})", full("stddev_samp", x, n))


def slope(y: str, n: int) -> str:
    """Least-squares slope of y against its row number; the number is contiguous, so it may start anywhere."""
    return f"CASE WHEN count({y}) OVER {rows(n)} = {n} THEN regr_slope({y}, rn) OVER {rows(n)} END"


def clip(x: str, low: float | None = None, high: float | None = None) -> str:
    """x within bounds; NULL stays NULL, as least and greatest would turn it into a bound."""
    parts = [f"WHEN ({x}) < {low} THEN {low}"] * (low is not None) + [f"WHEN ({x}) > {high} THEN {high}"] * (high is not None)
    return f"CASE {' '.join(parts)} ELSE ({x}) END"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def share_positive(x: str) -> str:
    """Share of the symbols at one time whose x is above 0."""
    return f"avg(CASE WHEN {x} IS NOT NULL THEN {flag(f'{x} > 0')} END) OVER (PARTITION BY ts)"


def rank_share(x: str) -> str:
    """Average rank at one time, from 0 to 1; one symbol alone has 0.5."""
    n = f"count({x}) OVER (PARTITION BY ts)"
    r = f"(rank() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 0.5 ELSE ({r} - 1) / ({n} - 1) END"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def quantile(self, x: str, q: float, n: int) -> str:
        name = "percentile" if self.spark else "quantile_cont"
        return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {name}({x}, {q}) OVER {rows(n)} END"

    def filled(self, x: str) -> str:
        frame = f"({BY_SYMBOL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"last_value({x}) IGNORE NULLS OVER {frame}" if self.spark else f"last_value({x} IGNORE NULLS) OVER {frame}"

    def half_even(self, x: str) -> str:
        return f"rint({x})" if self.spark else f"round_even({x}, 0)"

    def function(self, name: str, body: str) -> str:
        return f"{name} -> {body}" if self.spark else f"lambda {name}: {body}"

    def first_found(self, items: str, most: str, body: str) -> str:
        """The first of the leading ``most`` items for which body (of x) is not NULL."""
        if self.spark:
            return f"try_element_at(filter(transform(slice({items}, 1, {most}), {self.function('x', body)}), {self.function('y', 'y IS NOT NULL')}), 1)"
        return f"list_filter(list_transform({items}[1:{most}], {self.function('x', body)}), {self.function('y', 'y IS NOT NULL')})[1]"

    def following(self, columns: list[str], n: int) -> str:
        """The next n rows as structs, in order."""
        frame = f"({BY_SYMBOL} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
        if self.spark:
            return f"collect_list(named_struct({', '.join(f"'{c}', {c}" for c in columns)})) OVER {frame}"
        return f"list({{{', '.join(f"'{c}': {c}" for c in columns)}}}) OVER {frame}"


SPARK, DUCKDB = Dialect(True), Dialect(False)
