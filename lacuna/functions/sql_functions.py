"""The library's bands and statistics as functions that SQL text may use. All are SQL functions, which Spark puts into the
plan in place; none runs Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LOG = "CASE WHEN {x} > 0 THEN {x} * ln(greatest({y}, 1e-12D)) ELSE 0D END"

#: Name, arguments, result and body of each.
FUNCTIONS: tuple[tuple[str, str, str, str], ...] = (
    (
        "line_at", "x DOUBLE, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN x <= xs[0] THEN ys[0] WHEN x >= xs[size(xs) - 1] THEN ys[size(ys) - 1] ELSE aggregate(sequence(1, size(xs) - 1), CAST(NULL AS DOUBLE), "
        "(a, i) -> CASE WHEN a IS NULL AND x <= xs[i] THEN ys[i - 1] + (x - xs[i - 1]) / (xs[i] - xs[i - 1]) * (ys[i] - ys[i - 1]) ELSE a END) END",
    ),
    ("winkler", "lower DOUBLE, upper DOUBLE, x DOUBLE, tau DOUBLE", "DOUBLE", "upper - lower + 2 / (1 - tau) * (greatest(lower - x, 0D) + greatest(x - upper, 0D))"),
    (
        "kupiec_lr", "misses BIGINT, n BIGINT, tau DOUBLE", "DOUBLE",
        "CASE WHEN n > 0 THEN greatest(2 * (" + _LOG.format(x="(n - misses)", y="1 - misses / n") + " + " + _LOG.format(x="misses", y="misses / n") + " - (n - misses) * ln(tau) - misses * ln(1 - tau)), 0D) END",
    ),
    (
        "bands_at", "point DOUBLE, unit DOUBLE, anchors ARRAY<DOUBLE>, qs ARRAY<DOUBLE>, asked ARRAY<DOUBLE>", "TABLE(tau DOUBLE, lower DOUBLE, upper DOUBLE)",
        "SELECT t.tau, point - {p}line_at(t.tau, anchors, qs) * unit, point + {p}line_at(t.tau, anchors, qs) * unit FROM explode(asked) AS t(tau)",
    ),
)


def register(spark: SparkSession, prefix: str = "lacuna_") -> list[str]:
    """Makes the functions known to a session, under a prefix, and gives their names. Made again they are the same.

    line_at: linear between points, flat beyond; winkler: a band's interval score; kupiec_lr: the coverage ratio of misses;
    bands_at, a table function: a row an asked coverage (after LATERAL), with quantiles between the anchors' by line_at.
    Null in gives null out, and a null list of coverages no rows.
    """
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body.replace('{p}', prefix)}")
    return [prefix + f[0] for f in FUNCTIONS]
