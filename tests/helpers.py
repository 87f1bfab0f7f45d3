"""Comparison of tables with what SQL gives."""

import math


def shown(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)


def table(df):
    return as_set(df.columns, [tuple(r) for r in df.collect()])


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])
