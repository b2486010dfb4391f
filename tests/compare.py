"""Side-by-side run of a registered query in Spark and of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "NULL" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def family(name: str) -> str:
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "int"
    if name in ("varchar", "string"):
        return "string"
    return name.split("(")[0]


def spark_rows(df):
    cols = sorted(df.columns)
    types = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    return cols, [types[c] for c in cols], rows


def sql_rows(con, sql: str):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    cols = [rel.columns[i] for i in order]
    types = [family(str(rel.types[i])) for i in order]
    return cols, types, sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())


def difference(spark_side, sql_side) -> str | None:
    """Null when both sides agree, else a short account of the first difference."""
    for what, a, b in zip(("columns", "types"), spark_side[:2], sql_side[:2]):
        if a != b:
            return f"{what}: {a} / {b}"
    if spark_side[2] == sql_side[2]:
        return None
    a, b = set(spark_side[2]), set(sql_side[2])
    only_a, only_b = sorted(a - b)[:1], sorted(b - a)[:1]
    return (
        f"rows {len(spark_side[2])} / {len(sql_side[2])}, only here {len(a - b)} / {len(b - a)}: "
        f"{str(only_a)[:700]}  //  {str(only_b)[:700]}"
    )
