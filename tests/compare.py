"""Compare a registered query with its SQL on the same files."""

import json
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple, dict)):
        return json.dumps(v, default=str, sort_keys=True)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    return (*table([d[0] for d in cur.description], cur.fetchall()), types)


def family(t):
    t = t.lower()
    for name, words in {
        "int": ("bigint", "int", "long", "short", "hugeint", "number"),
        "float": ("double", "float"),
        "time": ("timestamp", "datetime"),
        "bool": ("bool",),
        "text": ("string", "varchar"),
        "date": ("date",),
    }.items():
        if any(t.startswith(w) for w in words):
            return name
    return t


def difference(df, con, sql):
    """None when equal, else a short description."""
    want_cols, want, types = sql_rows(con, sql)
    got_cols, got = spark_rows(df)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = {c: (mine[c], types[c]) for c in mine if family(mine[c]) != family(types[c])}
    if bad or any("hugeint" in t.lower() or "decimal" in t.lower() for t in types.values()):
        return f"types {bad or types}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; extra {sorted(set(got) - set(want))[:2]} missing {sorted(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a}\n  != {b}"
    return None
