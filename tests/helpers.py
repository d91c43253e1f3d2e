"""Rows as comparable values, from Spark and from DuckDB."""


def plain(v):
    """A value as Python has it, for comparison across engines."""
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return float(v) if isinstance(v, float) else v


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())
