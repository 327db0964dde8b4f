"""What tests share."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    """Rows in an order of their own, columns by name, floats to six digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def same(duck, df, sql):
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
