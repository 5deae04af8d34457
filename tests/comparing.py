"""Comparison of results, for tests."""

DATA = "/root/testdata/sf0.001"


def rows(frame):
    """Rows of a Spark frame or a DuckDB relation, columns by name, in an order of their own."""
    if hasattr(frame, "collect"):
        names = sorted(frame.columns)
        found = [tuple(r[n] for n in names) for r in frame.collect()]
    else:
        names = sorted(frame.columns)
        at = [frame.columns.index(n) for n in names]
        found = [tuple(r[i] for i in at) for r in frame.fetchall()]
    return names, sorted(found, key=repr)
