"""What several test modules use: the folder of the small tables, rows as plain tuples."""

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
