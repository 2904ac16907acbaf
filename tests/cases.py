"""Cases on literal rows: a function of the session, and the rows that it must give, as DuckDB SQL without tables."""

CASES: dict = {}


def case(sql: str):
    def add(f):
        CASES[f.__name__] = f, sql
        return f

    return add
