"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf_dir] [name-prefix...]``."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from scorelake.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = get_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        begun = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                types = "; ".join(f"{a} {b}" for a, b in _types(df, con, sqls[name]))
            else:
                problem, types = (None if df.count() else "no rows"), "rows only"
        except Exception as e:  # noqa: BLE001
            problem, types = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - begun:.1f}s {types} {problem or ''}", flush=True)
    print("bad:", bad)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _types(df, con, sql):
    wanted = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, f"{t}!={wanted.get(n)}") for n, t in df.dtypes if KIND.get(t, t) != wanted.get(n)]


if __name__ == "__main__":
    main()
