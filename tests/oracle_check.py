"""Compare queries() with oracle_sql(): same columns, same rows, same values.

    python -m tests.oracle_check /root/testdata/sf0.01 [name ...]
"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def local_session(cpus=8):
    from pyspark.sql import SparkSession

    from lograil.session import configure
    spark = configure(SparkSession.builder.master(f"local[{cpus}]").appName("lograil")
                      .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                      .config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, folder, query, sql, con):
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(left[1]), None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = rows_of(columns, result.fetchall())
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
        return len(left[1]), (f"{len(left[1])} vs {len(right[1])} rows; columns {left[0]}\n    only spark {sorted(a)[:3]}"
                              f"\n    only oracle {sorted(b)[:3]}")
    return len(left[1]), None


def main(folder, names):
    import __spark_entry__ as entry
    spark, con = local_session(), connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            count, problem = compare(spark, folder, queries[name], oracles.get(name), con)
        except Exception as error:  # report and go on with the next query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            failed.append(name)
        kind = "ok  " if not problem else "FAIL"
        print(f"{kind} {name:26s} rows={count:7d} {time.time() - start:6.2f}s {'' if name in oracles else '(rows only)'} {problem or ''}",
              flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
