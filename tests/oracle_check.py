"""Compare registered queries with their checking SQL: python tests/oracle_check.py [sf] [id ...]."""
from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(map(repr, (r[c] for c in cols))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    problems = []
    if sorted(d[0] for d in desc) != cols:
        return [f"columns {cols} vs {sorted(d[0] for d in desc)}"]
    want = Counter(tuple(map(repr, r)) for r in con.execute(
        f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    types = {d[0]: d[1] for d in desc}
    for f in df.schema:
        if TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) != types[f.name]:
            problems.append(f"type {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}; {cols}; only Spark {extra}; only SQL {missing}")
    elif not got:
        problems.append("no rows")
    return problems


def main() -> int:
    from drawmark.session import local_session, tune
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = tune(local_session(8)), connect(sf_dir)
    fns, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(fns)
    bad = 0
    for name in [n for n in fns if n in wanted or any(w.endswith("*") and n.startswith(w[:-1]) for w in wanted)]:
        started = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, name, fns[name], sqls[name], sf_dir)
            else:
                n = fns[name](spark, sf_dir).count()
                problems = [] if n else ["no rows"]
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        took = time.time() - started
        if problems:
            bad += 1
            print(f"FAIL {name} {took:.1f}s", *problems, sep="\n     ", flush=True)
        else:
            print(f"ok   {name} {took:.1f}s", flush=True)
    print(f"{len(fns)} queries, {bad} with problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
