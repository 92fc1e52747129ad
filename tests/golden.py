"""Rows of the queries that have no SQL, on the smallest tables.

``python -m tests.golden`` prints them anew; a change has to be looked at, row by row where need be.
"""

from __future__ import annotations

import hashlib
import json
import os

from tests.oracle import plain

PATH = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden.json")
EXPECTED: dict[str, list] = json.load(open(PATH)) if os.path.exists(PATH) else {}


def digest(frame) -> list:
    """Columns, number of rows, and a digest of the values whatever the order of rows."""
    columns = sorted(frame.columns)
    rows = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    return [columns, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]]


def main() -> None:
    from retrix.plans.catalogue import ORACLE, QUERIES
    from retrix.session import session

    spark = session("golden", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: digest(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in sorted(set(QUERIES) - set(ORACLE))}
    with open(PATH, "w") as out:
        out.write("{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in found.items()) + "\n}\n")


if __name__ == "__main__":
    main()
