"""Print the formatted physical plan of catalogued queries over a stored runs table.

    python tools/explain.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from duewatch.session import checkpoint_dir, get_session
    from duewatch.plans.catalog import Tables, load_all
    from duewatch.sources.fixtures import derive_runs
    from duewatch.sources.runs import write_runs
    spark = get_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    stored = f"{checkpoint_dir(spark).rstrip('/')}/explain-runs-{uuid.uuid4().hex[:8]}"
    write_runs(derive_runs(spark, a.sf), stored)
    cat = load_all()
    for n in a.names:
        print(f"===== {n}")
        cat[n].job(Tables(spark, a.sf, stored_runs=stored)).explain(a.mode)


if __name__ == "__main__":
    main()
