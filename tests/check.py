"""Command line: python tests/check.py [sf_dir] [query ...]"""

import os
import sys
import tempfile
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from compare import compare, connect  # noqa: E402

import loomwright.catalog as catalog  # noqa: E402
from loomwright.session import build_session  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    catalog.load_all()
    picked = [n for n in catalog.QUERIES if not args or any(a == n or catalog.QUERIES[n].__module__.endswith("." + a) for a in args)]
    spark = build_session("check", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in picked:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf)
            built = time.time() - start
            sql = catalog.ORACLES.get(name)
            problems = compare(df, con, sql) if sql else []
            note = "" if sql else f" rows-only {df.count()}"
        except Exception as error:
            problems, note, built = [f"{type(error).__name__}: {str(error)[:600]}"], "", 0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.2f}s (build {built:.2f}){note}", *problems, flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    spark.stop()
