"""Command line check: python tests/run_twins.py FOLDER [name-prefix ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare  # noqa: E402

from lorescope.plans.catalog import QUERIES, TWINS  # noqa: E402
from lorescope.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in TWINS:
                note = compare(df, TWINS[name], folder)
            else:
                rows = df.collect()
                note = "" if rows else "no rows"
                if not note:
                    print("   ", str(rows[0])[:200])
        except Exception as error:  # report every query, then fail at the end
            note = f"{type(error).__name__}: {str(error)[:900]}"
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    sys.exit(1 if failed else 0)
