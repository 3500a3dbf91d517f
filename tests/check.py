"""python tests/check.py SF [prefix ...]: compare queries with their SQL on one scale."""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from scenelake.session import local_session  # noqa: E402
from tests.harness import NOTES, compare  # noqa: E402

if __name__ == "__main__":
    sf, wanted = f"/root/testdata/sf{sys.argv[1]}", tuple(sys.argv[2:])
    spark = local_session(app="check")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in queries().items():
        if wanted and not name.startswith(wanted):
            continue
        try:
            err, took, n = compare(spark, name, fn, oracle_sql().get(name), sf)
        except Exception as e:
            err, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += err is not None
        print(f"{'ok ' if err is None else 'BAD'} {took:6.2f}s {n:7d} {name}{'' if name in oracle_sql() else ' (rows only)'}{'' if err is None else '  ' + err} {NOTES.get(name) or ''}", flush=True)
    print("bad", bad)
