"""``python tests/check_queries.py FOLDER [NAME-PREFIX ...]``: every query against its check."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from palimpsest.session import build_session  # noqa: E402


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in sorted(entry.queries().items()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start, clock = time.time(), []
        try:
            df = fn(spark, folder)
            if name in oracle:
                bad = compare(df, con, oracle[name], clock)
                n = ""
            else:
                n, bad = f" rows={df.count()}", []
        except Exception as e:  # report and go on
            bad = [f"{type(e).__name__}: {str(e)[:900]}"]
            if "-v" in wanted:
                traceback.print_exc()
        failed += bool(bad)
        kind = "ok  " if not bad else "FAIL"
        print(f"{kind} {name} spark {(clock or [time.time()])[0] - start:.1f}s all {time.time() - start:.1f}s{'' if name in oracle else ' (rows only)' + n}", flush=True)
        for b in bad:
            print("     ", b, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
