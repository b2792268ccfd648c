"""Write the physical plan of each headline query to docs/plans/<name>.txt.

The plan is taken after execution (AQE's final plan: chosen join strategies,
coalesced partitions, reused exchanges).
usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from kestrel.plans.registry import all_queries  # noqa: E402
from kestrel.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16, extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out_dir = os.path.join(ROOT, "docs", "plans")
    qs = all_queries()
    for name in HEADLINE:
        if name.startswith("stream") or name == "load_validate":
            continue
        df = qs[name](spark, sf_dir)
        df.collect()  # run it, so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as fh:
            fh.write(f"# {name} at {os.path.basename(sf_dir)} (final adaptive plan)\n\n{plan}\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
