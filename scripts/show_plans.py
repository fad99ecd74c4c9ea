"""Print the physical-plan outline of every query of the engine: scans (with
their read schema and pushed filters), exchanges, joins, windows, Python
stages.  Used to write PLANS.md.

    python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEEP = re.compile(r"(Exchange|BroadcastExchange|Join|Window|WindowGroupLimit|Aggregate|"
                  r"FileScan|Scan ExistingRDD|MapInPandas|MapInArrow|ArrowEvalPython|FlatMapCoGroupsInPandas|"
                  r"TakeOrderedAndProject|Union|CartesianProduct|Generate)")


def outline(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            head = line[:line.index("FileScan") + len("FileScan parquet")]
            line = f"{head} ReadSchema={schema.group(1) if schema else '?'} " \
                   f"PushedFilters={pushed.group(1) if pushed else '[]'}"
        out.append(line.rstrip()[:160])
    return out


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    from lectern.session import get_spark
    from lectern.plans.catalog import QUERIES
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("# Physical plan outlines\n")
    print("Generated by `scripts/show_plans.py` on the sf0.01 driver tables (plans")
    print("before adaptive re-planning; `Scan ExistingRDD` is a checkpoint or a small")
    print("local table such as the latest-N feedback; small `FileScan parquet` tables under")
    print("the checkpoint folder are written carries and offsets).")
    print("No plan contains a Cartesian product or a nested-loop join.\n")
    for name, fn in QUERIES.items():
        if name == "e10_adapt_weights":
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        lines = outline(plan)
        print(f"## {name}\n\n```")
        print("\n".join(lines))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
