"""Summarise the physical plan of every registered query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

For each query the plan is executed once (noop sink) so AQE settles, then the
final plan is scanned for shuffles, join strategies, windows and scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiframe.session import get_session  # noqa: E402

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dedupe_subqueries(plan: str) -> str:
    """Keep one copy of each distinct subquery block: every reference to a
    scalar subquery is printed with its full plan, but AQE runs identical
    subqueries once and reuses the result."""
    lines = plan.split("\n")
    out, seen, i = [], set(), 0
    while i < len(lines):
        line = lines[i]
        m = re.search(r"[:+]- Subquery subquery#", line)
        if not m:
            out.append(line)
            i += 1
            continue
        indent = m.start()
        j = i + 1
        # children are indented deeper: "<indent>:  ..." or "<indent>   ..."
        while j < len(lines) and lines[j][indent:indent + 3] in (":  ", "   "):
            j += 1
        block = " ".join(ln[indent:] for ln in lines[i:j])
        key = re.sub(r"#\d+L?|\[id=#\d+\]|plan_id=\d+", "", block)
        key = re.sub(r"\s+", " ", key)
        if key not in seen:
            seen.add(key)
            out.extend(lines[i:j])
        i = j
    return "\n".join(out)


def summarise(plan: str) -> dict:
    main = dedupe_subqueries(plan)
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                   r"Exchange SinglePartition|Exchange RoundRobin", main)),
        "broadcasts": main.count("BroadcastExchange"),
        "smj": main.count("SortMergeJoin"),
        "bhj": main.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", main)),
        "aggregates": main.count("HashAggregate("),
        "scans": len(re.findall(r"FileScan \w+ \[", main)),
        "forbidden": [f for f in FORBIDDEN if f in main],
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from kpiframe.plans.catalog import REGISTRY

    spark = get_session("local[8]", 8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` after one execution (AQE final "
          "plans). Identical scalar-subquery plans are counted once: AQE runs them once and "
          "reuses the result for every reference. `shuffles` counts every "
          "Exchange (hash, range, single-partition for global aggregates).\n")
    print("| key | shuffles | broadcasts | SMJ | BHJ | windows | hash aggs | scans | forbidden |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for key, fn in REGISTRY.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(plan_of(df))
        print(f"| {key} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | "
              f"{s['windows']} | {s['aggregates']} | {s['scans']} | "
              f"{', '.join(s['forbidden']) or '-'} |")
    spark.stop()


if __name__ == "__main__":
    main()
