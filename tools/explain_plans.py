"""Run registered queries and print their final adaptive plans (``explain("formatted")``).

    python tools/explain_plans.py /root/testdata/sf0.1 select_round0_docs leak_free_lines > plans.txt

Each query is collected first (through the same DataFrame, so its own adaptive
plan runs) and the printed plan is the final one chosen by AQE, with
broadcast / skew decisions resolved.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusforge.plans.registry import REGISTRY  # noqa: E402
from corpusforge.session import get_spark  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["select_round0_docs"]
    spark = get_spark("local[4]", shuffle_partitions=8)
    for name in names:
        df = REGISTRY[name](spark, sf_dir)
        n = len(df.collect())
        print(f"===== {name} ({n} rows)")
        df.explain("formatted")


if __name__ == "__main__":
    main()
