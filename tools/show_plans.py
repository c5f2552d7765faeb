"""Print the formatted physical plan of registered queries (default: the
bench headline jobs) at an sf directory:

    python tools/show_plans.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from quarry.plans.catalog import QUERIES  # noqa: E402
from quarry.session import local_session  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    for n in a.names or HEADLINE:
        print(f"===== {n}")
        QUERIES[n](spark, a.sf).explain("formatted")


if __name__ == "__main__":
    main()
