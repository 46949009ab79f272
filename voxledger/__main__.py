"""python -m voxledger IDENTIFIER APP:PATH...: answers one scenario and prints its report. Exit 0 or 1."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or any(":" not in a for a in args[1:]):
        sys.stdout.write(f"{__doc__}\n")
        return 1
    from voxledger.plans import scenario
    from voxledger.session import local_session, ship

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    try:
        with scenario.answer(spark, args[0], [tuple(a.split(":", 1)) for a in args[1:]]) as found:
            text = scenario.report(found)
    except ValueError as e:
        sys.stdout.write(f"error: {e}\n")
        return 1
    sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
