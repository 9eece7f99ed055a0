"""``python -m millrace.cli run JOB.json`` and ``check JOB.json``. Exit: 0 done, 1 failed, 2 plan or config, 3 budget, 4 read or write, 5 resume, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from .errors import BudgetError, ConfigError, IoError, PlanError, ResumeError
from .plans.document import from_document, options
from .session import local

CODES = [(PlanError, 2), (ConfigError, 2), (BudgetError, 3), (IoError, 4), (ResumeError, 5)]


def _argument(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    try:
        return name, json.loads(value)
    except ValueError:
        return name, value


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["run", "check", "explain"])
    p.add_argument("job")
    p.add_argument("--cores", type=int, default=8)
    p.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE", help="a run argument; the value is read as JSON, else as text")
    a = p.parse_args(args)
    try:
        text = Path(a.job).read_text()
        job, ordered = from_document(text)
        given = dict(_argument(x) for x in a.arg)
        spark = local(a.cores)
        if a.command == "check":
            job.check(spark)
            print("ok")
        elif a.command == "explain":
            print(job.explain(spark))
        else:
            print(json.dumps(asdict(job.run(spark, ordered=ordered, **options(text), **given)), default=str))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return next((code for kind, code in CODES if isinstance(e, kind)), 1)


if __name__ == "__main__":
    sys.exit(main())
