"""python -m factorloom --root DIR import 100k|1m PATH | wipe | train | recommend LOGIN [--limit N] | status | serve [--port N]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .plans.serve import serve
from .schema import Options


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factorloom", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--options", default="{}", help="engine options as JSON")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("import")
    x.add_argument("kind", choices=["100k", "1m"])
    x.add_argument("path")
    for name in ("wipe", "train", "status"):
        sub.add_parser(name)
    x = sub.add_parser("recommend")
    x.add_argument("login")
    x.add_argument("--limit", type=int)
    x = sub.add_parser("serve")
    x.add_argument("--port", type=int, default=8080)
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.root, Options().merged(json.loads(a.options)))
    if a.command == "import":
        print(json.dumps(engine.import_movielens(a.kind, a.path)))
    elif a.command == "wipe":
        engine.wipe()
    elif a.command == "train":
        print(json.dumps(engine.train()))
    elif a.command == "recommend":
        print(json.dumps(engine.recommend(login=a.login, limit=a.limit)))
    elif a.command == "status":
        print(engine.status)
    else:
        serve(engine, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
