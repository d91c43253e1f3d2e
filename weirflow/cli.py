"""``python -m weirflow.cli``: validate, list, create, benchmark, version."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

VERSION = "0.1.0"

TEMPLATE = """batch_size = 32

[source]
type = "file"
path = "data.parquet"
dense = "id"

[[stages]]
type = "sql"
x = "x / 255"
"""


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weirflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "benchmark"):
        sub.add_parser(name).add_argument("config")
    sub.add_parser("list").add_argument("kind", nargs="?")
    sub.add_parser("create").add_argument("path")
    sub.add_parser("version")
    a = p.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "create":
        if Path(a.path).exists():
            print(f"{a.path} exists", file=sys.stderr)
            return 1
        Path(a.path).write_text(TEMPLATE)
        return 0

    from weirflow.plans import components, config

    if a.command == "list":
        for n in config.REGISTRY.names(a.kind):
            print(json.dumps(config.REGISTRY.info(n)))
        return 0
    try:
        c = config.from_environment(config.load(a.config), "WEIRFLOW")
        config.PIPELINE.validate(c)
        for s in [{**c["source"], "_": "source"}, *({**s, "_": "operator"} for s in c.get("stages", []))]:
            config.REGISTRY.get(f"{s['_']}.{s['type']}")
    except (ValueError, KeyError, OSError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1
    if a.command == "benchmark":
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("weirflow").getOrCreate()
        start = time.perf_counter()
        built = components.build(spark, c)
        built.rows().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        print(json.dumps({"rows": len(built.source), "seconds": round(took, 3), "rows_per_second": round(len(built.source) / took)}))
    else:
        print("valid")
    return 0


if __name__ == "__main__":
    sys.exit(main())
