"""Commands over the editorial memory: python -m skeinwork.app --memory FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skeinwork.operators.delivery import review_report
from skeinwork.operators.memory import Memory, configured, manual_examples, writer_examples


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skeinwork")
    p.add_argument("--memory", required=True, help="folder of the table of examples")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init")
    for name in ("rules", "presets"):
        c.add_parser(name).add_argument("file")
    add = c.add_parser("add")
    for name in ("kind", "title", "feedback"):
        add.add_argument(name)
    add.add_argument("--tag", action="append", default=[])
    add.add_argument("--rule", action="append", default=[])
    quick = c.add_parser("quick-add")
    for name in ("presets", "preset", "title"):
        quick.add_argument(name)
    listed = c.add_parser("list")
    listed.add_argument("--kind")
    listed.add_argument("--status")
    c.add_parser("summarise")
    for name in ("import-writer", "import-manual"):
        c.add_parser(name).add_argument("file")
    review = c.add_parser("review")
    review.add_argument("week")
    review.add_argument("stories", help="Parquet of title, source_id, score, sent, place")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command in ("rules", "presets"):
        for row in configured(a.file, a.command):
            print(row.get("id"), row.get("title") or row.get("text") or "")
        return 0
    spark = spark or SparkSession.builder.appName("memory").getOrCreate()
    memory = Memory(spark, a.memory)
    if a.command == "init":
        memory.table.write(memory.examples())
    elif a.command == "add":
        memory.add_one(a.kind, a.title, a.feedback, a.tag, a.rule).show(truncate=False)
    elif a.command == "quick-add":
        preset = next((p for p in configured(a.presets, "presets") if p.get("id") == a.preset), None)
        if preset is None:
            print(f"no preset {a.preset}")
            return 1
        memory.add_one(preset["kind"], a.title, preset["feedback"], preset.get("tags", ()), preset.get("rule_ids", ())).show(truncate=False)
    elif a.command == "list":
        memory.listed(a.kind, a.status).select("kind", "status", "title", "feedback").show(truncate=60)
    elif a.command == "summarise":
        for df in memory.summary().values():
            df.show(truncate=False)
    elif a.command == "import-writer":
        print(memory.add(writer_examples(spark, a.file, {})).count())
    elif a.command == "import-manual":
        print(memory.add(manual_examples(spark, a.file)).count())
    else:
        examples = memory.examples().selectExpr("title", "feedback", "kind", "row_number() over (order by at, id) AS place")
        for row in review_report(a.week, spark.read.parquet(a.stories), examples).orderBy("line").collect():
            print(row["text"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
