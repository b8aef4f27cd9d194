"""python -m rostrum {fixture | pipeline | sql "SELECT ..." | report FILE | inspect TABLE} [--root FOLDER]"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from rostrum import catalog, fixture, report, schema
from rostrum.operators import campaigns, extract, metrics
from rostrum.sources.tables import Tables


def pipeline(tables: Tables) -> dict[str, float]:
    """The stages over the sample docket, stored; returns its scores."""
    stages = fixture.run(tables.spark)
    tables.upsert("comments", stages["comments"].drop("truth"))
    dockets = stages["comments"].select("docket_id").distinct()
    tables.refresh("dedup", stages["dedup"], dockets)
    units = schema.units(stages["comments"], stages["dedup"].drop("docket_id"))
    tables.upsert("analysis", extract.extract(units))
    tables.upsert("responses", stages["responses"].drop("convention", "coverage"))
    links = stages["links"].join(stages["comments"].select("comment_id", "docket_id"), "comment_id").drop("place")
    tables.refresh("linkage", links, dockets)
    tables.log("pipeline", "done")
    return fixture.score(stages)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rostrum", description=__doc__)
    parser.add_argument("verb", choices=["fixture", "pipeline", "sql", "report", "inspect"])
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--root", default="rostrum-data")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rostrum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = Tables(spark, args.root)
    if args.verb == "fixture":
        tables.upsert("comments", fixture.build(spark).drop("truth"))
    elif args.verb == "pipeline":
        for name, value in pipeline(tables).items():
            print(f"{name}: {value}")
    elif args.verb == "sql":
        catalog.Catalog(spark, {t: tables.read(t) for t in schema.names()}).read(" ".join(args.rest)).show(100, False)
    elif args.verb == "inspect":
        tables.read(args.rest[0]).show(25)
    else:
        sections = {"Campaigns": campaigns.summary(tables.read("dedup")), "Stances": metrics.histogram(tables.read("analysis").join(tables.read("comments").select("comment_id", "docket_id"), "comment_id"), "stance")}
        Path(args.rest[0]).write_text(report.build("Docket report", sections), encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
