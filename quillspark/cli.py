"""python -m quillspark.cli: a run over landed inputs from the command line; exit status 0 if any paper succeeded."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from .operators import ledger
from .plans.export import document_files, member_files, write_files
from .plans.harvest import Inputs, harvest, report
from .session import build_session
from .sources import archives, tables


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="folder with versions/, citations/ and archives/")
    p.add_argument("--output", required=True, help="folder for ledger/, statistics/ and, with --export, papers/")
    p.add_argument("--prefix", default="2406")
    p.add_argument("--first", type=int, default=4361)
    p.add_argument("--last", type=int, default=9360)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--batch", type=int)
    p.add_argument("--resume", action="store_true")
    p.add_argument("--export", action="store_true")
    p.add_argument("--master")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = parse(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    log = logging.getLogger("quillspark")
    spark = build_session(a.master)
    ids = ledger.slice_ids(tables.key_range(spark, a.first, a.last, a.prefix), "base_id", a.start, a.batch)
    done = None
    if a.resume:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{a.output}/ledger")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            done = ledger.succeeded(spark.read.parquet(f"{a.output}/ledger"))
    files = archives.landed_archives(spark, f"{a.input}/archives")
    name = F.regexp_extract("path", r"([^/]+)\.tar\.gz$", 1)
    files = files.withColumns({"base_id": F.regexp_extract(name, r"^(.*)v\d+$", 1), "version": F.regexp_extract(name, r"v(\d+)$", 1).try_cast("int")}).where("version is not null")
    inputs = Inputs(ids, tables.paper_versions(spark, f"{a.input}/versions"), tables.citation_responses(spark, f"{a.input}/citations"), files)
    out = harvest(inputs, done)
    out.results.write.mode("append" if a.resume else "overwrite").parquet(f"{a.output}/ledger")
    results = spark.read.parquet(f"{a.output}/ledger")
    # A paper that was tried again counts by its best result.
    best = results.groupBy("base_id").agg(F.max_by(F.struct(*[c for c in results.columns if c != "base_id"]), F.col("success")).alias("r")).select("base_id", "r.*")
    if a.export:
        metadata, references = out.documents()
        for rows in (document_files(metadata, "metadata.json"), document_files(references, "references.json"), member_files(out.members)):
            log.info("wrote %d files", write_files(rows, f"{a.output}/papers").count())
    statistics = report(best)
    statistics.write.mode("overwrite").json(f"{a.output}/statistics")
    row = spark.read.json(f"{a.output}/statistics").first().asDict()
    for k, v in row.items():
        log.info("%s: %s", k, f"{v:.2f}" if isinstance(v, float) else v)
    return 0 if row["successful_papers"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
