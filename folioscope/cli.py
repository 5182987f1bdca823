"""Commands: run all analyses or one, list them, verify that they run, convert pages.

    python -m folioscope run --docs DIR [--config FILE] [--module 03] --out DIR
    python -m folioscope list
    python -m folioscope verify [--docs DIR]
    python -m folioscope ingest --pages FILE --out DIR

Folders and files may be wherever Spark reads and writes.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .operators import ingest, rollup
from .plans import modules
from .session import build_session
from .sources import corpus, sinks

OWN_FOLDER = "data/documents"
#: Names the folder of sample documents, and of the configuration.
SAMPLES, CONFIG = "FOLIOSCOPE_SAMPLES", "FOLIOSCOPE_CONFIG"


def inputs_of(spark: SparkSession, folder: str, config: str | None) -> modules.Inputs:
    if config is None:
        bands = spark.createDataFrame([], "topic string, dept string, expected_min int, expected_max int")
        register = spark.createDataFrame([], "canonical string, current string, topic string, outdated array<string>")
        return modules.Inputs(corpus.load_documents(spark, folder).cache(), bands, register)
    settings = corpus.load_config(spark, config).cache()
    docs = corpus.load_documents(spark, folder, corpus.departments(settings)).cache()
    return modules.Inputs(docs, corpus.coverage_bands(settings), corpus.regulations(settings), corpus.duplicate_groups(settings))


def chosen(number: str | None) -> list[str]:
    """All analyses, or those with this number."""
    return [m for m in modules.MODULES if number is None or m[1:3] == number.zfill(2)]


def write_result(result: modules.Result, out: str) -> None:
    """Tables as CSV and JSON, what is said of documents as JSON and a Markdown card each."""
    for name, table in {"table": result.table, **result.more}.items():
        sinks.write_json(table, f"{out}/{result.module}/{name}.json")
        sinks.write_csv(table, f"{out}/{result.module}/{name}.csv")
    if result.findings is not None:
        sinks.write_json(result.findings, f"{out}/{result.module}/findings.json")
    if result.per_doc is not None:
        sinks.write_json(result.per_doc, f"{out}/{result.module}/documents.json")
        cards = result.per_doc.select("sop_id", sinks.markdown_card(F.concat("sop_id", F.lit(": "), "status"), F.col("findings")).alias("text"))
        sinks.write_text(cards, f"{out}/{result.module}/cards", by="sop_id")


def run(spark: SparkSession, folder: str, out: str, config: str | None = None, number: str | None = None) -> int:
    """0 if all analyses ran, 2 if one failed, 1 if there was nothing to do."""
    if not corpus.has_documents(spark, folder):
        print(f"No documents (*.md) found under {folder}.")
        return 1
    names = chosen(number)
    if not names:
        print(f"No analysis has the number {number}. There are: {', '.join(modules.MODULES)}")
        return 1
    inputs = inputs_of(spark, folder, config)
    facts = corpus.statistics(inputs.docs).first()
    print(f"{facts['documents']} documents ({facts['english']} English) of {facts['departments']} departments, {len(names)} analyses")
    done: dict[str, modules.Result] = {}
    for name, result in modules.run(inputs, names).items():
        error = result.error
        if error is None:
            try:
                write_result(result, out)
                done[name] = result
            except Exception as e:  # one analysis must not stop the others
                error = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"  {name}: {error or 'ok'}")
    told = modules.per_document(done)
    if told is not None:
        told = with_saved(spark, told, out)
        sinks.write_json(told, f"{out}/results.json")
        told = spark.read.json(f"{out}/results.json")
        sinks.write_text(sinks.dossiers(told, inputs.docs).select("sop_id", "text"), f"{out}/dossiers", by="sop_id")
        sinks.write_text(sinks.dashboard(told), f"{out}/dashboard")
        sinks.write_csv(rollup.worst_status(told), f"{out}/statuses.csv")
    return 0 if len(done) == len(names) else 2


def with_saved(spark: SparkSession, fresh: DataFrame, out: str) -> DataFrame:
    """Fresh results, and those that an earlier run left of other analyses."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/results.json")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return fresh
    saved = spark.read.schema("module string, sop_id string, status string, findings array<string>").json(f"{out}/results.json")
    return cut_lineage(rollup.merged(fresh, saved))  # what is read is written over


def verify(spark: SparkSession, folder: str, config: str | None = None) -> int:
    if not corpus.has_documents(spark, folder):
        print(f"No documents (*.md) found under {folder}.")
        return 1
    found = modules.verify(inputs_of(spark, folder, config))
    for name, state in found.items():
        print(f"  {name}: {state}")
    return int(any(state != "ok" for state in found.values()))


def convert(spark: SparkSession, pages: str, out: str) -> int:
    """Page texts (doc, page, text; Parquet) as documents with a report and totals."""
    found = ingest.convert(spark.read.parquet(pages)).cache()
    sinks.write_text(found.filter("file is not null").select("sop_id", F.col("file").alias("text")), f"{out}/documents", by="sop_id")
    sinks.write_json(found.drop("file", "body"), f"{out}/report.json")
    sums = ingest.totals(found)
    sinks.write_json(sums, f"{out}/totals.json")
    print(sums.first().asDict())
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "verify"):
        one = commands.add_parser(name)
        one.add_argument("--docs", help=f"folder of documents; else {OWN_FOLDER} if it has any, else the folder that {SAMPLES} names")
        one.add_argument("--config", default=os.environ.get(CONFIG), help="JSON with departments, bands, the register and groups")
        if name == "run":
            one.add_argument("--module", help="only the analysis of this number")
            one.add_argument("--out", default="output")
    commands.add_parser("list")
    pages = commands.add_parser("ingest")
    pages.add_argument("--pages", required=True)
    pages.add_argument("--out", required=True)
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(modules.MODULES))
        return 0
    spark = spark or build_session()
    if given.command == "ingest":
        return convert(spark, given.pages, given.out)
    folder = corpus.choose_folder(spark, given.docs, OWN_FOLDER, os.environ.get(SAMPLES, OWN_FOLDER))
    return run(spark, folder, given.out, given.config, given.module) if given.command == "run" else verify(spark, folder, given.config)
