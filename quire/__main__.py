"""Commands: python -m quire route|probe|evaluate|calibrate|view|worker.

Each reads and writes files or tables that Spark knows; the models that answer questions are a table of answers.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import evidence, policy, text
from quire.operators import evaluate, intake, pages
from quire.sources import files
from quire.streaming import jobs

#: Columns of a results file.
RESULTS = "id string, grp string, split string, gt array<string>, lane string, candidate string, path_p double, basis string, latency_ms long, cost_usd double, error string"
MANIFEST = "doc struct<name:string,sha256:string,kind:string,quarantine:string>, route_key string, pages array<struct<page:int,lane:string>>, segments array<struct<start:int,stop:int,lane:string,modifiers:array<string>>>"


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, content, kind, mime, quarantine, parent_sha, depth, sha of all documents in the files under paths."""
    found = files.scan(spark, paths).select(F.regexp_extract("name", r"([^/]+)$", 1).alias("name"), "content")
    return intake.expand(found).withColumn("sha", F.sha2("content", 256))


def measured(docs: DataFrame) -> DataFrame:
    """Pages of text documents with their measures and evidence; other kinds need probes that aren't here."""
    t = docs.filter("kind = 'text' and quarantine is null").select(F.col("sha").alias("doc_id"), F.col("name").alias("source"), F.lit("").alias("lang"), F.decode("content", "UTF-8").alias("text"))
    m = pages.measured(pages.explode_pages(t))
    reading = evidence.reads(text.guard(F.col("text")), F.when(F.col("chars") >= text.LEAST_LETTERS, F.lit(0.9)), F.lit(""))
    said = evidence.describe_text("Text", F.col("chars"), reading, F.col("cid_share"), F.col("odd_char_share"), F.col("short_token_share"), F.col("math_share"), text.dominant_script(text.script_shares(F.col("text"))), text.guard(F.col("text")))
    return m.withColumn("evidence", said)


def manifests(docs: DataFrame, route_key: str) -> DataFrame:
    """Manifests of documents that are decided by their kind: native formats and quarantine; the rest wait for their pages' answers."""
    lane = intake.fixed_lane(F.col("kind"), F.col("quarantine"))
    page: Column = F.array(F.struct(F.lit(0).alias("page"), lane.alias("lane")))
    run = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), lane.alias("lane"), F.array().cast("array<string>").alias("modifiers")))
    made = docs.filter(lane.isNotNull())
    return made.select(F.struct("name", F.col("sha").alias("sha256"), "kind", "quarantine").alias("doc"), F.lit(route_key).alias("route_key"), page.alias("pages"), run.alias("segments"))


def command_route(spark: SparkSession, a: argparse.Namespace) -> None:
    key = policy.digest_of({"review": a.review})
    made = manifests(documents(spark, a.paths), key)
    stem = F.regexp_replace("doc.name", r"\.[^.]*$", "")
    files.write_files(made.select(F.concat(stem, F.lit("-"), F.left("doc.sha256", F.lit(8)), F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("content")), a.out)


def command_probe(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in measured(documents(spark, [a.file])).filter(F.col("page") == a.page).drop("text").limit(1).toJSON().collect():
        print(r)


def command_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.json_lines(spark, a.results, RESULTS, a.limit).filter("error is null").withColumn("cost_micro", F.round(F.col("cost_usd") * 1_000_000).cast("long"))
    Path(a.out).write_text("\n".join(files.report(evaluate.metrics(rows, *by), name) for name, by in (("overall", ()), ("groups", ("grp",)), ("splits", ("split",)))))


def command_calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.json_lines(spark, a.results, RESULTS).filter("error is null")
    fitted_on = rows.filter(~F.col("split").eqNullSafe("holdout"))
    basis = evaluate.one_basis(fitted_on).first()
    if not basis["fits"]:
        raise SystemExit(f"results come from {basis['bases']} versions of answers; fit on one")
    made = evaluate.calibration(evaluate.curves(fitted_on), a.cost_ratio, fitted_on.select("basis").first()[0])
    if a.check:
        print(files.report(evaluate.outcome(rows, made["threshold"]), "all results"))
    Path(a.out).write_text(json.dumps(made, indent=2) + "\n")


def command_view(spark: SparkSession, a: argparse.Namespace) -> None:
    stored = files.manifests(spark, a.folder, MANIFEST, "route_key")
    total = F.greatest(F.size("pages"), F.lit(1))
    runs = F.transform("segments", lambda s: F.struct(s["lane"].alias("lane"), ((s["stop"] - s["start"] + 1) * 100.0 / total).alias("width")))
    lanes = F.array_join(F.array_sort(F.transform("pages", lambda p: p["lane"])), " ")
    Path(a.out).write_text(files.html_page(files.html_report(stored.select(F.col("doc.name").alias("name"), lanes.alias("lanes"), runs.alias("segments"))), "Documents"))


def command_worker(spark: SparkSession, a: argparse.Namespace) -> None:
    """Follows the job events of a folder and keeps the state of every job, until there is nothing new."""
    jobs.run_to_table(jobs.job_states(jobs.source(spark, a.folder)), "job_states", a.state, "update").show()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quire")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **arguments) -> None:
        sub = commands.add_parser(name)
        for k, options in arguments.items():
            sub.add_argument(k if options.pop("positional", False) else f"--{k.replace('_', '-')}", **options)
        sub.set_defaults(run=run)

    command("route", command_route, paths={"positional": True, "nargs": "+"}, out={"required": True}, review={"type": float, "default": 0.5})
    command("probe", command_probe, file={"positional": True}, page={"type": int, "default": 0})
    command("evaluate", command_evaluate, results={"positional": True, "nargs": "+"}, out={"required": True}, limit={"type": int})
    command("calibrate", command_calibrate, results={"positional": True, "nargs": "+"}, out={"required": True}, cost_ratio={"type": float, "default": 10.0}, check={"action": "store_true"})
    command("view", command_view, folder={"positional": True}, out={"required": True})
    command("worker", command_worker, folder={"positional": True}, state={"required": True})
    chosen = top.parse_args(argv)
    chosen.run(SparkSession.builder.getOrCreate(), chosen)


if __name__ == "__main__":
    main()
