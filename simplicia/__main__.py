"""Command line: python -m simplicia VERB ...

Every verb of judged pairs takes ``-c``, a YAML file of settings; what the
command line leaves out is taken from it, and ``--out`` with it replaces the
settings' output folder.  Without settings ``--out`` is the verb's own output.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.operators import complexes, hodge, judges, pairs, reports, sampling, spectral, triplets
from simplicia.sources import readers, writers
from simplicia.tables import ranked, written


def _archives(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.npz_triples(spark, *a.input)


def _classes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(code, id, label) of the classes in the archives, by the class index if there is one."""
    names = _archives(spark, a).select(F.explode(F.array("f0", "f1", "f2")).alias("name"))
    return readers.class_ids(names, readers.class_index(spark, a.labels) if a.labels else None)


def _triangles(spark: SparkSession, a: argparse.Namespace, seen: Observation | None = None) -> DataFrame:
    if a.format == "csv":
        return readers.triangle_csv(spark, a.input[0])
    if a.format == "npz":
        return triplets.soft_triangles(readers.classed_triples(_archives(spark, a), _classes(spark, a)), temperature=a.temperature)
    if a.format == "slates":
        slates = readers.slate_text(spark, *a.input)
        if seen is not None:
            slates = slates.observe(seen, *(c.alias(name) for name, c in triplets.slate_counters(a.max_slate).items()))
        return triplets.triangles(triplets.slate_counts(slates, max_slate=a.max_slate), clamp=False, min_total=a.min_total)
    read = readers.triplet_text if a.format == "triplets" else readers.judgement_tsv
    return triplets.triangles(triplets.canonical_counts(read(spark, a.input[0])), min_total=a.min_total)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Triangles as CSV; of sessions it also says how many were too short or too long."""
    seen = Observation() if a.format == "slates" else None
    tri = written(_triangles(spark, a, seen), "triangles")
    if seen is not None:
        print("sessions {n_sessions}, too short {n_short}, too long {n_long}, longest {longest}".format(**seen.get))
    print(f"triangles {tri.count()}")
    writers.triangle_csv(tri, a.out, slim=True)


def decompose(spark: SparkSession, a: argparse.Namespace) -> None:
    tri = written(_triangles(spark, a), "triangles")
    triplets.violations(tri).show()
    edges, nodes = complexes.edges(tri), complexes.nodes(tri, C.SOFT if a.soft or a.format == "npz" else C.HARD)
    complexes.ranges(tri, "agreement", "total_count").show()
    s1, _ = hodge.edge_projection(tri)
    s1 = written(s1, "s1")
    writers.edge_csv(tri, edges, f"{a.out}/edge_index")
    writers.projection_csv(tri, s1, f"{a.out}/s1_star")
    writers.matrix_market(tri, f"{a.out}/D2")
    writers.matrix_table(tri, f"{a.out}/D2.parquet")
    writers.graph_json(tri, edges, nodes, s1, f"{a.out}/graph", gzip=True)
    fractions = written(hodge.triangle_fractions(tri), "fractions")
    fractions.show(truncate=False)
    labels = None
    if a.format == "npz":
        labels = complexes.dense_labels(_classes(spark, a).select("id", "label"))
        writers.concept_list(labels, f"{a.out}/concepts")
    elif a.labels:
        labels = complexes.dense_labels(readers.class_index(spark, a.labels).select("id", "label"))
        writers.concept_list(labels, f"{a.out}/concepts")
    places = spectral.layout(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), rounds=a.layout) if a.layout else None
    nodes = complexes.placed(nodes, labels, places)
    meta = complexes.meta(tri, fractions, a.format)
    for end in ("", ".gz"):
        writers.payload(tri, edges, nodes, complexes.tetrahedra(tri), s1, meta, f"{a.out}/payload.json{end}", gzip=bool(end))


def _settled(a: argparse.Namespace) -> readers.RunConfig:
    """The settings, and with a file of them the paths that the command line left out."""
    if not a.config:
        missing = [f"--{n}" for n in a.needs if getattr(a, n) is None]
        if missing:
            raise SystemExit(f"{a.verb} needs {', '.join(missing)} or -c")
        return readers.RunConfig()
    config = readers.run_config(a.config)
    folder = a.out or str(config.out_dir)
    paths = {"pairs": f"{folder}/pairs.parquet", "log": f"{folder}/{config.jsonl_name}", "labels": str(config.crowd_csv), "scores": str(config.gt_csv)}
    for name in a.needs:
        if name in paths and getattr(a, name) is None:
            setattr(a, name, paths[name])
    a.out = {"pairs": paths["pairs"], "sync": f"{folder}/{config.parquet_name}"}.get(a.verb, folder)
    return config


def make_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Once made, a pair list is used again."""
    config = _settled(a)
    source, selection, n, seed = a.source or config.pair_source, a.selection, a.n, config.run_seed if a.config else 0
    if a.config:
        # settings that name another selection than "connected" mean a sample, over gaps or plain
        selection = selection or (config.selection if config.selection == "connected" else "stratified" if config.stratify_by_gap else "uniform")
        n = config.n_pairs if n is None else n
    labels, scores = readers.label_csv(spark, a.labels), readers.score_csv(spark, a.scores)
    every = pairs.build_pairs(labels, scores)
    if source == "clique":
        items, keep = a.items or config.clique_faces, config.clique_keep_frac if a.keep is None else a.keep
        every = pairs.build_pairs(pairs.clique_pairs(sampling.clique_items(every, items), labels, keep=keep), scores)
    elif n and selection in (None, "connected"):
        every = sampling.connected(every, n, seed=seed)
    elif n and selection == "stratified":
        every = sampling.stratified(every, n, seed=seed)
    else:
        every = sampling.uniform(every, n or None, seed=seed)
    every.write.mode("ignore").parquet(a.out)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Judge open tasks and append the records to the log; a log with torn lines is written anew first."""
    config = _settled(a)
    provider = "mock" if a.mock else config.provider
    todo = pairs.tasks(spark.read.parquet(a.pairs), swap_repeat=config.swap_repeat)
    done = 0
    try:
        readers.repair_log(spark, a.log)
        log = readers.judgement_log(spark, a.log)
        done = log.agg(F.coalesce(F.max("row"), F.lit(0))).first()[0]
        todo = pairs.open_tasks(todo, log, retry_errors=a.retry_errors)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if a.limit:
        todo = todo.orderBy("pair_id", "presentation").limit(a.limit)
    todo = written(ranked(todo, ["pair_id", "presentation"], "place"), "tasks").withColumn("row", F.col("place") + done + 1).drop("place")
    errors = None
    if a.items:
        todo, errors = judges.without_items(todo, spark.read.text(a.items).select(F.trim("value").alias("item")))
    if a.workers:
        todo = todo.repartition(a.workers)
    # the mock answers in the JVM; any other judge is asked row by row in the tasks
    answered = pairs.mock_answers(todo, seed=config.run_seed) if provider == "mock" else judges.judged(todo, lambda: judges.make_judge(provider))
    if errors is not None:
        answered = answered.unionByName(errors, allowMissingColumns=True)
    records = pairs.records(answered).withColumns({"model_name": F.lit(config.model_name), "quantization": C.quantization(F.lit(config.model_name)), "backend": F.lit(provider), "timestamp_iso": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
    writers.append_log(written(records, "records"), a.log)


def sync(spark: SparkSession, a: argparse.Namespace) -> None:
    _settled(a)
    writers.snapshot(readers.judgement_log(spark, a.log), a.out)


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    _settled(a)
    reports.status(readers.judgement_log(spark, a.log)).show()


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    _settled(a)
    log = written(readers.judgement_log(spark, a.log), "log")
    summary = reports.summary(log, generated=datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")).orderBy("place").drop("place")
    for report in (reports.accuracy(log), reports.accuracy_by_gap(log), reports.order_consistency(log), summary):
        report.show(truncate=False)
    found = written(reports.analysis(log), "analysis")
    found.select("hodge", "harmonic_defined", "n_triangles").show(truncate=False)
    if a.out:
        writers.one_json(found, f"{a.out}/analysis.json")
        writers.summary_csv(summary, f"{a.out}/summary.csv")


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files against a manifest of lines ``sha256  name``; fails if one differs."""
    lines = spark.read.text(a.manifest).where(F.col("value").rlike(r"\S")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    found = readers.verified(spark, a.files, lines.select(F.col("p")[1].alias("name"), F.col("p")[0].alias("sha256")))
    found.show(truncate=False)
    if not found.where("NOT ok").isEmpty():
        raise SystemExit("files differ from the manifest")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="simplicia")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, f in (("convert", convert), ("decompose", decompose)):
        v = verbs.add_parser(name)
        v.set_defaults(run=f)
        v.add_argument("input", nargs="+")
        v.add_argument("--format", choices=["triplets", "tsv", "slates", "csv", "npz"], default="slates")
        v.add_argument("--max-slate", type=int)
        v.add_argument("--min-total", type=int, default=1)
        v.add_argument("--soft", action="store_true")
        v.add_argument("--temperature", type=float, default=1.0, help="of the softmax over the similarities of archives")
        v.add_argument("--labels", help="class index, for labels of nodes")
        v.add_argument("--layout", type=int, default=0, help="rounds of the layout of nodes; 0 for none")
        v.add_argument("--out", required=True)
    settings = argparse.ArgumentParser(add_help=False)
    settings.add_argument("-c", "--config", help="YAML settings")
    settings.add_argument("--out", help="the verb's output; with settings, their output folder")
    v = verbs.add_parser("pairs", parents=[settings])
    v.set_defaults(run=make_pairs, needs=("labels", "scores", "out"))
    v.add_argument("--labels")
    v.add_argument("--scores")
    v.add_argument("--source", choices=["human_judged", "clique"])
    v.add_argument("--selection", choices=["connected", "stratified", "uniform"])
    v.add_argument("--n", type=int)
    v.add_argument("--items", type=int, default=0)
    v.add_argument("--keep", type=float)
    v = verbs.add_parser("run", parents=[settings])
    v.set_defaults(run=run, needs=("pairs", "log"))
    v.add_argument("--pairs")
    v.add_argument("--log")
    v.add_argument("--limit", type=int, default=0)
    v.add_argument("--retry-errors", action="store_true")
    v.add_argument("--mock", action="store_true", help="the mock judge, whatever the settings say")
    v.add_argument("--workers", type=int, default=0, help="judges at a time")
    v.add_argument("--items", help="names of the items that are there, a line each; tasks of others become errors")
    for name, f in (("sync", sync), ("status", status), ("analyze", analyze)):
        v = verbs.add_parser(name, parents=[settings])
        v.set_defaults(run=f, needs=("log", "out") if name == "sync" else ("log",))
        v.add_argument("--log")
    v = verbs.add_parser("verify")
    v.set_defaults(run=verify)
    v.add_argument("--manifest", required=True)
    v.add_argument("--files", required=True)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
