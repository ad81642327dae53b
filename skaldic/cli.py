"""Command lines: evaluate, rescore, outputs, repair, publish, fetch and sweep.

``python -m skaldic.cli COMMAND --help`` lists a command's flags. Paths may be
on any file system that Spark resolves. Commands return an exit code.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import naming, text as T
from .operators import backends, board, outputs, scoring
from .sources import archives, readers, schemas, storage, weights, writers


def session() -> SparkSession:
    return SparkSession.builder.appName("skaldic").getOrCreate()


def fail(message: str) -> int:
    print(f"ERROR: {message}", file=sys.stderr)
    return 1


def normaliser_flags(p: argparse.ArgumentParser, form: str) -> None:
    p.add_argument("--unicode-form", default=form, choices=T.FORMS)
    p.add_argument("--number-words", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--filler-words", action="store_true")


def config_of(args) -> scoring.Config:
    return scoring.Config(args.unicode_form, args.number_words, args.filler_words)


def result_rows(rates: DataFrame, meta: DataFrame, speed: DataFrame | None = None) -> DataFrame:
    """Results of models from their published rates (slug, dataset, wer, cer) and their runs' metadata."""
    wide = scoring.wide_results(rates.withColumnRenamed("slug", "model")).withColumnRenamed("model", "slug")
    wide = wide.withColumns({f"mean_{m}": scoring.row_mean([f"{c}_{m}" for c in schemas.CORE_COLUMNS]) for m in ("wer", "cer")})
    known = readers.attach_runs(wide, meta)
    if speed is not None:
        known = known.drop("speed_x").join(speed, "slug", "left")
    return known.withColumnRenamed("model_link", "model").select("slug", "model_name", *schemas.RESULT_COLUMNS)


# --- evaluate


def evaluate_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--model", required=True)
    p.add_argument("--model-id", default="", help="name for results, if not the model's")
    p.add_argument("--backend", required=True, choices=backends.known_backends())
    p.add_argument("--params-b", type=float)
    p.add_argument("--access", default="open", choices=("open", "proprietary"))
    p.add_argument("--batch-size", type=int, default=16)
    p.add_argument("--device", default="cuda", choices=("cuda", "cpu"))
    p.add_argument("--datasets", default=",".join(row[0] for row in schemas.DATASETS))
    p.add_argument("--max-samples", type=int, default=0, help="cap a data set; 0 is all")
    p.add_argument("--source-dir", default="sources", help="one Parquet table a data set, by selector")
    p.add_argument("--audio-cache-dir", default="eval_audio_cache")
    p.add_argument("--out-dir", default="results")
    p.add_argument("--outputs-dir", default="outputs", help="raw outputs for later scoring; empty saves none")
    normaliser_flags(p, "NFC")


def source_of(args, selector: str) -> str:
    corpus = os.environ.get("CV_DATA_DIR", "")
    if selector == "cv17" and corpus:
        return f"{corpus}/test/test_manifest.jsonl"
    return f"{args.source_dir}/{selector}"


def evaluate(spark: SparkSession, args) -> int:
    try:
        chosen = schemas.resolve_selectors(args.datasets)
    except ValueError as e:
        return fail(str(e))
    params = backends.default_params_b(args.backend, args.params_b)
    if params is None and storage.exists(spark, args.model):
        params = weights.params_b(spark, args.model)
    if params is None:
        return fail("the parameter count is unknown; pass --params-b")

    def loader(selector: str, column: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            rows = readers.load_dataset(spark, selector, source_of(args, selector), args.audio_cache_dir, args.max_samples)
            return rows.select(F.lit(column).alias("dataset"), "audio_path", "reference_text")

        return load

    loaded, failed = readers.load_or_skip({column: loader(selector, column) for selector, column, _, _ in chosen})
    for name, why in failed.items():
        print(f"WARNING: {name} did not load: {why}", file=sys.stderr)
    name = args.model_id or args.model
    slug = readers.slug_of(name)
    if loaded:
        rows = None
        for part in loaded.values():
            rows = part if rows is None else rows.unionByName(part)
    else:
        rows = spark.createDataFrame([], "dataset string, audio_path string, reference_text string")
    options = backends.LoadOptions(model=args.model, model_id=args.model_id or None, device=args.device, batch_size=args.batch_size)
    wavs = audio_seconds(spark, args.audio_cache_dir)
    heard = backends.transcribe(rows, args.backend, options).join(wavs, "audio_path", "left")
    # Transcribed once: rates, times and raw outputs all read what is kept here.
    said = heard.select(
        F.lit(slug).alias("model"), "dataset", F.regexp_extract("audio_path", "([^/]*)$", 1).alias("id"),
        F.col("reference_text").alias("reference"), "hypothesis", F.coalesce("audio_s", F.lit(0.0)).alias("audio_s"), "infer_s",
    ).persist()
    try:
        if args.outputs_dir:
            writers.write_raw_outputs(said, args.outputs_dir)
        pairs = scoring.normalised_pairs(said.select("model", "dataset", "reference", "hypothesis"), config_of(args))
        rates = scoring.published(scoring.corpus_rates(pairs, "model", "dataset"))
        model = spark.createDataFrame([(slug,)], "model string")
        rates = model.join(rates, "model", "left")
        speed = scoring.speed(said, "model").select(F.col("model").alias("slug"), "speed_x")
        today = spark.range(1).select(naming.today_iso().alias("d")).first()["d"]
        speed_x = (speed.first() or {"speed_x": None})["speed_x"]
        run = {
            "model": name, "model_link": spark.range(1).select(naming.model_link(F.lit(name)).alias("l")).first()["l"], "params_b": params,
            "access": args.access, "submitted": today, "unicode_form": args.unicode_form, "number_words": args.number_words,
            "filler_words": args.filler_words, "speed_x": speed_x, "datasets": sorted(loaded),
        }
        meta = spark.createDataFrame([(run["model"], run["model_link"], params, args.access, today, speed_x, slug)],
                                     "model string, model_link string, params_b double, access string, submitted string, speed_x double, slug string")
        results = result_rows(rates.withColumnRenamed("model", "slug"), meta)
        paths = writers.write_result_files(spark, results, args.out_dir)
        if args.outputs_dir:
            storage.write_text(spark, f"{args.outputs_dir}/_runs/{slug}/meta.json", writers.write_metadata(run) + "\n")
        for row in results.collect():
            print(f"{row['model_name']}: mean_wer {row['mean_wer']} mean_cer {row['mean_cer']} speed_x {row['speed_x']}")
        print(f"wrote {paths[0]}")
    finally:
        said.unpersist()
    return 0


def audio_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """(audio_path, audio_s) of the WAV files below a folder."""
    if not storage.exists(spark, folder):
        return spark.createDataFrame([], "audio_path string, audio_s double")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("audio_path"), readers.wav_seconds(F.col("content")).alias("audio_s"))


# --- rescore


def rescore_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--outputs-dir", default="outputs")
    p.add_argument("--model", default="", help="one model; else all")
    normaliser_flags(p, "NFKC")
    p.add_argument("--out-dir", default="results_rescored")
    p.add_argument("--compare", default="", help="results to show the difference of the means to")


def rescored(spark: SparkSession, folder: str, config: scoring.Config, model: str = "") -> DataFrame | None:
    """Results of saved outputs under ``config``: one plan over all models, data sets outside the registry left out."""
    slug = readers.slug_of(model) if model else "*"
    parted = storage.glob(spark, f"{folder}/model={slug}")
    if not parted and not storage.glob(spark, f"{folder}/{slug}/*.jsonl"):
        return None
    rows = readers.read_raw_outputs(spark, folder if parted else f"{folder}/{slug}/*.jsonl")
    if model:
        rows = rows.filter(F.col("model") == slug)
    rows = scoring.core_only(rows, schemas.CORE_COLUMNS)
    rates = scoring.published(scoring.corpus_rates(scoring.normalised_pairs(rows, config), "model", "dataset"))
    return result_rows(rates.withColumnRenamed("model", "slug"), readers.read_runs(spark, folder))


def rescore(spark: SparkSession, args) -> int:
    results = rescored(spark, args.outputs_dir, config_of(args), args.model)
    if results is None:
        return fail(f"no raw outputs below {args.outputs_dir}")
    results = results.persist()
    try:
        writers.write_result_files(spark, results, args.out_dir)
        shown = results.select("slug", "model_name", "mean_wer")
        if args.compare:
            old, _ = readers.read_published_results(spark, args.compare)
            old = old.select(F.regexp_replace("file", r"\.json$", "").alias("slug"), "mean_wer")
            shown = scoring.delta(shown, old, "mean_wer", "slug").withColumn("delta", scoring.delta_text(F.round("delta", 10)))
        for row in shown.orderBy("slug").collect():
            more = f"{'—' if row['published'] is None else format(row['published'], '.2f'):>10} {row['delta']:>8}" if args.compare else ""
            print(f"{row['model_name'][:48]:<48} {row['mean_wer']:>10.2f} {more}".rstrip())
    finally:
        results.unpersist()
    return 0


# --- outputs and repair


def outputs_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--outputs-dir", default="outputs")
    p.add_argument("--model", default="")
    p.add_argument("--table", default="", help="where the Parquet table goes; else output_table beside the outputs")
    p.add_argument("--no-upload", action="store_true", help="accepted; nothing here uploads")


def build_outputs(spark: SparkSession, args) -> int:
    rows = readers.read_outputs_folder(spark, args.outputs_dir, args.model)
    if rows is None:
        return fail(f"no raw outputs{' of ' + args.model if args.model else ''} below {args.outputs_dir}")
    path = args.table or args.outputs_dir.rstrip("/") + "_table"
    if not writers.write_output_table(rows, path):
        return fail("nothing to write")
    for row in outputs.built_counts(spark.read.parquet(path)).orderBy("model").collect():
        print(f"built {row['model']} ({row['n_rows']} rows)")
    return 0


def repair_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--table", default="outputs_table")
    p.add_argument("--model", default="")
    p.add_argument("--dry-run", action="store_true")


def repair(spark: SparkSession, args) -> int:
    """Rewrites the models that have corrupted rows; the others are not touched."""
    if not storage.exists(spark, args.table):
        return fail(f"{args.table} not found")
    rows = spark.read.parquet(args.table)
    if args.model:
        rows = rows.filter(F.col("model") == readers.slug_of(args.model))
        if rows.isEmpty():
            return fail(f"{args.model} not found in {args.table}")
    counts = outputs.repair_counts(rows, "model").filter("n_repaired > 0").collect()
    broken = sorted(r["model"] for r in counts if r["model"] is not None)
    for row in sorted((r for r in counts if r["model"] is not None), key=lambda r: r["model"]):
        print(f"{row['model']}: {row['n_repaired']} corrupted row(s)")
    if broken and not args.dry_run:
        # A table can't be overwritten while it is read: the repaired models go to a folder beside it first.
        beside = args.table.rstrip("/") + ".repaired"
        outputs.repair(rows.filter(F.col("model").isin(broken))).drop("repaired").write.mode("overwrite").partitionBy("model").parquet(beside)
        writers.write_output_table(spark.read.parquet(beside), args.table)
        fs, made = storage._resolved(spark, beside)
        fs.delete(made, True)
    total = sum(r["n_repaired"] for r in counts if r["model"] is None)
    print(f"{'would repair' if args.dry_run else 'repaired'} {total} row(s)" if total else "no corrupted rows")
    return 0


# --- publish


def publish_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--results-dir", default="results")
    p.add_argument("--published-dir", default="", help="results published before; local ones replace them by file")
    p.add_argument("--table", default="results.parquet")
    p.add_argument("--board", default="leaderboard.json")
    p.add_argument("--names", default="", help="where the module of model names goes")
    p.add_argument("--exclude-organisations", default="")
    p.add_argument("--exclude-models", default="")
    p.add_argument("--org-logo", default="")


def publish(spark: SparkSession, args) -> int:
    local, bad = readers.read_published_results(spark, args.results_dir)
    remote, worse = readers.read_published_results(spark, args.published_dir) if args.published_dir else (local.limit(0), bad.limit(0))
    for row in bad.unionByName(worse).collect():
        print(f"WARNING: skipping {row['file']}: not a result", file=sys.stderr)
    merged = board.overlay(remote, local)
    counts = board.origin_counts(remote, local).first()
    if not counts["n_files"]:
        return fail("no results found")
    print(f"{counts['n_files']} result(s): {counts['n_local']} local, {counts['n_remote_only']} published only")
    writers.write_results(board.results_table(merged), args.table)
    table = board.backfill(spark.read.parquet(args.table))
    organisations = {o.strip() for o in args.exclude_organisations.split(",") if o.strip()}
    models = {m.strip() for m in args.exclude_models.split(",") if m.strip()}
    if gone := board.excluded_count(table, organisations, models).first()["n_excluded"]:
        print(f"excluded {gone} row(s)")
    wer, cer = board.boards(board.exclude(table, organisations, models))
    document = writers.board_document(wer, cer, naming.today_iso(), args.org_logo).first()["document"]
    print(f"{'wrote' if storage.write_text(spark, args.board, document) else 'unchanged'} {args.board}")
    if args.names:
        storage.write_text(spark, args.names, writers.model_names_module(writers.model_names(wer)).first()["module"])
    return 0


# --- fetch


# Names of the corpus archive, in order of preference.
ARCHIVES = ["cv-corpus-*-da.tar.gz", "*common_voice*da*.tar.gz", "*.tar.gz"]


def fetch_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--output-dir", default="cv_da")
    p.add_argument("--splits", nargs="+", default=["test"], help="names apart by spaces or commas")
    p.add_argument("--tarball", default="")
    p.add_argument("--dataset-id", default="", help="accepted; nothing here downloads")
    p.add_argument("--force", action="store_true", help="extract again where a manifest exists")


def fetch(spark: SparkSession, args) -> int:
    archive = args.tarball or archives.find_archive(spark, args.output_dir, ARCHIVES)
    if not archive or not storage.exists(spark, archive):
        return fail("no archive; pass --tarball")
    todo = []
    for split in dict.fromkeys(s.strip() for part in args.splits for s in part.split(",") if s.strip()):
        manifest = f"{args.output_dir}/{split}/{split}_manifest.jsonl"
        if storage.exists(spark, manifest) and not args.force:
            print(f"[{split}] manifest exists: {manifest}")
        else:
            todo.append((split, manifest))
    if not todo:
        return 0
    # The archive is read once for all splits; contents only travel if a split's table is too large for Spark to broadcast.
    staged = storage.shared_folder(spark, "archive")
    members = archives.stage(spark, archive, f"{staged}/members")
    for k, (split, manifest) in enumerate(todo):
        archives.split_table(members, split).write.parquet(f"{staged}/table{k}")
        found = archives.clips(members, spark.read.parquet(f"{staged}/table{k}"), f"{os.path.abspath(args.output_dir)}/{split}/audio")
        found, counts = archives.observed_counts(found)
        archives.write_clips(found, "common_voice_da").write.mode("overwrite").json(manifest)
        print(f"[{split}] {counts.get['n_extracted']} extracted, {counts.get['n_skipped']} skipped")
    storage.remove(spark, staged)
    return 0


# --- sweep


def sweep_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("models", help="lines of model|backend|more flags; # starts a comment")
    p.add_argument("--failures", default=os.environ.get("FAILURES_FILE", "sweep_failures.txt"))


def sweep(spark: SparkSession, args, environment=os.environ) -> int:
    """Evaluates every listed model; one that fails is noted and the others go on.

    MAX_SAMPLES caps data sets, ONLY_BACKENDS allows and SKIP_MODELS blocks by
    comma-separated names, RUN_API=1 includes hosted backends, BATCH is the batch size.
    """

    def names(variable: str) -> set[str]:
        return {x for x in environment.get(variable, "").split(",") if x}

    failures = []
    for line in storage.read_text(spark, args.models).splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        model, backend, more = (line.split("|") + ["", ""])[:3]
        allowed = not names("ONLY_BACKENDS") or backend in names("ONLY_BACKENDS")
        hosted = backend in backends.HOSTED_BACKENDS and environment.get("RUN_API", "0") != "1"
        if not allowed or hosted or model in names("SKIP_MODELS"):
            print(f"skip {model}")
            continue
        flags = ["evaluate", "--model", model, "--backend", backend, "--unicode-form", "NFC", "--batch-size", environment.get("BATCH", "16")]
        if int(environment.get("MAX_SAMPLES", "0")):
            flags += ["--max-samples", environment["MAX_SAMPLES"]]
        try:
            code = main([*flags, *more.split()], spark)
        except (Exception, SystemExit) as e:  # noqa: BLE001  one model must not stop the sweep
            print(f"{model}: {e}", file=sys.stderr)
            code = 1
        if code:
            failures.append(model)
    storage.write_text(spark, args.failures, "".join(f"{m}\n" for m in failures))
    return 0


COMMANDS = {
    "evaluate": (evaluate_flags, evaluate),
    "rescore": (rescore_flags, rescore),
    "outputs": (outputs_flags, build_outputs),
    "repair": (repair_flags, repair),
    "publish": (publish_flags, publish),
    "fetch": (fetch_flags, fetch),
    "sweep": (sweep_flags, sweep),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skaldic", description="Evaluate, score and publish transcription models")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (flags, _) in COMMANDS.items():
        flags(commands.add_parser(name))
    args = parser.parse_args(argv)
    return COMMANDS[args.command][1](spark or session(), args)


if __name__ == "__main__":
    sys.exit(main())
