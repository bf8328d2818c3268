"""Record linkage from raw records to decisions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import fit_dictionary, load_dictionary, save_dictionary, training_pairs, translate_names
from ..functions.textnorm import normalize_records
from ..operators import blocking, context, decide, features, metrics, models, quality, retrieve, sampling
from ..sources import stages, tsv
from ..sources.scratch import intermediates, new_path, read_text, saved, write_text


@dataclass(frozen=True)
class Settings:
    """All knobs of a run."""

    folds: int = 5
    beta: float = 0.5
    recall_kept: float = 0.995
    most_candidates: int = 12
    most_training: int = 400_000
    pruner_rounds: int = 200
    matcher_rounds: int = 600
    patience: int = 50
    seed: int = 7
    fraction: float = 1.0


def with_blocks(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(S1 records, targets) of normalized records, with their blocks."""
    s1 = blocking.s1_blocks(records.where("src = 1"))
    return s1, blocking.target_blocks(records.where("src > 1"), blocking.state_purity(s1))


def prepare(raw: DataFrame, dictionary: DataFrame | None = None, save=saved) -> tuple[DataFrame, DataFrame]:
    """(S1 records, targets), normalized, with blocks, written once."""
    rendered = None
    if dictionary is not None:
        raw, rendered = translate_names(raw, dictionary), "rendered"
    s1, targets = with_blocks(save(normalize_records(raw, rendered), "records"))
    return s1, save(targets, "targets")


def candidates(s1: DataFrame, targets: DataFrame, save=saved) -> DataFrame:
    """Retrieved pairs with their context features, over all pairs before any is left out."""
    return save(context.context_features(retrieve.retrieve(s1, targets, save)), "pairs")


def fixed_matches(raw: DataFrame, threshold: float = 0.5) -> DataFrame:
    """s1, t, p: linkage with the fixed score, no training."""
    s1, targets = prepare(raw)
    return decide.predict_pairs(models.fixed_score(candidates(s1, targets)).select("s1", "t", "p"), threshold)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.withColumn("y", F.lit(1)), ["s1", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def train(raw: DataFrame, truth: DataFrame, folder: str, settings: Settings = Settings()) -> dict:
    """Fit dictionary, pruner and matcher, tune the threshold, write all of them to folder; the report of the validation fold."""
    with intermediates(raw.sparkSession):
        return _train(raw, truth, folder, settings)[0]


def _train(raw: DataFrame, truth: DataFrame, folder: str, settings: Settings) -> tuple[dict, tuple[DataFrame, DataFrame, DataFrame]]:
    """(the report; S1 records, targets and candidates that were made on the way)"""
    spark = raw.sparkSession
    s1_raw, t_raw = raw.where("entity_id LIKE 'S1-%'"), raw.where("entity_id NOT LIKE 'S1-%'")
    if settings.fraction < 1:
        s1_raw, t_raw = sampling.sample_world(s1_raw, t_raw, truth, settings.fraction)
        truth = truth.join(s1_raw.selectExpr("entity_id AS s1"), "s1", "left_semi")
    subsets = saved(sampling.entity_subsets(s1_raw, settings.most_training, settings.seed).withColumnRenamed("entity_id", "s1"), "subsets")
    learn = s1_raw.join(subsets.where("role = 'val'").selectExpr("s1 AS entity_id"), "entity_id", "left_anti")
    dictionary = saved(fit_dictionary(training_pairs(truth, learn, t_raw)), "dictionary")
    save_dictionary(dictionary, f"{folder}/dictionary.json")
    s1, targets = prepare(s1_raw.unionByName(t_raw), dictionary)
    found = candidates(s1, targets)
    pairs = saved(labelled(found, truth).join(subsets, "s1"), "labelled")
    pruner = models.train_pruner(pairs.where("role = 'train'"), features.CONTEXT, settings.seed, settings.pruner_rounds)
    models.save(pruner, f"{folder}/pruner")
    scored = saved(models.score(pairs, pruner, features.CONTEXT, "p_prune"), "scored")
    floor = decide.threshold_for_recall(scored.where("role = 'tune'"), "p_prune", settings.recall_kept).first()[0]
    kept = saved(features.featurize(decide.prune(scored, "p_prune", floor, settings.most_candidates).drop("country"), s1, targets), "featured")
    names = [*features.CONTEXT, *features.PAIR]
    matcher = models.train_matcher(kept.where("role <> 'val'").withColumn("is_tune", F.col("role") == "tune"), names, seed=settings.seed, rounds=settings.matcher_rounds, patience=settings.patience)
    models.save(matcher, f"{folder}/matcher")
    final = saved(models.score(kept, matcher, names, "p").select("s1", "t", "p", "role"), "matched")

    def of(role: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        ids = subsets.where(F.col("role") == role).select("s1")
        return final.where(F.col("role") == role), truth.join(ids, "s1", "left_semi"), ids

    tune, tune_truth, tune_ids = of("tune")
    best = decide.tune_threshold(tune, tune_truth, tune_ids, settings.beta).orderBy(F.round("f", 9).desc(), "threshold").first()
    val, val_truth, val_ids = of("val")
    chosen = decide.predict_pairs(val, best.threshold)
    report = {
        "threshold": best.threshold, "prune_threshold": floor, "tune_f": best.f,
        "val_f": metrics.macro_f(chosen, val_truth, val_ids, settings.beta).first()[0],
        "blocking": metrics.blocking_report(val, val_truth, val_ids, targets.count(), settings.beta).first().asDict(),
        "importance": models.importance(matcher, names)[:20], "settings": asdict(settings),
    }
    write_text(spark, f"{folder}/decision.json", json.dumps({"match_threshold": best.threshold, "prune_threshold": floor, "features": names}))
    write_text(spark, f"{folder}/report.json", json.dumps(report))
    return report, (s1, targets, found)


def trained_matches(raw: DataFrame, truth: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """s1, t: the whole linkage, trained on raw and truth and applied to raw, whose candidates are found once for both."""
    spark = raw.sparkSession
    path = new_path(spark, "matches")  # stays when all other tables go
    with intermediates(spark):
        folder = new_path(spark, "model")
        _, made = _train(raw, truth, folder, settings)
        matches = predict(raw, folder, settings, made if settings.fraction >= 1 else None)[1]
        tsv.explode_truth(matches).write.parquet(path)
    return spark.read.parquet(path)


def predict(raw: DataFrame, folder: str, settings: Settings = Settings(), made: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate lists, match lists, rule violations) with the models in folder. Assignment is over all targets.

    made: S1 records, targets and candidates of raw, where training on all of it has made them with the same dictionary.
    """
    spark = raw.sparkSession
    decision = json.loads(read_text(spark, f"{folder}/decision.json"))
    if made is None:
        s1, targets = prepare(raw, load_dictionary(spark, f"{folder}/dictionary.json"))
        made = s1, targets, candidates(s1, targets)
    s1, targets, found = made
    scored = models.score(found, models.load(f"{folder}/pruner"), features.CONTEXT, "p_prune")
    kept = saved(decide.prune(scored, "p_prune", decision["prune_threshold"], settings.most_candidates), "kept")
    final = models.score(features.featurize(kept, s1, targets), models.load(f"{folder}/matcher"), decision["features"], "p")
    chosen = decide.predict_pairs(final.select("s1", "t", "p"), decision["match_threshold"])
    ids = s1.select(F.col("entity_id").alias("s1"))
    lists = saved(tsv.id_lists(ids, kept, "candidate_entity_ids"), "candidate-lists"), saved(tsv.id_lists(ids, chosen, "matched_entity_ids"), "match-lists")
    checks = quality.validate_output(lists[1], lists[0], ids, targets.select(F.col("entity_id").alias("t")))
    return (*lists, checks)


def write_predictions(raw: DataFrame, folder: str, out: str) -> None:
    """Both id-list files; nothing is written as a result if a rule is broken."""
    with intermediates(raw.sparkSession):
        cands, matches, checks = predict(raw, folder)
        if broken := checks.where("violations > 0").collect():
            raise ValueError(f"outputs break rules: {[(r.rule, r.violations) for r in broken]}")
        tsv.write_tsv(cands, f"{out}/candidate_pairs.tsv")
        tsv.write_tsv(matches, f"{out}/matching_results.tsv")


def cached_records(spark: SparkSession, raw: DataFrame, folder: str, inputs: object) -> DataFrame:
    """Normalized records kept in folder until the code or the inputs' description changes."""
    return stages.stage(spark, folder, stages.fingerprint(normalize_records, inputs), lambda: normalize_records(raw))
