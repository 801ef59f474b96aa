"""From features to match lists: labels, folds, out-of-fold scores, the threshold sweep, the operating point, predictions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_code, hash_bucket, md5_bucket
from ..functions.text import safe_div
from ..sources.session import staged
from .blocking import NamePairs
from .evaluate import counters, counters_of_names, f05, macro_f05
from .ordered import numbered


#: Of the layout of saved models.
BUNDLE = 1


def label_pairs(rows: DataFrame, truth: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """Adds label (0 or 1) to rows of known entities; others are dropped, as the truth says nothing of them."""
    known = true_pairs.select("s1_id", "target_id", F.lit(1).alias("label")).distinct()
    return rows.join(truth.select("s1_id"), "s1_id", "left_semi").join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def label_report(rows: DataFrame, truth: DataFrame, true_pairs: DataFrame) -> DataFrame:
    labelled = label_pairs(rows, truth, true_pairs).agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positive"), F.count_distinct("s1_id").alias("n_entities"))
    strange = rows.join(truth.select("s1_id"), "s1_id", "left_anti").agg(F.count("*").alias("n_unknown_rows"))
    return labelled.join(strange).withColumn("positive_rate", F.round(safe_div(F.col("n_positive"), F.col("n_rows")), 6))


def assign_folds(truth: DataFrame, k: int, mode: str = "hash") -> DataFrame:
    """Adds fold to entities, so that all rows of an entity share one.

    ``hash`` and ``md5`` go by the id alone. ``balanced`` deals entities with matches by falling number of matches, to and
    fro over the folds, and others by hash. A fold without an entity is an error.
    """
    if not 2 <= k <= 32767:
        raise ValueError("there must be 2 to 32767 folds")
    by_id = {"hash": hash_bucket, "md5": md5_bucket, "balanced": hash_bucket}[mode](F.col("s1_id"), k)
    if mode == "balanced":
        # those with matches come first, so their numbers are the same as among themselves
        truth = numbered(truth, [F.desc("n_true"), F.col("s1_id")], "_place")
        turn = F.pmod("_place", F.lit(2 * k))
        by_id = F.when(F.col("n_true") > 0, F.when(turn < k, turn).otherwise(2 * k - 1 - turn)).otherwise(by_id)
        truth = truth.withColumn("fold", by_id.cast("int")).drop("_place")
        by_id = F.col("fold")
    out = truth.withColumn("fold", by_id.cast("int"))
    used = out.agg(F.count_distinct("fold")).first()[0]
    if used != k:
        raise ValueError(f"only {used} of {k} folds have an entity")
    return out


def fold_purity(rows: DataFrame) -> DataFrame:
    """Entities, folds, and entities that are in several folds (which must be none)."""
    by_entity = rows.groupBy("s1_id").agg(F.count_distinct("fold").alias("n"))
    one = by_entity.agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") > 1).alias("n_split_entities"))
    return one.join(rows.agg(F.count_distinct("fold").alias("n_folds")))


def threshold_score(feature: str) -> Column:
    """A feature's own value as the score, missing as 0."""
    value = F.col(feature).cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


@dataclass(frozen=True)
class TreeSettings:
    """Of gradient boosting. Spark grows trees by level, so ``depth`` stands in for a number of leaves: 5 gives 31 at most."""

    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    least_rows: int = 200
    seed: int = 42


def _pipeline(features: list[str], settings: TreeSettings, seed: int) -> Pipeline:
    floats = [f"{f}__v" for f in features]
    return Pipeline(stages=[Imputer(inputCols=floats, outputCols=[f"{f}__i" for f in features]), VectorAssembler(inputCols=[*(f"{f}__i" for f in features), *(f"{f}__na" for f in features)], outputCol="vector"), GBTClassifier(featuresCol="vector", labelCol="label", maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.rate, minInstancesPerNode=settings.least_rows, seed=seed, checkpointInterval=-1)])


def _prepared(rows: DataFrame, features: list[str]) -> DataFrame:
    """Doubles, and whether each is missing, which the trees can't tell by themselves."""
    extra = {f"{f}__v": F.col(f).cast("double") for f in features} | {f"{f}__na": F.col(f).isNull().cast("double") for f in features}
    out = rows.withColumns(extra)
    # a column without any value can't be imputed
    return out.withColumns({f"{f}__v": F.coalesce(F.col(f"{f}__v"), F.lit(None).cast("double")) for f in features})


def out_of_fold(rows: DataFrame, features: list[str], k: int, settings: TreeSettings = TreeSettings()) -> tuple[DataFrame, list[PipelineModel]]:
    """Scores of each row by the model of the other folds, and the models. Needs columns fold and label."""
    ready = staged(_prepared(rows, features), "training")
    present = ready.agg(*[F.count(f).alias(f) for f in features]).first()
    usable = [f for f in features if present[f]]
    models, scored = [], None
    for fold in range(k):
        model = _pipeline(usable, settings, settings.seed + fold).fit(ready.where(F.col("fold") != fold))
        part = model.transform(ready.where(F.col("fold") == fold)).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")
        scored = part if scored is None else scored.unionByName(part)
        models.append(model)
    return scored, models


def predict(rows: DataFrame, features: list[str], models: list[PipelineModel]) -> DataFrame:
    """The mean score of the models."""
    ready = _prepared(rows, features)
    for i, model in enumerate(models):
        ready = model.transform(ready).withColumn(f"score_{i}", vector_to_array("probability")[1]).select(*rows.columns, *[c for c in ready.columns if c not in rows.columns and not c.startswith("vector")], f"score_{i}")
    mean = sum((F.col(f"score_{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return ready.select(*rows.columns, mean.alias("score"))


def save_models(models: list[PipelineModel], path: str, features: list[str] | None = None, settings: TreeSettings = TreeSettings()) -> None:
    """The models and a manifest of what they were made for, which is written last."""
    spark = SparkSession.getActiveSession()
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/fold={i}")
    row = (BUNDLE, len(models), list(features or []), json.dumps(asdict(settings), sort_keys=True))
    spark.createDataFrame([row], "version int, folds int, features array<string>, settings string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def describe_models(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema("version int, folds int, features array<string>, settings string").json(f"{path}/manifest").first()
    if row is None or row.version != BUNDLE:
        raise ValueError(f"{path} has no models of version {BUNDLE}")
    return {"folds": row.folds, "features": list(row.features), "settings": json.loads(row.settings)}


def load_models(path: str, k: int | None = None, features: list[str] | None = None) -> list[PipelineModel]:
    """The models at ``path``. Raises ValueError if they are of another version, another number of folds or other features."""
    found = describe_models(SparkSession.getActiveSession(), path)
    if k is not None and found["folds"] != k:
        raise ValueError(f"the models are of {found['folds']} folds, not {k}")
    if features is not None and found["features"] and found["features"] != list(features):
        odd = sorted(set(found["features"]) ^ set(features)) or ["their order"]
        raise ValueError(f"the models are of other features: {', '.join(odd)}")
    return [PipelineModel.load(f"{path}/fold={i}") for i in range(found["folds"])]


def score_curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(score, rows, predicted, hits, sum_zero, sum_exclude) at each distinct score, all rows of that score and above being
    predicted: the sums of entities' F0.5 under both policies.

    An entity's F0.5 changes only at its own rows, so each row is given the change that it makes, changes are summed by
    score, and a running sum over distinct scores, by ranges of them, gives every point; rows of equal score telescope.
    """
    rows = scored.withColumn("score", F.col("score").cast("float")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.join(truth.select("s1_id", "n_true"), "s1_id")
    own = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"c": F.count("*").over(own), "h": F.sum("label").over(own)})
    n, c, h, y = (F.col(x) for x in ("n_true", "c", "h", "label"))
    before = F.when(c > 1, F.coalesce(f05(n, c - 1, h - y), F.lit(0.0))).otherwise(0.0)
    gain = F.coalesce(f05(n, c, h), F.lit(0.0)) - before
    rows = rows.withColumns({"gain": F.when(n > 0, gain).otherwise(0.0), "lost": F.when((n == 0) & (c == 1), 1).otherwise(0)})
    by_score = rows.groupBy("score").agg(F.count("*").alias("k"), F.sum("label").alias("y"), F.sum("gain").alias("gain"), F.sum("lost").alias("lost"))
    sums = {"predicted_rows": F.col("k"), "hits": F.col("y"), "f_matched": F.col("gain"), "n_empty_hit": F.col("lost")}
    out = numbered(by_score, [F.desc("score")], "place", sums)
    return out.select("score", F.col("k").alias("rows"), *sums)


def threshold_sweep(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """The whole curve with rates; the row of no score is to predict nothing."""
    sizes = truth.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") > 0).alias("n_matched"), F.sum("n_true").alias("n_pairs"))
    curve = score_curve(scored, truth)
    nothing = curve.sparkSession.range(1).select(F.lit(None).cast("float").alias("score"), *[F.lit(0).cast(t).alias(c) for c, t in curve.dtypes if c != "score"])
    rows = curve.unionByName(nothing).join(sizes)
    empty = F.col("n") - F.col("n_matched")
    p, r = safe_div(F.col("hits"), F.col("predicted_rows")), safe_div(F.col("hits"), F.col("n_pairs"))
    return rows.select(
        F.round(F.col("score").cast("double"), 6).alias("threshold"),
        "predicted_rows",
        "hits",
        F.round(safe_div(F.col("f_matched") + empty - F.col("n_empty_hit"), F.col("n")), 6).alias("macro_f05_score_zero"),
        F.round(safe_div(F.col("f_matched"), F.col("n_matched")), 6).alias("macro_f05_exclude"),
        F.round(p, 6).alias("pair_precision"),
        F.round(r, 6).alias("pair_recall"),
        F.round(safe_div(1.25 * p * r, 0.25 * p + r), 6).alias("pair_f05"),
        F.col("n_empty_hit").alias("n_empty_gt_entities_with_predictions"),
    )


def grid_positions(n: int, points: int = 200) -> list[int]:
    """Log-spaced numbers of predicted rows up to ``n``, 0 first."""
    if n <= 1:
        return list(range(max(n, 1)))
    points = max(2, points)
    spaced = {min(n, max(1, round(n ** (i / (points - 1))))) for i in range(points)}
    return [0, *sorted(spaced)]


def snap_to_grid(sweep: DataFrame, positions: list[int]) -> DataFrame:
    """The sweep's rows that are the first to reach a position, as a threshold takes all rows of a score or none."""
    grid = F.array(*[F.lit(p).cast("long") for p in positions])
    # each point votes for the positions that it reaches; the least of those that reach a position wins it
    reached = sweep.select("predicted_rows", F.explode(F.filter(grid, lambda p: p <= F.col("predicted_rows"))).alias("position"))
    first = reached.groupBy("position").agg(F.min("predicted_rows").alias("predicted_rows")).select("predicted_rows").distinct()
    return sweep.join(F.broadcast(first), "predicted_rows").select(*sweep.columns)


def refined(sweep: DataFrame, grid: DataFrame, policy: str = "score_zero", points: int = 50) -> DataFrame:
    """``grid``, the sweep's points at log-spaced positions, and ``points`` more between the neighbours of its best one, where
    the spacing may be wider than the plateau."""
    order = grid.select("predicted_rows", F.round(F.col(f"macro_f05_{policy}") * 1_000_000).cast("long").alias("micro")).orderBy("predicted_rows").collect()  # a few hundred
    if points <= 0 or len(order) < 2:
        return grid
    best = max(range(len(order)), key=lambda i: (order[i].micro, -i))
    low, high = order[max(best - 1, 0)].predicted_rows, order[min(best + 1, len(order) - 1)].predicted_rows
    if high - low <= 1:
        return grid
    more = sorted({low + (high - low) * i // (points + 1) for i in range(points + 2)})
    return grid.unionByName(snap_to_grid(sweep, more)).dropDuplicates(["predicted_rows"])


def consistent(point: DataFrame, direct: DataFrame, policy: str = "score_zero", within: float = 1e-6) -> DataFrame:
    """(swept, measured, holds): whether the sweep's value at the chosen threshold is what ``evaluate.macro_f05`` of the
    decided rows gives. Both are rounded to six digits."""
    swept, measured = F.col("chosen_macro_f05"), F.col(f"macro_f05_{policy}")
    return point.select("chosen_macro_f05").join(F.broadcast(direct)).select(swept.alias("swept"), measured.alias("measured"), (F.abs(swept - measured) <= within).alias("holds"))


def ab_compare(runs: dict[str, DataFrame], truth: DataFrame, threshold: float) -> DataFrame:
    """(run, rows, both macro F0.5, differences to the first run, same_pairs): runs of scored rows (s1_id, target_id, score,
    label) at one threshold. ``holds`` is the self-check: the first run doesn't differ from itself."""
    names, kept = list(runs), {}
    for name, scored in runs.items():
        kept[name] = decide(scored, threshold).withColumn("is_true", F.col("label"))
    first = kept[names[0]].select("s1_id", "target_id").distinct()
    out = None
    for name in names:
        one = macro_f05(counters(truth, kept[name])).join(F.broadcast(kept[name].agg(F.count("*").alias("n_rows"))))
        same = kept[name].select("s1_id", "target_id").distinct().join(first, ["s1_id", "target_id"], "left_semi").agg(F.count("*").alias("n_same_pairs"))
        one = one.join(F.broadcast(same)).select(F.lit(name).alias("run"), "n_rows", "n_same_pairs", "macro_f05_score_zero", "macro_f05_exclude")
        out = one if out is None else out.unionByName(one)
    return _against_first(out, names[0])


def ab_compare_names(runs: dict[str, NamePairs], truth: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """``ab_compare`` of runs that keep pairs of names."""
    first, out = next(iter(runs)), None
    n = F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).cast("long")
    for name, kept in runs.items():
        same = kept.pairs.join(runs[first].pairs.select("a", "b", "source"), ["a", "b", "source"], "left_semi").agg(n.alias("n_same_pairs"))
        one = macro_f05(counters_of_names(truth, kept, true_pairs)).join(F.broadcast(kept.pairs.agg(n.alias("n_rows")))).join(F.broadcast(same))
        one = one.select(F.lit(name).alias("run"), "n_rows", "n_same_pairs", "macro_f05_score_zero", "macro_f05_exclude")
        out = one if out is None else out.unionByName(one)
    return _against_first(out, first)


def _against_first(out: DataFrame, first: str) -> DataFrame:
    base = out.where(F.col("run") == first).select(*[F.col(c).alias(f"base_{c}") for c in ("macro_f05_score_zero", "macro_f05_exclude")])
    out = out.join(F.broadcast(base))
    delta = lambda c: F.round(F.col(c) - F.col(f"base_{c}"), 6)
    out = out.withColumns({"delta_score_zero": delta("macro_f05_score_zero"), "delta_exclude": delta("macro_f05_exclude")})
    itself = (F.col("run") != first) | ((F.col("delta_score_zero") == 0) & (F.col("delta_exclude") == 0) & (F.col("n_same_pairs") <= F.col("n_rows")))
    return out.withColumn("holds", itself).drop("base_macro_f05_score_zero", "base_macro_f05_exclude")


def operating_point(sweep: DataFrame, tolerance: float = 0.002, policy: str = "score_zero") -> DataFrame:
    """The middle of the plateau around the best point: the run of neighbours that are within ``tolerance`` of it.

    The best is the first by number of predicted rows where several are equal.
    """
    score = F.col(f"macro_f05_{policy}")
    # in steps of 1e-6, in which the sweep is rounded: exact in whole numbers
    rows = numbered(sweep.withColumn("micro", F.round(score * 1_000_000).cast("long")), [F.col("predicted_rows")], "i")
    peak = F.broadcast(rows.agg(F.max(F.struct("micro", (-F.col("i")).alias("first"))).alias("peak"), F.max("i").alias("last")).select(F.col("peak.micro").alias("top"), (-F.col("peak.first")).alias("best"), "last"))
    rows = rows.join(peak)
    out = F.when(F.col("micro") < F.col("top") - round(tolerance * 1_000_000), F.col("i"))
    ends = rows.agg(F.max(F.when(out < F.col("best"), out)).alias("below"), F.min(F.when(out > F.col("best"), out)).alias("above"))
    ends = rows.join(F.broadcast(ends)).withColumns({"low": F.coalesce(F.col("below") + 1, F.lit(0)), "high": F.coalesce(F.col("above") - 1, F.col("last"))})
    chosen = ends.where(F.col("i") == F.floor((F.col("low") + F.col("high")) / 2))
    return chosen.select(
        F.lit(policy).alias("policy"),
        F.col("threshold").alias("chosen_threshold"),
        score.alias("chosen_macro_f05"),
        F.round(F.col("top") / 1_000_000, 6).alias("best_macro_f05"),
        F.col("predicted_rows").alias("chosen_predicted_rows"),
        F.col("i").cast("long").alias("chosen_index"),
        F.col("best").cast("long").alias("best_index"),
        (F.col("high") - F.col("low") + 1).cast("long").alias("plateau_points"),
    )


def decide(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows at or above the threshold; a missing score never is."""
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= threshold))


def match_lists(selected: DataFrame) -> DataFrame:
    """(s1_id, matches): distinct targets by source and number."""
    codes = F.array_sort(F.collect_set(F.struct(entity_code(F.col("target_id")).alias("code"), F.col("target_id"))))
    return selected.groupBy("s1_id").agg(F.transform(codes, lambda x: x["target_id"]).alias("matches"))


def submission(s1: DataFrame, selected: DataFrame) -> DataFrame:
    """One row for each reference entity, in no order but with its position, "" where it has no match."""
    lists = match_lists(selected)
    return s1.select(F.col("entity_id").alias("source1_entity_id"), "row_pos").join(lists.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").select("source1_entity_id", F.coalesce(F.array_join("matches", ","), F.lit("")).alias("matched_entity_ids"), "row_pos")


def submission_checks(s1: DataFrame, scored: DataFrame, selected: DataFrame, made: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """What must hold of a submission, by name. ``written`` is the submission as it was read back from where it was written,
    so that a fault of writing can't hide; without it, ``made`` is counted."""
    measured = (made if written is None else written).agg(F.count("*").alias("n_measured"))
    a = s1.agg(F.count("*").alias("n_in"), F.count_distinct("entity_id").alias("n_ids"))
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    b = made.agg(
        F.count("*").alias("n_out"),
        F.count_distinct("source1_entity_id").alias("n_out_ids"),
        F.count_if(F.col("matched_entity_ids") == "").alias("n_single"),
        F.count_if(F.col("matched_entity_ids") != "").alias("n_matched"),
        F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("n_predictions"),
        F.coalesce(F.sum(F.size(F.filter(ids, lambda x: ~x.rlike("^S[23]-")))), F.lit(0)).alias("n_strange"),
    )
    c = selected.agg(F.count("*").alias("n_selected")).join(scored.agg(F.count("*").alias("n_scored")))
    missing = scored.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti").agg(F.count_distinct("s1_id").alias("n_missing"))
    one = a.join(b).join(c).join(missing).join(measured)
    checks = {
        "exactly_one_row_per_s1_entity": F.col("n_out") == F.col("n_in"),
        "row_count_matches_the_s1_file": F.col("n_measured") == F.col("n_in"),
        "the_s1_file_is_not_empty": F.col("n_in") > 0,
        "no_duplicate_s1_ids": (F.col("n_ids") == F.col("n_in")) & (F.col("n_out_ids") == F.col("n_out")),
        "no_s1_entity_dropped": F.col("n_missing") == 0,
        "every_row_is_singleton_or_matched": F.col("n_single") + F.col("n_matched") == F.col("n_out"),
        "predictions_are_valid_target_ids": F.col("n_strange") == 0,
        "predictions_within_selected_rows": F.col("n_predictions") <= F.col("n_selected"),
        "selected_within_scored_rows": F.col("n_selected") <= F.col("n_scored"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("holds")) for k, v in checks.items()])).alias("x")).select("x.*")
