"""The stages of a linkage run over files, each from a folder to a folder of ``root``."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.ids import is_sampled, is_validation
from ..functions.normalize import add_normalized_columns
from ..operators import blocking, evaluate, features, keys, matcher
from ..sources import files
from ..sources.session import ship, staged
from . import calibrate, errors, names, statistics
from .resume import resumed


class SubmissionError(ValueError):
    """A submission that doesn't hold what it must."""


class Run:
    """``root`` has raw/<split>/source1.tsv, source2.tsv, source3.tsv and, for training, raw/<split>/truth.tsv."""

    def __init__(self, spark: SparkSession, root: str, config: LinkConfig = LinkConfig(), kind: str = "parquet"):
        """``kind`` is the format of the prepared table, parquet or tsv."""
        self.spark, self.root, self.config, self.kind = ship(spark), root, config, kind

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def records(self, split: str, source: int) -> DataFrame:
        return files.read_prepared(self.spark, self.path("prepared"), split, source)

    def s1(self, split: str) -> DataFrame:
        return self.records(split, 1).drop("source", "split")

    def targets(self, split: str) -> DataFrame:
        return files.read_prepared(self.spark, self.path("prepared"), split).where("source > 1").drop("split")

    def truth(self, split: str) -> tuple[DataFrame, DataFrame]:
        return files.read_truth(self.spark, self.path("raw", split, "truth.tsv"))

    def prepare(self, splits: tuple[str, ...] = ("train",)) -> int:
        """Normalizes all sources into one table, partitioned by split and source."""
        raw = {(split, source): self.path("raw", split, f"source{source}.tsv") for split in splits for source in (1, 2, 3)}
        files.require(self.spark, *raw.values())
        made = None
        for split in splits:
            for source in (1, 2, 3):
                if bad := files.malformed_rows(self.spark, raw[split, source]):
                    warnings.warn(f"{raw[split, source]} has {bad} lines that don't fit its columns", stacklevel=2)
                rows = files.read_tsv(self.spark, raw[split, source])
                rows = add_normalized_columns(rows, self.config.norm).withColumns({"split": F.lit(split), "source": F.lit(source)})
                made = rows if made is None else made.unionByName(rows)
        return files.published(made, self.path("prepared"), self.kind, partition_by=("split", "source"))

    def manifest(self) -> DataFrame:
        return files.manifest(files.read_published(self.spark, self.path("prepared")))

    def postings(self, split: str = "train") -> dict[str, int]:
        """The indexes, and the frequencies and vocabulary that they were chosen by, as tables that know what they are."""
        targets, out = self.targets(split), {}
        for kind, config in (("token", self.config.token), ("char", self.config.char)):
            out[kind] = files.save_index(keys.postings(targets, kind, config), self.path("postings", split, kind), f"{kind} postings", repr(config))
            made = keys.token_keys(targets) if kind == "token" else keys.trigram_keys(targets)
            out[f"{kind}_df"] = files.save_index(keys.document_frequency(made), self.path("postings", split, f"{kind}_df"), f"{kind} frequencies", "")
        return out

    def load_postings(self, split: str, kind: str) -> DataFrame:
        """The saved index of a blocker; an error if it is of other settings than this run's."""
        return files.load_index(self.spark, self.path("postings", split, kind), f"{kind} postings", repr(self.config.token if kind == "token" else self.config.char))

    def load_frequencies(self, split: str, kind: str) -> DataFrame:
        return files.load_index(self.spark, self.path("postings", split, f"{kind}_df"), f"{kind} frequencies")

    def candidates(self, split: str = "train") -> int:
        found = blocking.candidates(self.s1(split), self.targets(split), self.config)
        return files.published(found, self.path("candidates", split))

    def read_candidates(self, split: str) -> DataFrame:
        return self.spark.read.parquet(self.path("candidates", split))

    def evaluate(self, split: str = "train") -> DataFrame:
        """Metrics for the validation entities, the others, and all."""
        truth, pairs = self.truth(split)
        rows = evaluate.counters(truth, evaluate.mark_true(self.read_candidates(split), pairs))
        val = is_validation(F.col("s1_id"), self.config.val_fraction, self.config.split_mode)
        return evaluate.metrics_by_split(rows, F.when(val, "val").otherwise("train"))

    def features(self, split: str = "train", sample: float = 1.0, entities: str = "auto") -> int:
        """Features of whole entities' candidates. ``entities`` is val, all, or auto: val for training data, all for others.
        Records that no candidate names aren't read into the join. Raises ValueError if rows, entities or pairs got lost or a
        ratio isn't between 0 and 1; otherwise writes the statistics beside the features."""
        if entities not in ("auto", "val", "all"):
            raise ValueError(f"unknown scope {entities!r}")
        every = self.read_candidates(split)
        rows = every
        if sample < 1:
            rows = rows.where(is_sampled(F.col("s1_id"), sample))
        if entities == "val" or (entities == "auto" and split == "train"):
            rows = rows.where(is_validation(F.col("s1_id"), self.config.val_fraction, self.config.split_mode))
        s1, targets = files.only_wanted(self.s1(split), rows.select("s1_id")), files.only_wanted(self.targets(split), rows.select("target_id"))
        n = files.published(features.pair_features(rows, s1, targets), self.path("features", split))
        made = self.spark.read.parquet(self.path("features", split))
        checks = features.accounting(every if rows is every else rows, made)
        if broken := [r["check"] for r in checks.where("not holds").collect()]:
            raise ValueError(f"the features don't account: {', '.join(broken)}")
        files.published(features.feature_stats(made), self.path("reports", split, "features"))
        features.assert_unit(self.spark.read.parquet(self.path("reports", split, "features")))
        return n

    def train(self, split: str = "train", score: str | None = None, settings: matcher.TreeSettings = matcher.TreeSettings()) -> DataFrame:
        """Out-of-fold scores, the sweep and the operating point, which is returned. ``score`` names a feature to use as it
        is instead of trees."""
        truth, pairs = self.truth(split)
        rows = matcher.label_pairs(self.spark.read.parquet(self.path("features", split)), truth, pairs)
        scored_entities = rows.select("s1_id").distinct()
        truth = truth.join(scored_entities, "s1_id", "left_semi")
        if score:
            scored = rows.withColumn("score", matcher.threshold_score(score))
        else:
            folds = matcher.assign_folds(truth, self.config.folds)
            scored, models = matcher.out_of_fold(rows.join(folds.select("s1_id", "fold"), "s1_id"), list(features.TYPES), self.config.folds, settings)
            matcher.save_models(models, self.path("model"), list(features.TYPES), settings)
        files.published(scored.select("s1_id", "target_id", "label", F.col("score").cast("float")), self.path("scores", split))
        sweep = matcher.threshold_sweep(self.spark.read.parquet(self.path("scores", split)), truth)
        files.published(sweep, self.path("sweep", split))
        sweep = self.spark.read.parquet(self.path("sweep", split))
        grid = matcher.snap_to_grid(sweep, matcher.grid_positions(sweep.agg(F.max("predicted_rows")).first()[0]))
        files.published(matcher.operating_point(matcher.refined(sweep, grid), self.config.plateau), self.path("operating_point"))
        point = self.spark.read.parquet(self.path("operating_point"))
        threshold = point.first()["chosen_threshold"]
        scores = self.spark.read.parquet(self.path("scores", split)).withColumn("is_true", F.col("label"))
        # thresholds are rounded to six digits, half a step of which must not lose the rows at the threshold
        kept = matcher.decide(scores, float("inf") if threshold is None else threshold - 5e-7)
        agree = matcher.consistent(point, evaluate.macro_f05(evaluate.counters(truth, kept))).first()
        if not agree.holds:
            raise ValueError(f"the sweep has {agree.swept} at the chosen threshold, a direct count {agree.measured}")
        return point

    def _pairs(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        truth, pairs = self.truth(split)
        return truth, pairs, self.read_candidates(split)

    def analyze(self, split: str = "train", retention: float = 0.8957, step: int = 1, most: int | None = 50_000) -> list[str]:
        """What blocking finds and misses, as tables under reports/<split>/errors: blockers, their combinations (of as many
        blockers as the run has), entities, diagnoses and causes of missed pairs against recovered ones (every ``step``-th,
        ``most`` at most), examples, proposals with their cost, and the metric chain."""
        truth, pairs, found = self._pairs(split)
        s1, targets = self.s1(split), self.targets(split)
        kinds = tuple(k for k in blocking.ORDER if k in self.config.blockers)
        rows = staged(errors.masked(found, pairs, truth, kinds), "masked")
        by_entity = staged(evaluate.counters(truth, evaluate.mark_true(found, pairs)), "counters")
        sample = errors.contrast(pairs, found, step, most)
        texts = features.joined_text(sample, files.only_wanted(s1, sample.select("s1_id")), files.only_wanted(targets, sample.select("target_id")))
        diagnosed = staged(errors.diagnose(texts.where("text_join_ok")).drop("text_join_ok"), "diagnosed")
        proposals = errors.proposal_value(errors.proposal_recall(s1, targets, pairs, truth, found), errors.proposal_growth(s1, targets), found.count(), retention)
        tables = {
            "blockers": errors.blocker_table(rows, pairs, kinds),
            "combinations": errors.combination_table(rows, kinds),
            "entities": errors.entity_accounting(by_entity),
            "unknown_rows": evaluate.unknown_rows(truth, found),
            "diagnosis": errors.diagnosis_summary(diagnosed, "group"),
            "causes": errors.cause_table(diagnosed, "group"),
            "examples": errors.examples(diagnosed),
            "proposals": proposals,
            "metric_chain": errors.metric_chain(by_entity, retention),
        }
        for name, df in tables.items():
            self.report(split, f"errors/{name}", df)
        return list(tables)

    def calibrate(self, split: str = "train", kind: str = "char", budget: int | None = 400_000_000) -> int:
        """The grid of a blocker under reports/<split>/calibrate; taken up again where a table of the same inputs is there."""
        truth, pairs = self.truth(split)
        val = F.when(is_validation(F.col("s1_id"), self.config.val_fraction, self.config.split_mode), "val").otherwise("train")
        make = lambda: calibrate.calibrated(self.s1(split), self.targets(split), pairs, truth, kind, val, budget, char=self.config.char)
        inputs = [self.path("prepared"), self.path("raw", split, "truth.tsv")]
        return resumed(self.spark, self.path("reports", split, f"calibrate_{kind}"), inputs, make, (kind, budget, self.config)).count()

    def statistics(self, split: str = "train") -> list[str]:
        """Offline statistics under reports/<split>/statistics. Targets are read and the pairs' statistics made once."""
        truth, pairs = self.truth(split)
        s1, targets = self.s1(split), self.targets(split)
        made = staged(statistics.pair_statistics(pairs, s1, targets), "pairs")
        signals = statistics.signal_columns(made)
        census = staged(statistics.census(s1, targets, truth), "census")
        classified = staged(names.classify(features.joined_text(pairs, s1, targets).where("text_join_ok")), "names")
        tables = {
            "coverage": statistics.signal_coverage(signals),
            "combinations": statistics.signal_combinations(signals),
            "grid": statistics.signal_grid(made),
            "addresses": statistics.address_overlap(made),
            "postings": statistics.posting_summary(targets),
            "posting_caps": statistics.posting_caps(targets),
            "rarity": statistics.pair_rarity(made),
            "census": statistics.census_summary(census),
            "census_by_cap": statistics.census_by_cap(census),
            "zero_match": statistics.zero_match_risk(s1, targets, truth),
            "name_differences": names.difference_table(classified),
            "name_tokens": names.token_histogram(classified),
        }
        for name, df in tables.items():
            self.report(split, f"statistics/{name}", df)
        return list(tables)

    def report(self, split: str, name: str, df: DataFrame) -> int:
        """A table of results as one CSV-like file with tabs."""
        flat = df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        return files.published(flat.coalesce(1), self.path("reports", split, name), "tsv")

    def compare(self, others: dict[str, str], split: str = "train", threshold: float | None = None) -> DataFrame:
        """This run's scores against those of runs at other roots, at one threshold (this run's chosen one)."""
        read = lambda root: self.spark.read.parquet("/".join([root, "scores", split]))
        if threshold is None:
            threshold = self.spark.read.parquet(self.path("operating_point")).first()["chosen_threshold"]
        truth = self.truth(split)[0].join(read(self.root).select("s1_id").distinct(), "s1_id", "left_semi")
        out = staged(matcher.ab_compare({"this": read(self.root)} | {n: read(r) for n, r in others.items()}, truth, threshold), "compared")
        if out.where("not holds").count():
            raise ValueError("a run differs from itself")
        return out

    def predict(self, split: str = "test", score: str | None = None) -> DataFrame:
        """Writes the submission, unless a check fails; returns the checks."""
        rows = self.spark.read.parquet(self.path("features", split))
        if score:
            scored = rows.withColumn("score", matcher.threshold_score(score))
        else:
            scored = matcher.predict(rows, list(features.TYPES), matcher.load_models(self.path("model"), self.config.folds, list(features.TYPES)))
        threshold = self.spark.read.parquet(self.path("operating_point")).first()["chosen_threshold"]
        s1 = self.s1(split)
        selected = matcher.decide(scored, float("inf") if threshold is None else threshold)
        made = matcher.submission(s1, selected)
        # what is checked is what was written; only then does it get its place
        partial = self.path("submission", f"{split}.unchecked.tsv")
        files.write_single(made, partial, "row_pos")
        written = files.read_tsv(self.spark, partial, files.TRUTH).drop("row_pos")
        checks = staged(matcher.submission_checks(s1, scored, selected, made, written), "checks")
        if broken := [r["name"] for r in checks.where("NOT holds").collect()]:
            raise SubmissionError(f"the submission is not published: {', '.join(broken)}")
        files.write_single(made, self.path("submission", f"{split}.tsv"), "row_pos")
        return checks
