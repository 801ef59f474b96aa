import gzip
import os
import shutil
import zipfile

import pytest

from recordloom.__main__ import main
from recordloom.config import KeyConfig, LinkConfig
from recordloom.functions.text import BLOCKERS
from recordloom.operators import matcher
from recordloom.plans.jobs import Run
from recordloom.plans.resume import resumed
from recordloom.sources import files
from recordloom.streaming import candidates as streaming

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def root(tmp_path):
    for split in ("train", "test"):
        (tmp_path / "raw" / split).mkdir(parents=True)
        for n in (1, 2, 3):
            rows = "".join(f"S{n}-{i}\tName{chr(97 + i % 20)}{i} Group Ltd\t{i} Main St\t{'NA' if i % 2 else ''}\n" for i in range(1, 31))
            (tmp_path / "raw" / split / f"source{n}.tsv").write_text(HEAD + rows)
        (tmp_path / "raw" / split / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{'' if i % 5 == 0 else f'S2-{i}, S3-{i}'}\n" for i in range(1, 31)))
    return str(tmp_path)


def test_whole_run(spark, root):
    run = Run(spark, root)
    assert run.prepare(("train", "test")) == 180
    assert {(r.split, r.source): r.rows for r in run.manifest().collect()}["train", 2] == 30
    assert run.s1("train").where("country = 'NA'").count() == 15, "NA is text"
    assert run.postings()["token"] > 0
    n = run.candidates("train")
    assert n == run.candidates("test") >= 60
    got = {r.split: r for r in run.evaluate().collect()}
    assert got["all"].blocking_recall_pair == 1.0 and got["all"].n_true_pairs == 48
    assert run.features("test") == n and 0 < run.features("train") < n, "auto takes the validation entities of training data"
    assert run.features("train", entities="all") == n
    chosen = run.train("train", score="name_token_jaccard").first()
    assert chosen.chosen_macro_f05 > 0.7
    assert all(r.holds for r in run.predict("test", score="name_token_jaccard").collect())
    out = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/submission/test.tsv")
    assert out.count() == 30 and out.where("matched_entity_ids LIKE 'S2-1,%'").count() >= 1


def test_reports(spark, root):
    run = Run(spark, root, LinkConfig(blockers=BLOCKERS), "tsv")
    run.prepare(("train",))
    assert run.s1("train").where("address_norm = '1 main st'").count() == 1, "a prepared table of TSV reads like one of Parquet"
    run.candidates("train")
    read = lambda name: spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{root}/reports/train/{name}")
    assert all(read(f"errors/{n}").count() for n in run.analyze("train") if n not in ("causes", "examples", "diagnosis"))
    assert read("errors/combinations").count() == 15 and read("errors/proposals").count() == 14
    assert {r.group for r in read("errors/diagnosis").collect()} <= {"missed", "recovered"}
    assert all(read(f"statistics/{n}").columns for n in run.statistics("train"))
    n = run.calibrate("train", "token", budget=10**9)
    assert n == run.calibrate("train", "token", budget=10**9) > 12


def test_runs_are_compared(spark, root, tmp_path):
    run = Run(spark, root)
    run.prepare(("train",))
    run.candidates("train")
    run.features("train", entities="all")
    run.train("train", score="name_token_jaccard")
    shutil.copytree(root, str(tmp_path / "other"))
    other = Run(spark, str(tmp_path / "other"))
    other.train("train", score="name_length_ratio")
    got = {r.run: r for r in run.compare({"same": root, "length": other.root}).collect()}
    assert got["same"].delta_score_zero == 0 and got["length"].n_rows >= got["this"].n_rows


def test_models_are_checked_when_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(f"S1-{i}", i // 2 % 2, i % 2, float(i % 2) + (i % 5) / 9, None if i % 3 else 1.0) for i in range(60)], "s1_id string, fold int, label int, x double, y double")
    settings = matcher.TreeSettings(rounds=2, least_rows=1)
    scored, models = matcher.out_of_fold(rows, ["x", "y"], 2, settings)
    assert scored.where("(score > 0.5) = (label = 1)").count() == 60
    path = str(tmp_path / "model")
    matcher.save_models(models, path, ["x", "y"], settings)
    assert matcher.describe_models(spark, path) == {"folds": 2, "features": ["x", "y"], "settings": {"depth": 5, "least_rows": 1, "rate": 0.05, "rounds": 2, "seed": 42}}
    back = matcher.predict(rows, ["x", "y"], matcher.load_models(path, 2, ["x", "y"]))
    assert back.where("(score > 0.5) = (label = 1)").count() == 60
    with pytest.raises(ValueError, match="folds"):
        matcher.load_models(path, 3)
    with pytest.raises(ValueError, match="z"):
        matcher.load_models(path, 2, ["x", "z"])


def test_indexes_know_what_they_are(spark, root):
    run = Run(spark, root)
    run.prepare(("train",))
    counts = run.postings()
    assert run.load_postings("train", "token").count() == counts["token"] and run.load_frequencies("train", "char").count() == counts["char_df"]
    with pytest.raises(ValueError, match="settings"):
        Run(spark, root, LinkConfig(token=KeyConfig(7, 2))).load_postings("train", "token")
    path = f"{root}/postings/train/token"
    with pytest.raises(ValueError, match="char postings"):
        files.load_index(spark, path, "char postings")
    spark.read.parquet(f"{path}/rows").limit(1).write.parquet(f"{path}/short")
    shutil.rmtree(f"{path}/rows")
    shutil.move(f"{path}/short", f"{path}/rows")
    with pytest.raises(ValueError, match="1 of"):
        run.load_postings("train", "token")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.load_index(spark, f"{root}/nowhere", "token postings")


def test_missing_and_malformed_inputs(spark, root):
    with pytest.raises(FileNotFoundError, match="dev/source1.tsv"):
        Run(spark, root).prepare(("dev",))
    with open(f"{root}/raw/train/source2.tsv", "a") as f:
        f.write("S2-99\tonly two\n")
    assert files.malformed_rows(spark, f"{root}/raw/train/source2.tsv") == 1
    with pytest.warns(UserWarning, match="source2.tsv has 1 lines"):
        Run(spark, root).prepare(("train",))


def test_command_line(spark, root, capsys):
    assert main(["prepare", root]) == 0 and main(["candidates", root, "--blockers", "exact_name,suffix_stripped"]) == 0
    assert spark.read.parquet(f"{root}/candidates/train").where("array_contains(blockers, 'source2:token')").count() == 0
    assert main(["candidates", root, "--blockers", "nonsense"]) == 1 and "nonsense" in capsys.readouterr().err


def test_a_table_survives_a_broken_publication(spark, tmp_path):
    path = str(tmp_path / "out")
    files.published(spark.range(3), path)
    shutil.move(path, f"{path}.old")  # as a run leaves it that ends between the two renames
    assert files.read_published(spark, path).count() == 3
    assert files.published(spark.range(4), path) == 4 and not os.path.exists(f"{path}.old")


def test_single_file_and_zip(spark, tmp_path):
    path = str(tmp_path / "one.tsv")
    rows = spark.createDataFrame([(2, "b", ""), (1, "a", "x y"), (3, 'c"', "z")], "p int, i string, t string")
    assert files.write_single(rows, path, "p") == 3
    assert open(path).read() == 'i\tt\na\tx y\nb\t\nc"\tz\n'
    with zipfile.ZipFile(tmp_path / "x.tsv.zip", "w") as z:
        z.writestr("x.tsv", HEAD + 'S1-1\tA "q\t\tNULL\nS1-2\t\t\t\n')
    got = files.read_tsv(spark, str(tmp_path / "x.tsv.zip")).orderBy("row_pos").collect()
    assert [tuple(r)[:4] for r in got] == [("S1-1", 'A "q', "", "NULL"), ("S1-2", "", "", "")]


def test_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write(HEAD + 'S1-1\tA "quoted\t\tNULL\nS1-2\t\t\t\n')
    got = files.read_tsv(spark, str(tmp_path / "x.tsv.gz")).orderBy("row_pos").collect()
    assert [tuple(r)[:4] for r in got] == [("S1-1", 'A "quoted', "", "NULL"), ("S1-2", "", "", "")]
    assert files.first_rows(files.read_tsv(spark, str(tmp_path / "x.tsv.gz")), 1).count() == 1


def test_truth_keeps_entities_without_a_match(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\n")
    truth, pairs = files.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {r.s1_id: r.n_true for r in truth.collect()} == {"S1-1": 2, "S1-2": 0}
    assert {(r.target_id, r.source) for r in pairs.collect()} == {("S2-1", 2), ("S3-2", 3)}


def test_nothing_is_published_by_half(spark, tmp_path):
    path = str(tmp_path / "out")
    assert files.published(spark.range(3), path) == 3
    assert files.published(spark.range(5), path) == 5 and spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        files.published(spark.range(3), path, "xml")
    with pytest.raises(ValueError, match="b"):
        files.assert_schema(spark.range(1).toDF("a"), ["a", "b"])


def test_streams_equal_batches(spark, root, tmp_path):
    run = Run(spark, root)
    run.prepare(("train",))
    s1, targets = run.s1("train"), run.targets("train")
    source = str(tmp_path / "in")
    s1.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.start(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from recordloom.operators.blocking import block_exact, candidates

    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.s1_id, r.target_id) for r in got.collect()} == {(r.s1_id, r.target_id) for r in candidates(s1, targets).collect()}
    query = streaming.exact_stream(stream, targets).writeStream.format("memory").queryName("exact_pairs").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("exact_pairs").count() == block_exact(s1, targets).count()


def test_results_are_used_again_until_inputs_change(spark, tmp_path):
    source, made = str(tmp_path / "in"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 AS id")

    spark.range(3).write.parquet(source)
    for settings, n in ((1, 1), (1, 1), (2, 2)):
        assert resumed(spark, str(tmp_path / "out"), [source], make, settings).count() == 3 and len(made) == n
    spark.range(5).write.mode("overwrite").parquet(source)
    assert resumed(spark, str(tmp_path / "out"), [source], make, 1).count() == 5 and len(made) == 3
