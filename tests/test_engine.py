"""The registered queries against their SQL, the streams, the matcher and the commands."""

import glob
import os

import duckdb
import pytest

from recordloom import cli
from recordloom.operators import blocking, matching
from recordloom.plans import fixtures as fx
from recordloom.plans.oracles import ORACLES
from recordloom.plans.queries import QUERIES
from recordloom.sources import records, sinks
from recordloom.streaming import incremental


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, duck, tables, name):
    got, want = QUERIES[name](spark, tables).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_golden_numbers(spark, tables):
    if not tables.endswith("sf0.001"):
        pytest.skip("numbers of sf0.001")
    counts = {k: QUERIES[k](spark, tables).count() for k in ("block_exact_name", "block_exact_address", "block_stripped_name", "block_name_address", "block_hybrid", "block_token_name", "block_token_address", "baseline_matches")}
    assert list(counts.values()) == [91, 86, 147, 64, 113, 932, 1187, 96]
    assert QUERIES["f05_macro"](spark, tables).first()[0] == 0.84


def test_matcher_beats_its_candidates(spark, tables):
    from recordloom.operators import metrics

    s1, corpus, truth = fx.s1(spark, tables), fx.corpus(spark, tables), records.truth_pairs(fx.truth(spark, tables))
    pairs = blocking.block(s1, corpus, "token_name")
    featured = matching.labelled(matching.pair_features(pairs, s1, corpus), truth).cache()
    kept = matching.matches(matching.score_pairs(matching.fit_matcher(featured), featured), 0.5)
    assert metrics.f05_macro(s1, kept, truth).first()[0] > metrics.f05_macro(s1, pairs, truth).first()[0] + 0.1
    assert kept.join(pairs, ["source1_entity_id", "entity_id"], "left_anti").count() == 0


def test_streams_equal_batch(spark, tables, tmp_path):
    s1, corpus = fx.s1(spark, tables), fx.corpus(spark, tables)
    s1.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.link_stream(arriving(), corpus).writeStream.format("memory").queryName("linked").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in blocking.block(s1, corpus, "exact_name").collect()}
    assert {tuple(r) for r in spark.table("linked").collect()} == want
    seen = set()
    own = blocking.get_blocker("token_name")
    q = incremental.block_stream(arriving(), corpus, own, lambda df, _: seen.update(map(tuple, df.collect())), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == {tuple(r) for r in blocking.block(s1, corpus, "token_name").collect()}


def test_commands(spark, tables, tmp_path, capsys):
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        for k, df in ((1, fx.s1(spark, tables)), (2, fx.s2(spark, tables)), (3, fx.s3(spark, tables))):
            df.toPandas().to_csv(tmp_path / split / f"{split}_source{k}.tsv", sep="\t", index=False)
    fx.truth(spark, tables).toPandas().to_csv(tmp_path / "train/train_ground_truth.tsv", sep="\t", index=False)
    test, m, c = str(tmp_path / "test"), str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv")
    assert cli.main(["baseline", "-t", test, "--out", m]) == 0
    assert cli.main(["block", "-t", test, "--out", c, "--method", "hybrid"]) == 0
    assert len((tmp_path / "m.tsv").read_text().splitlines()) == fx.s1(spark, tables).count() + 1
    assert cli.main(["validate", "-m", m, "-c", c, "-t", test, "--check-ids"]) == 0
    assert "passed" in capsys.readouterr().out
    # a folder of part files, each with its header, says the same
    sinks.write_tsv(spark.read.csv(m, sep="\t", header=True).na.fill("").repartition(3), str(tmp_path / "parts"))
    assert cli.main(["validate", "-m", str(tmp_path / "parts"), "-c", c, "-t", test, "--check-ids"]) == 0
    with open(m, "a") as f:
        f.write("S1-1 without a tab\n")
    assert cli.main(["validate", "-m", m, "-c", c, "-t", test]) == 1
    assert f"line {fx.s1(spark, tables).count() + 2:6}: S1-1 without a tab" in capsys.readouterr().out
    log = tmp_path / "logs" / "results.csv"
    row = cli.benchmark(spark, str(tmp_path), "exact_name", 1000, str(log)).first()
    assert row.candidate_recall == pytest.approx(0.5625)
    cli.benchmark(spark, str(tmp_path), "hybrid", 1000, str(log))
    header, *rows = log.read_text().splitlines()
    assert header.startswith("method,sample_size,candidate_recall,avg_candidates") and [r.split(",")[0] for r in rows] == ["exact_name", "hybrid"]
    assert "load_time" in capsys.readouterr().out


def test_matches_of_held_out_records(spark, tables):
    s1 = records.holdout(fx.s1(spark, tables), 0.3)
    pairs = blocking.block(s1, fx.corpus(spark, tables), "hybrid")
    truth = records.truth_pairs(fx.truth(spark, tables))
    got = matching.match_holdout(s1, fx.corpus(spark, tables), pairs, truth, [0.2, 0.5, 0.8])
    held = {r.entity_id for r in s1.where("is_holdout").collect()}
    rows = {tuple(r) for r in got.collect()}
    right = {tuple(r) for r in truth.collect()}
    assert rows and {a for a, _ in rows} <= held and rows <= {tuple(r) for r in pairs.collect()}
    assert len(rows & right) / len(rows) > 0.9
