from recordloom.sources import idlists, records, sinks

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_record_scan(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text(HEAD + 'S1-1\tNA\t"a ""q"" b"\tUS\nS1-2\t\t"two\nlines"\t\n\nS1-3\tit"s\t x \tFR\n')
    rows = {r.entity_id: r for r in records.load_source(spark, str(p)).collect()}
    assert rows["S1-1"].business_name == "NA" and rows["S1-1"].business_address == 'a "q" b'
    assert rows["S1-2"].business_name == "" and rows["S1-2"].business_address == "two\nlines" and rows["S1-2"].country == ""
    assert rows["S1-3"].business_name == 'it"s' and len(rows) == 3
    assert records.load_baseline(spark, str(p)).where("entity_id = 'S1-1'").first().business_name == ""
    assert records.load_source(spark, str(p), ["entity_id"]).columns == ["entity_id"]
    assert records.count_rows(records.load_source(spark, str(p))).first()[0] == 3
    assert len(list(records.iter_source_rows(records.load_source(spark, str(p))))) == 3


def test_truth(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2 \nS1-2\t\nS1-3\tS2-5\nS1-3\tS3-9\n")
    assert sorted(map(tuple, records.load_ground_truth(spark, str(p)).collect())) == [("S1-1", " S2-2"), ("S1-1", "S2-1"), ("S1-3", "S3-9")]


def test_paths_and_holdout(spark):
    assert records.dataset_paths("r")["ground_truth"] == "r/train/train_ground_truth.tsv" and "ground_truth" not in records.dataset_paths("r", "test")
    ids = spark.range(5000).selectExpr("concat('S1-', id) AS entity_id")
    share = records.holdout(ids, 0.2).where("is_holdout").count() / 5000
    assert 0.17 < share < 0.23


def test_write_and_read_results(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-1", "S2-9")], "source1_entity_id string, entity_id string")
    out = str(tmp_path / "m")
    sinks.write_tsv(sinks.matching_results(s1, pairs), out, single_file=True)
    assert (tmp_path / "m").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9,S3-1\nS1-2\t\n"
    sinks.write_tsv(sinks.matching_results(s1, pairs), out, single_file=True)  # in the earlier one's place
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["m"]
    assert sinks.candidate_pairs(s1, pairs).columns == ["source1_entity_id", "candidate_entity_ids"]


def test_id_scan(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("entity_id\tx\r\n S1-1 \ty\r\n\r\nS1-2\nS1-1\t\n")
    assert {r.id for r in idlists.read_ids(spark, str(p)).collect()} == {"S1-1", "S1-2"}


def test_files_without_quoted_feeds_are_split(spark, tmp_path):
    p = tmp_path / "big.tsv"
    p.write_text(HEAD + "".join(f'S1-{i}\t"name ""{i}"""\tstreet {i}\tUS\r\n' for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = records.load_source(spark, str(p))
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 4000
        assert rows.where("entity_id = 'S1-77'").first().asDict() == {"entity_id": "S1-77", "business_name": 'name "77"', "business_address": "street 77", "country": "US"}
        found = idlists.id_lists(idlists.body(spark, str(p)))
        assert {(r.source1_entity_id, r.line) for r in found.collect()} == {(f"S1-{i}", i + 2) for i in range(4000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
