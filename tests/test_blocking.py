import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordloom.functions.text import prepare
from recordloom.operators import blocking as b
from recordloom.operators import overlap
from recordloom.plans import fixtures as fx

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    return frame(spark, [("S2-1", "Acme Inc", "123 Main", "US"), ("S2-2", "Acme Inc", "456 Oak", "India"), ("S3-1", "Acme Inc", "123 Main", "US"), ("S3-2", None, "", "US")])


def test_exact_name_keeps_countries_apart(spark, corpus):
    s1 = frame(spark, [("S1-1", "Acme Inc", None, "US"), ("S1-2", "ACME  inc.", None, "India"), ("S1-3", "Globex", None, "US"), ("S1-4", "", "", "US")])
    assert pairs(b.block(s1, corpus, "exact_name")) == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")}
    assert len(pairs(b.block(s1, corpus, "exact_name_global"))) == 6


def test_exact_address_hybrid_and_baseline(spark, corpus):
    s1 = frame(spark, [("S1-1", "Other", "123 main", "USA"), ("S1-2", "Acme Inc", "9 Elm", "India")])
    assert pairs(b.block(s1, corpus, "exact_address")) == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    assert pairs(b.block(s1, corpus, "hybrid")) == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")}
    assert len(pairs(b.block(s1, corpus, "baseline"))) == 5
    assert pairs(b.block(s1, corpus, "name_address")) == set()


def test_empty_country_is_a_country(spark):
    s1, corpus = frame(spark, [("S1-1", "Acme", "", "")]), frame(spark, [("S2-1", "Acme", "", None), ("S2-2", "Acme", "", "US")])
    assert pairs(b.block(s1, corpus, "exact_name")) == {("S1-1", "S2-1")}


def test_unknown_blocker():
    with pytest.raises(ValueError, match="unknown"):
        b.get_blocker("soundex")


def by_rules(s1, corpus, tokens, min_overlap, max_df, use_country=True):
    """The rules of token blocking, one query at a time."""
    index = defaultdict(list)
    for r in corpus:
        for t in r[tokens]:
            index[r.country if use_country else "", t].append(r.entity_id)
    out = set()
    for q in s1:
        lists = {t: index[q.country if use_country else "", t] for t in q[tokens] if (q.country if use_country else "", t) in index}
        valid = [t for t, ids in lists.items() if len(ids) <= max_df]
        if not valid and lists:
            valid = [min(lists, key=lambda t: (len(lists[t]), t))]
        n = Counter(e for t in valid for e in lists[t])
        out |= {(q.entity_id, e) for e, k in n.items() if k >= min_overlap or len(valid) < min_overlap and k == len(valid)}
    return out


@pytest.mark.parametrize(("tokens", "min_overlap", "max_df", "use_country"), [("name_tokens", 2, 100_000, True), ("name_tokens", 2, 5, True), ("address_tokens", 3, 20, True), ("name_tokens", 2, 8, False)])
def test_token_blocking_by_its_rules(spark, tables, tokens, min_overlap, max_df, use_country):
    s1, corpus = prepare(fx.s1(spark, tables)), prepare(fx.corpus(spark, tables))
    # an id that stands twice in the corpus counts its postings twice
    corpus = corpus.unionByName(corpus.limit(3))
    corpus = spark.createDataFrame(corpus.collect(), corpus.schema)
    own = b.TokenBlocker(tokens, min_overlap, use_country, max_df)
    assert pairs(own.candidates(s1, corpus)) == by_rules(s1.collect(), corpus.collect(), tokens, min_overlap, max_df, use_country)


@pytest.fixture
def small_cells(monkeypatch):
    """Many parts, blocks, salts and slices, and vectors beside lists, on a few records."""
    for name, value in (("PARTS", 3), ("PART_ROWS", 4), ("BLOCK_ROWS", 7), ("SLICE", 2), ("BATCH_IDS", 5), ("TASKS", 5), ("DENSE", 2)):
        monkeypatch.setattr(f"recordloom.operators.overlap.{name}", value)


def noisy(spark, ids, seed):
    """Records of a few tokens; ids stand on several rows, also of other countries, and one is null."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["US", "India"]), sorted(rng.sample("ab bc cd de ef fg gh hi ij jk".split(), rng.randrange(6)))) for i in ids]
    return spark.createDataFrame(rows, "entity_id string, country string, address_tokens array<string>")


def no_row_for_a_shared_token(blocked):
    """Whether pairs leave the plan without being summed up over their tokens in a shuffle."""
    return not re.search(r"keys=\[source1_entity_id#\d+, entity_id#\d+\]", blocked._jdf.queryExecution().executedPlan().toString())


def test_token_address_in_many_cells(spark, small_cells):
    s1, corpus = noisy(spark, [None, *(f"S1-{k}" for k in range(40))], 1), noisy(spark, [None, *(f"S2-{k % 50}" for k in range(60))], 2)
    own = b.TokenBlocker("address_tokens", 2, True, 8)
    found = own.candidates(s1, corpus)
    assert no_row_for_a_shared_token(found)
    assert sorted(found.collect(), key=str) == sorted(by_rules(s1.collect(), corpus.collect(), "address_tokens", 2, 8), key=str)


def test_token_global_counts_each_row_of_an_id(spark, small_cells):
    """Without countries the rows of an id in several countries are one record."""
    s1, corpus = noisy(spark, [f"S1-{k}" for k in range(30)], 3), noisy(spark, [f"S2-{k % 40}" for k in range(60)], 4)
    found = b.TokenBlocker("address_tokens", 2, False).candidates(s1, corpus)
    assert no_row_for_a_shared_token(found)
    assert sorted(found.collect()) == sorted(by_rules(s1.collect(), corpus.collect(), "address_tokens", 2, b.MAX_DF, False))


def test_token_name_of_one_name(spark, small_cells):
    """One group of equal names, which stands in several parts and blocks, gives each pair once."""
    s1, corpus = (frame(spark, [(f"{side}-{k}", "Acme Tools Inc", "", "US") for k in range(30)]) for side in ("S1", "S2"))
    found = b.block(s1, corpus, "token_name")
    assert no_row_for_a_shared_token(found)
    assert sorted(found.collect()) == sorted((f"S1-{i}", f"S2-{k}") for i in range(30) for k in range(30))


def test_token_name_bounded_falls_back_in_many_cells(spark, small_cells):
    """All but a few tokens are over the bound, so most queries have only their rarest one."""
    s1, corpus = noisy(spark, [f"S1-{k}" for k in range(30)], 5), noisy(spark, [f"S2-{k % 50}" for k in range(60)], 6)
    found = b.TokenBlocker("address_tokens", 3, True, 12).candidates(s1, corpus)
    assert no_row_for_a_shared_token(found)
    assert sorted(found.collect()) == sorted(by_rules(s1.collect(), corpus.collect(), "address_tokens", 3, 12))


def counted(n_queries, rows, min_overlap=1):
    """What a cell of one token gives for so many records, in the order of its lists."""
    lists = pa.list_(pa.string())
    held = pa.record_batch({"tokens": pa.array([["ab", f"own{k}"] for k in range(rows)], lists), "entities": pa.array([[f"S2-{k}"] for k in range(rows)], lists)})
    asked = pa.record_batch({"tokens": pa.array([["ab"]] * n_queries, lists), "sources": pa.array([[f"S1-{k}"] for k in range(n_queries)], lists)})
    found = overlap._Index([held]).matches(asked, min_overlap)
    return [(s, e) for batch in found for s, e in zip(batch.column("sources").to_pylist(), batch.column("entities").to_pylist(), strict=True)]


def test_token_name_pairs_leave_by_stretches_of_records():
    """The ids of a stretch come for one query after the other, before those of the next stretch do; each pair comes once."""
    found = counted(20, 3000)
    assert max(len(e) for _, e in found) <= 256
    assert [s for s, _ in found[:20]] == [[f"S1-{k}"] for k in range(20)] and len({tuple(e) for _, e in found[:20]}) == 1
    assert sorted((s[0], e) for s, ids in found for e in ids) == sorted((f"S1-{i}", f"S2-{k}") for i in range(20) for k in range(3000))


def test_token_name_bounded_fallback_leaves_by_stretches():
    """One valid token under an overlap of three: each record that has it, in short lists."""
    found = counted(5, 2000, 3)
    assert max(len(e) for _, e in found) <= 256
    assert sorted((s[0], e) for s, ids in found for e in ids) == sorted((f"S1-{i}", f"S2-{k}") for i in range(5) for k in range(2000))


def test_token_global_writes_little_for_queries_of_the_same_records(spark, tmp_path):
    """25 different queries share two tokens with each of 40,000 records of two countries."""
    of = lambda side, n: spark.range(n).selectExpr(f"concat('{side}-', id) AS entity_id", "if(id % 2 = 0, 'us', 'india') AS country", "array('aa', 'bb', concat('c', id % 25)) AS name_tokens")
    b.TokenBlocker(use_country=False).candidates(of("S1", 25), of("S2", 40_000)).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == found.distinct().count() == 25 * 40_000
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 1_500_000


def test_token_global_block_stays_in_a_dictionary(spark, tmp_path):
    """Ids of 100,000 records, more than a column's dictionary takes, are written as places in two dictionaries."""
    s1, corpus = spark.range(30).selectExpr("concat('S1-', id) AS entity_id", "'' AS country", "array('aa', concat('b', id)) AS name_tokens"), spark.range(100_000).selectExpr("concat('S2-', id) AS entity_id", "'' AS country", "array('aa') AS name_tokens")
    b.TokenBlocker(min_overlap=1, use_country=False).candidates(s1, corpus).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == found.distinct().count() == 30 * 100_000
    chunks = [pq.read_metadata(p).row_group(0).column(1) for p in tmp_path.glob("pairs/*.parquet") if pq.read_metadata(p).num_rows]
    assert chunks and all("PLAIN" not in c.encodings for c in chunks)


def test_token_name_bounded_tasks_have_cells_of_a_block(spark, monkeypatch):
    """Twelve cells in four tasks: each task has those of one of three blocks, so few ids stand in its file."""
    for name, value in (("PARTS", 4), ("PART_ROWS", 4), ("BLOCK_ROWS", 20), ("TASKS", 4)):
        monkeypatch.setattr(f"recordloom.operators.overlap.{name}", value)
    s1, corpus = (spark.range(n).selectExpr(f"concat('{side}-', id) AS entity_id", "'' AS country", "array('aa', concat('b', id)) AS name_tokens") for side, n in (("S1", 40), ("S2", 60)))
    found = b.TokenBlocker(min_overlap=1, max_df=1).candidates(s1, corpus.withColumn("name_tokens", F.expr("array('aa')")))
    rows = found.select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r[:2] for r in rows}) == len(rows) == 40 * 60
    assert all(len({r.entity_id for r in rows if r.task == t}) < 40 for t in {r.task for r in rows})


def test_no_cartesian_product_and_pushed_columns(spark, tables):
    plan = b.block(fx.s1(spark, tables), fx.corpus(spark, tables), "token_name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_inputs(spark, corpus):
    none = frame(spark, [])
    for name in b.BLOCKERS:
        assert pairs(b.block(none, corpus, name)) == set() == pairs(b.block(corpus, none, name))
