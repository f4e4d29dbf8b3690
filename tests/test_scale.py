"""Mechanisms that hold at scale: ladders as data, exact medians, packed ranks, pruned runs, counted writes."""

import os
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings import base, filing_queries, run_queries, stream_queries
from accountloom.functions import ordered
from accountloom.operators import extraction, ladders, parameters, results, valuation
from accountloom.plans import screening
from accountloom.sources import filings, records, sinks
from accountloom.streaming import daily


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- ladders ---------------------------------------------------------------------------

def ladder(spark, vintage, step=0.0):
    return parameters.stored_ladder(spark).select(
        "table", F.lit(vintage).alias("vintage"), F.col("row").cast("int").alias("row"), "coverage_from", "rating", "rating_full",
        (F.col("spread") + step).alias("spread"), F.lit(4300.0).alias("cutoff"))


def test_ladder_look_up_agrees_with_the_constants(spark):
    covers = [-1e6, -0.5, 0.0, 0.2, 0.65, 1.25, 2.0, 3.0, 4.25, 6.5, 8.5, 12.4999, 12.5, 1e9, float("inf"), None]
    rows = [(t, "2024-01", c) for t in ("LARGE", "SMALL") for c in covers] + [("LARGE", "1999-01", 3.0)]
    companies = spark.createDataFrame(rows, "credit_table string, ladder_vintage string, coverage double")
    got = ladders.look_up(companies, ladder(spark, "2024-01"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    found = {(r.credit_table, r.ladder_vintage, r.coverage): (r.implied_rating, r.ladder_spread) for r in got.collect()}
    assert len(found) == len(rows)
    for table, vintage, cover in rows:
        want = (None, None)
        if vintage == "2024-01" and cover is not None:
            rungs = [r for r in sorted(spec.LADDERS[table]) if r[0] <= cover]
            want = (rungs[-1][1], rungs[-1][3]) if rungs else want
        assert found[table, vintage, cover] == want


def test_valuation_follows_the_ladder_of_its_vintage(spark, sf_dir):
    inputs = run_queries._valuation_inputs(spark, sf_dir)
    constant = {r.lei: r for r in valuation.value_companies(inputs).collect()}
    both = ladder(spark, "2024-01").unionByName(ladder(spark, "2025-01", 0.02))
    dated = inputs.withColumn("ladder_vintage", F.explode(F.array(F.lit("2024-01"), F.lit("2025-01"))))
    rows = {(r.lei, r.ladder_vintage): r for r in valuation.value_companies(dated, both).collect()}
    assert len(rows) == 2 * len(constant) > 0
    for lei, r in constant.items():
        assert rows[lei, "2024-01"].wacc == pytest.approx(r.wacc, rel=1e-12) and rows[lei, "2024-01"].verdict == r.verdict
        later = rows[lei, "2025-01"]
        assert later.synthetic_rate == pytest.approx(r.synthetic_rate + 0.02) and later.wacc >= r.wacc


def test_applied_ladder_reaches_the_valuation(spark, sf_dir):
    """A fetched ladder is applied to the store, and companies are valued with it from its month on."""
    fetched = ladder(spark, "x", 0.01).drop("vintage", "cutoff")
    applied = parameters.apply_ladder(ladder(spark, "2024-01"), fetched, F.lit("2025-03-09").cast("date")).drop("next_expected")
    store = ladder(spark, "2024-01").unionByName(applied.select(*ladder(spark, "x").columns))
    for day, vintage in (("2025-03-31", "2025-03"), ("2025-02-28", "2024-01")):
        now = ladders.vintage_in_force(store, F.lit(day).cast("date"))
        assert {r.vintage for r in now.collect()} == {vintage} and now.count() == 30
    assert ladders.vintage_in_force(store, F.lit("2020-01-01").cast("date")).count() == 0
    age = spark.range(1).select(ladders.ladder_age_days(F.lit("2024-01"), F.lit("2024-02-01").cast("date")).alias("d"))
    assert age.first().d == 31


def test_ladder_out_of_order_is_told(spark):
    rows = [("LARGE", "v", 0, 0.0, 1.0), ("LARGE", "v", 1, 5.0, 2.0), ("LARGE", "v", 2, 3.0, 3.0), ("SMALL", "v", 0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "table string, vintage string, row int, coverage_from double, spread double")
    got = {(r.table, r.row): (r.coverage_to, r.ladder_ascending) for r in ladders.rung_ranges(table).collect()}
    assert got == {("LARGE", 0): (3.0, False), ("LARGE", 2): (5.0, False), ("LARGE", 1): (None, False), ("SMALL", 0): (None, True)}


# -- exact median -----------------------------------------------------------------------

@pytest.mark.parametrize("small, pieces", [(4096, 256), (40, 16)])
def test_exact_median(spark, small, pieces):
    import statistics

    r = random.Random(4)
    groups = {
        "even": [r.random() for _ in range(400)], "odd": [r.gauss(0, 1e6) for _ in range(401)], "one": [7.5], "two": [1.0, 4.0],
        "ties": [1.0] * 300 + [2.0] * 301 + [r.random() for _ in range(50)], "equal": [3.0] * 90,
        "far": [10.0 ** r.randint(-300, 300) for _ in range(333)], None: [r.random() for _ in range(77)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: x.m for x in ordered.exact_median(df, ["g"], F.col("v"), "m", small, pieces).collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}
    assert ordered.exact_median(df.where("g = 'none'"), ["g"], F.col("v")).count() == 0


# -- grouping sets ------------------------------------------------------------------------

def test_totals_are_those_of_the_buckets(spark, sf_dir):
    rows = run_queries._results(spark, sf_dir)
    table = {r.size_bucket: r for r in results.size_by_verdict_with_total(rows).collect()}
    assert set(table) == {b[0] for b in spec.SIZE_BUCKETS} | {"all"}
    for c in ("n", "void", "under", "fair", "over"):
        assert table["all"][c] == sum(r[c] for k, r in table.items() if k != "all")
    assert table["all"].n == rows.count()
    text = plan(results.size_by_verdict_with_total(rows))
    assert text.count("Expand") >= 1 and text.count("orders.parquet") <= 2


# -- packed ranks ---------------------------------------------------------------------------

def test_best_duplicates_are_hashed_not_sorted(spark, sf_dir):
    facts = filings.numeric_facts(filing_queries._parsed(spark, sf_dir))
    text = plan(extraction.best_facts(facts))
    # The names of concepts are few; facts, grouped by filing, are never sorted.
    for text in (text, plan(extraction.field_candidates(facts))):
        assert "SortAggregate(key=[lei" not in text and "HashAggregate(keys=[lei" in text


def test_documents_of_a_filing_are_neighbours(spark, sf_dir):
    docs = base.filing_documents(spark, sf_dir).select(*extraction.KEYS, F.spark_partition_id().alias("part"))
    per_task = docs.groupBy("part", *extraction.KEYS).count()
    filed, tasks = docs.select(*extraction.KEYS).distinct().count(), docs.select("part").distinct().count()
    assert tasks > 1 and per_task.count() <= filed + tasks - 1  # a task cuts one filing at most


def test_tasks_follow_the_documents_not_the_setting(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(base, "DOCUMENTS_PER_TASK", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    docs = base.filing_documents(spark, sf_dir).withColumn("part", F.spark_partition_id())
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < docs.select("part").distinct().count() <= lines // 500
    repeated = docs.groupBy("doc_no").count().where("count > 1")
    assert docs.count() == lines and repeated.count() == 0


def test_extraction_shuffles_the_best_facts_only(spark, sf_dir):
    """Facts meet once, as whole numbers by their names; candidates then come together by filing, and stay."""
    text = plan(extraction.named_facts(filings.numeric_facts(filing_queries._parsed(spark, sf_dir))))
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
    named = filing_queries._named(spark, sf_dir)
    few = spark.createDataFrame([], "_cid long, concept string")
    text = plan(extraction.named_candidates(named, F.broadcast(few)))
    assert text.count("hashpartitioning") == 1 and "hashpartitioning(lei" in text


def test_facts_are_reduced_where_they_are_parsed(spark, sf_dir):
    """No shuffle between documents and the best facts; a name crosses to its filing once, before it is opened."""
    facts = filings.numeric_facts(filing_queries._facts(spark, sf_dir, base.DEALT))
    text = plan(extraction.named_facts(facts, base.DEALT))
    reduced = text[:text.index("rangepartitioning")]
    assert "HashAggregate(keys=[lei" in reduced and "hashpartitioning" not in reduced
    few = spark.createDataFrame([], "_cid long, concept string")
    text = plan(extraction.named_candidates(filing_queries._named(spark, sf_dir), F.broadcast(few)))
    assert text.index("Generate explode(places") < text.index("hashpartitioning") and text.count("Generate") == 1


def test_a_filing_of_many_documents_is_cut_into_pieces(spark, sf_dir, monkeypatch):
    """Pieces ascend with the order of facts, are in several tasks, and give the same company-years."""
    want = sorted(map(str, filing_queries._stored_vote(spark, sf_dir).collect()))
    monkeypatch.setattr(base, "DOCUMENTS_PER_TASK", 20)
    docs = base.filing_documents(spark, sf_dir).withColumn("part", F.spark_partition_id())
    cut = docs.groupBy(*extraction.KEYS).agg(F.max("piece").alias("last"), F.count_distinct("part").alias("tasks"))
    assert cut.where("last > 1 AND tasks > 1").count() > 0
    ranges = docs.groupBy(*base.DEALT).agg(F.min("doc_no").alias("a"), F.max("doc_no").alias("b"), F.count_distinct("part").alias("tasks"))
    assert ranges.where("tasks > 1").count() == 0
    pieces = sorted((r.lei, r.fiscal_year, r.piece, r.a, r.b) for r in ranges.collect())
    assert all(x[4] < y[3] for x, y in zip(pieces, pieces[1:]) if x[:2] == y[:2])
    got = sorted(map(str, filing_queries._stored_vote(spark, f"{sf_dir}/").collect()))  # another path: nothing stored is read
    assert got == want


def test_texts_are_read_once_per_group_of_facts(spark, sf_dir, tmp_path):
    """Only values are read of every fact; concepts and periods of what the aggregation leaves, in the same task."""
    opened = filings.open_documents(base.filing_documents(spark, sf_dir), base.DEALT, ["doc_no"])
    named = extraction.named_written_facts(filings.valued_facts(opened), base.DEALT, filings.read_texts)
    text = plan(named)
    below = text[text.index("HashAggregate"):]
    assert below.count("Generate") == 2 and text.count("Generate") > 2 and "SortAggregate" not in text
    assert "hashpartitioning" not in text[:text.index("rangepartitioning")]
    opened.write.parquet(str(tmp_path / "opened"))  # the numbers of documents are given once
    opened = spark.read.parquet(str(tmp_path / "opened"))
    named = extraction.named_written_facts(filings.valued_facts(opened), base.DEALT, filings.read_texts)
    cells = [*extraction.KEYS, "end", "kind", "concept", "local_name"]
    combined = lambda df: sorted(df.groupBy(*cells).agg(
        F.min("rank"), F.min_by("value", "rank"), F.sum("n"), F.min("seen")).collect())
    assert combined(named) == combined(extraction.named_facts(filings.numeric_facts(filings.classify_facts(opened, base.DEALT)), base.DEALT))


def test_only_names_at_the_year_end_are_opened(spark, sf_dir):
    """The year end comes from counts per end date: no window over candidates, and no name is judged twice."""
    named = filing_queries._named(spark, sf_dir)
    names = extraction.names_in_use(named)
    few = F.broadcast(spark.createDataFrame([], "_cid long, concept string"))
    heads = screening.filing_headers(base.filing_heads(spark, sf_dir))
    placed = extraction.placed_names(names).localCheckpoint()
    text = plan(extraction.named_company_years(heads, named, few, placed=F.broadcast(placed), parts=7))
    assert "Window" not in text and "RLIKE" not in text
    assert text.index("Generate explode(places") < text.index("ShuffledHashJoin") < text.index("REPARTITION_BY_NUM")
    assert text.count("REPARTITION_BY_NUM") == 1
    assert 0 < placed.count() < names.select("kind", "local_name").distinct().count()


def test_rank_order(spark):
    rows = [(True, "iso4217:USD", 1), (True, "iso4217:EUR", 9), (False, "iso4217:EUR", 0), (True, None, 0), (True, "iso4217:EUR", 10)]
    df = spark.createDataFrame(rows, "is_ifrs boolean, unit string, ord long")
    order = [(r.is_ifrs, r.unit, r.ord) for r in df.withColumn("rank", extraction.fact_rank()).orderBy("rank").collect()]
    assert order == [rows[1], rows[4], rows[3], rows[0], rows[2]]


def test_document_numbers_ascend(spark):
    rows = [(i * 7 % 1000, i % 3, f"d{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, body string").repartition(5)
    got = [(r.a, r.b) for r in filings.number_documents(df, ["a", "b"]).orderBy("doc_no").collect()]
    assert got == sorted((a, b) for a, b, _ in rows)
    with pytest.raises(ValueError):
        filings.parse_documents(df, ["a"], ["a", "b"])


# -- runs, counters, store ---------------------------------------------------------------------

def test_newest_run_reads_its_partition_only(spark, tmp_path):
    rows = [(date(2024, 1, d), f"L{i}") for d in (1, 8, 15) for i in range(d)]
    path = str(tmp_path / "runs")
    sinks.write_partitions(spark.createDataFrame(rows, "run_date date, lei string"), path, ["run_date"])
    runs = records.read_runs(spark, path)
    newest = records.latest_run(runs)
    assert newest.count() == 15 and records.earlier_runs(runs).count() == 9
    filters = [x for x in plan(newest.select("lei", "run_date")).split("\n") if "PartitionFilters" in x][0]
    assert "ubquery" in filters.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert records.latest_run(runs.where("lei = 'nobody'")).count() == 0


def test_counts_beside_a_write(spark, tmp_path):
    rows = spark.createDataFrame([(2020 + i % 3, "a" if i % 4 else "b") for i in range(100)], "fiscal_year int, status string")
    counts = sinks.write_counted(rows, str(tmp_path / "t"), ["fiscal_year"], {
        "a": F.count_if(F.col("status") == "a"), "b": F.count_if(F.col("status") == "b"), "c": F.count_if(F.col("status") == "c")})
    assert counts == {"a": 75, "b": 25, "c": 0} and spark.read.parquet(str(tmp_path / "t")).count() == 100
    assert {r.outcome: r.n for r in sinks.count_rows(spark, counts).collect()} == {"a": 75, "b": 25}


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_writes_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "store")
    header = "lei string, fiscal_year int, status string"
    fact = "lei string, fiscal_year int, field string, value double"
    leis = [f"L{i}" for i in range(40)]
    h = spark.createDataFrame([(x, y, "complete") for x in leis for y in (2020, 2021)], header)
    f = spark.createDataFrame([(x, y, k, 1.0) for x in leis for y in (2020, 2021) for k in ("revenue", "ebit")], fact)
    sinks.upsert_company_years(spark, path, h, f, buckets=8)
    before = files_of(path)
    new_h = spark.createDataFrame([("L3", 2020, "failed"), ("L5", 2021, "partial"), ("new", 2021, "complete")], header)
    new_f = spark.createDataFrame([("L5", 2021, "revenue", 9.0)], fact)
    sinks.upsert_company_years(spark, path, new_h, new_f, buckets=8)
    after = files_of(path)
    kept = {x for x in before if after.get(x) == before[x]}
    touched = {os.path.dirname(x) for x in set(before) ^ set(after)} | {os.path.dirname(x) for x in after if before.get(x) != after[x]}
    assert len(touched) <= 6 and all(os.path.dirname(x) not in touched for x in kept) and len(kept) >= len(before) - 6
    headers = {(r.lei, r.fiscal_year): r.status for r in sinks.read_table(spark, f"{path}/company_year").collect()}
    assert len(headers) == 81 and headers["L3", 2020] == "failed" and headers["L3", 2021] == "complete"
    facts = [(r.lei, r.fiscal_year, r.field, r.value) for r in sinks.read_table(spark, f"{path}/fact").collect()]
    assert len(facts) == 160 - 2 - 2 + 1 and ("L5", 2021, "revenue", 9.0) in facts
    assert not [x for x in facts if x[:2] == ("L3", 2020)]


def test_upsert_drops_partitions_without_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    header, fact = "lei string, fiscal_year int, status string", "lei string, fiscal_year int, field string, value double"
    sinks.upsert_company_years(spark, path, spark.createDataFrame([("a", 2020, "complete")], header),
                               spark.createDataFrame([("a", 2020, "ebit", 1.0)], fact), buckets=2)
    sinks.upsert_company_years(spark, path, spark.createDataFrame([("a", 2020, "failed")], header),
                               spark.createDataFrame([], fact), buckets=2)
    assert not files_of(f"{path}/fact") and len(files_of(f"{path}/company_year")) == 1


def test_broken_index_files_are_listed(spark, tmp_path):
    (tmp_path / "IT.json").write_text('[{"lei": "a", "reporting_date": "2024-01-31"}, {"lei": "b", "last_end_date": "2023-12-31"}, {"x": 1}]')
    (tmp_path / "DE.json").write_text('[{"lei": "c", "reporting_date": "2024-01-31"}, {"lei": "d", "repor')
    (tmp_path / "FR.json").write_text("<html>busy</html>")
    good, bad = filings.read_index_files(spark, str(tmp_path))
    assert {(r.lei, r.country) for r in good.collect()} == {("a", "IT"), ("b", "IT")}
    assert sorted((r.file, r.reason) for r in bad.collect()) == [
        ("DE.json", "does not parse"), ("FR.json", "does not parse"), ("IT.json", "no index record")]
    assert {r.lei for r in filings.read_filing_index(spark, str(tmp_path)).collect()} == {"a", "b"}


# -- stream ---------------------------------------------------------------------------------------

def test_overlapping_files_give_every_fetch_once(spark, tmp_path):
    schema = "lei string, as_of date, fetched_at timestamp, price double, currency string, status string"
    source = str(tmp_path / "in")
    for batch in range(4):
        days = [2 * batch + 1, 2 * batch + 2, 2 * batch + 3]  # the last day comes again with the next file
        rows = [(x, date(2024, 1, d), f"2024-01-{d:02d} 09:00:00", float(d), "EUR", "ok") for x in "ab" for d in days]
        df = spark.createDataFrame([(*r, ) for r in rows], schema.replace("fetched_at timestamp", "fetched_at string"))
        df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{source}")
    stream = daily.read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    unique = daily.unique_stream(stream, F.lit("2024-01-12").cast("date"))
    daily.store_unique(unique, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.lei, r.as_of.day): r.fetches for r in daily.stored_fetches(spark, str(tmp_path / "out")).collect()}
    assert got == {(x, d): 1 for x in "ab" for d in range(1, 10)}
    assert len(os.listdir(tmp_path / "out")) >= 3


def _largest_method(df, capsys):
    """Bytes of the largest generated method; the JVM does not compile one beyond 8000."""
    capsys.readouterr()
    df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_the_parser_of_documents_is_compiled(spark, capsys, tmp_path):
    row = ("A", 2000, 1, '{"facts": {"f0": {"value": "1", "dimensions": {"concept": "ifrs-full:Assets", "period": "2001-01-01T00:00:00"}}}}')
    spark.createDataFrame([row], "lei string, fiscal_year int, doc_no long, body string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert _largest_method(filings.parse_documents(docs, ["lei", "fiscal_year"], ["doc_no"]), capsys) <= 8000


def test_no_task_writes_whole_turns_of_the_stream(spark, tmp_path):
    days = spark.range(0, 4000, numPartitions=4).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 20 * 86400).alias("ts"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a split per file
    try:
        days.write.parquet(str(tmp_path / "events.parquet"))
        stream_queries._overlapping_files(spark, str(tmp_path), str(tmp_path / "files"))
        turns = sorted((tmp_path / "files").iterdir(), key=lambda p: int(p.name[5:]))
        assert [p.name for p in turns] == [f"turn={n}" for n in range(6)]
        assert all(len(list(p.glob("*.parquet"))) == 4 for p in turns)
        held = [spark.read.parquet(str(p)).agg(F.count(F.lit(1)), F.countDistinct("ts")).first() for p in turns]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(h) for h in held] == [(800, 4), *[(1600, 8)] * 4, (800, 4)]


def test_the_record_of_a_valuation_is_written_and_read_once(spark, sf_dir):
    text = plan(run_queries.sidecar_records(spark, sf_dir))
    assert text.count("StructsToJsonEvaluator") == 1 and text.count("from_json(") == 1 and text.count("Scan parquet") == 2
