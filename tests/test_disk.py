"""What loads, sets and exports leave on disk, and that nothing moves which lies right already."""

import gzip
import os
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from boxline.operators import customers as cust
from boxline.plans import queries
from boxline.sources import facts, publish, session, star, tables
from boxline.sources.csv import read_export


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def tickets(spark):
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("20"), F.col("id") % 5, F.lit("/2 x"))).alias("season_label"), F.concat(F.lit("C"), F.col("id") % 40).alias("customer_id"),
    )


def test_sets_of_placed_tables_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Rows that lie by season are written from where they are, those without a season and repeated ones too."""
    rows = tickets(spark).unionByName(tickets(spark).filter("id % 10 = 0"))
    rows.write.partitionBy("season_label").parquet(str(tmp_path / "load"))
    lying = spark.read.parquet(str(tmp_path / "load"))
    some = spark.range(3).select(F.lit("assumed").alias("fixture_status"), "id")
    whole = {n: lying if n in star.BY_SEASON else some for n in tables.PROCESSED}
    before = shuffle_files(spark)
    tables.write_processed(whole, str(tmp_path / "moved"))
    assert shuffle_files(spark) <= before  # a finished write leaves none
    monkeypatch.setattr(publish, "released", lambda spark: nullcontext())
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    tables.write_processed(whole, str(tmp_path / "sets"), placed=star.BY_SEASON)
    assert shuffle_files(spark) <= before and spark.conf.get("spark.sql.files.maxPartitionBytes") == split
    for folder in ("moved", "sets"):
        back = tables.load_processed(spark, str(tmp_path / folder))["transactions_normalised"].select(*rows.columns)
        assert back.count() == 3300 and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_settings_are_put_back(spark):
    before = [spark.conf.get(k, None) for k in ("spark.sql.constraintPropagation.enabled", "boxline.none")]
    with pytest.raises(ValueError), session.conf(spark, {"spark.sql.constraintPropagation.enabled": "false", "boxline.none": "1"}):
        assert spark.conf.get("boxline.none") == "1"
        raise ValueError
    assert [spark.conf.get(k, None) for k in ("spark.sql.constraintPropagation.enabled", "boxline.none")] == before


def test_facts_finished_in_their_bucket(spark, tmp_path):
    """Texts made after the move give the same tickets, each customer in one bucket, buyers without id spread."""
    narrow = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("buyer"))
    finish = lambda rows: rows.select(F.col("id").cast("string").alias("order_id"), F.concat(F.lit("C"), "buyer").alias("customer_id"))
    before = shuffle_files(spark)
    with session.released(spark):
        facts.write_facts(narrow, str(tmp_path / "late"), 8, by=(), finish=finish, key=facts.bucket_key(F.concat(F.lit("C"), "buyer"), F.col("id").cast("string")))
        facts.write_facts(finish(narrow), str(tmp_path / "early"), 8, by=())
    assert shuffle_files(spark) <= before
    files = lambda name: sorted(p.name.split("_")[-1].split(".")[0] for p in (tmp_path / name).rglob("*.parquet"))
    assert files("late") == files("early") and len(files("late")) <= 8
    late, early = (facts.read_facts(spark, str(tmp_path / n), by=()) for n in ("late", "early"))
    assert late.exceptAll(early).isEmpty() and early.exceptAll(late).isEmpty() and late.count() == 2000
    assert cust.CUSTOMER_KEY in late.columns and late.filter("customer_id is null").select(cust.CUSTOMER_KEY).distinct().count() > 100


def test_mixed_export_is_small_and_reads_as_plain_text(spark, tmp_path, monkeypatch):
    """Compressed files give the same rows, numbers and rejects as their text, and printing them leaves no shuffle files."""
    some = spark.range(600, numPartitions=3).select(
        F.concat(F.lit("t"), "id").alias("txn_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("say \"hi\", o"), F.col("id") % 40)).alias("order_number"),
        F.element_at(F.array(*map(F.lit, ("Adult", "Group", "Junior"))), (F.col("id") % 3 + 1).cast("int")).alias("price_code"), F.lit("Online").alias("channel"),
        F.when(F.col("id") % 5 == 0, "REFUNDED").otherwise("Sold").alias("ticket_status"),
    )
    monkeypatch.setattr(queries, "raw_tickets", lambda spark, sf_dir: some.unionByName(some.limit(20)).repartition(3, "txn_id"))
    before = shuffle_files(spark)
    folder = queries.mixed_export(spark, "")
    assert shuffle_files(spark) <= before
    packed = [f for f in os.listdir(folder) if f.startswith("part-")]
    plain = tmp_path / "plain"
    plain.mkdir()
    for name in packed:
        (plain / name.removesuffix(".gz")).write_bytes(gzip.decompress(open(f"{folder}/{name}", "rb").read()))
    assert all(f.endswith(".gz") for f in packed) and sum(os.path.getsize(f"{folder}/{f}") for f in packed) * 2 < sum(f.stat().st_size for f in plain.iterdir())
    loads = [read_export(spark, str(p)) for p in (folder, plain)]
    assert sorted(p.encoding for p in loads[0].parts) == sorted(p.encoding for p in loads[1].parts) and len(loads[0].parts) > 1
    shown = lambda rows: sorted(str({**r.asDict(), "source_file": r["source_file"].removesuffix(".gz")}) for r in rows.collect())
    frames, rejects = [shown(x.frame) for x in loads], [shown(x.rejects) for x in loads]
    assert frames[0] == frames[1] and rejects[0] == rejects[1] and len(rejects[0]) > 30 and len(frames[0]) + len(rejects[0]) == 620
