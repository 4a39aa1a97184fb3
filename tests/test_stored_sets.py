"""Published sets of tables, the nearest-row join, and forests on any number of cores."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxline.operators import asof, quality
from boxline.operators import customers as cust, index as ix, segments as seg
from boxline.sources import facts, publish, star, tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_readers_see_whole_sets_only(spark, tmp_path):
    folder = str(tmp_path / "sets")
    number = lambda n: spark.range(5).select("id", F.lit(n).alias("n"))
    seen = lambda: {name: spark.read.parquet(f"{publish.current(spark, folder)}/{name}.parquet").first()["n"] for name in ("a", "b", "c")}
    assert publish.current(spark, folder) == folder
    publish.publish({name: number(1) for name in "abc"}, folder, {"a": ("id",)})
    first = publish.current(spark, folder)
    broken = spark.range(1).select("id", F.raise_error(F.lit("stopped")).cast("int").alias("n"))
    with pytest.raises(PySparkException):
        publish.publish({"a": number(2), "b": number(2), "c": broken}, folder)
    assert publish.current(spark, folder) == first and seen() == {"a": 1, "b": 1, "c": 1}
    held = spark.read.parquet(f"{first}/b.parquet")
    for n in (3, 4):
        publish.publish({name: number(n) for name in "abc"}, folder)
    assert seen() == {"a": 4, "b": 4, "c": 4} and held.first()["n"] == 1  # a reader of an older set goes on
    publish.publish({name: number(5) for name in "abc"}, folder)
    assert len(publish.published(spark, folder)) == publish.KEEP and not os.path.exists(first.removeprefix("file:"))
    assert len(os.listdir(tmp_path / "sets" / "versions")) == publish.KEEP + 1  # the broken one is still young
    publish.expire(spark, folder, orphan_hours=0)
    assert sorted(os.listdir(tmp_path / "sets" / "versions")) == publish.published(spark, folder)
    assert json.load(open(tmp_path / "sets" / "manifests" / publish.published(spark, folder)[-1]))["tables"] == ["a", "b", "c"]


def test_tables_of_a_folder_without_manifests(spark, tmp_path):
    spark.range(3).withColumn("match_id", F.col("id")).write.parquet(str(tmp_path / "matches.parquet"))
    assert tables.load_matches(spark, str(tmp_path)).count() == 3


def test_saves_fold_into_one_base(spark, tmp_path):
    """Many saves leave few files; a save that was overtaken loses nothing."""
    path = str(tmp_path / "targets")
    row = lambda fixture, base, day: spark.sql(f"select '{fixture}' fixture_id, {base}d base_target, 12d stretch_target, timestamp_ntz'2024-01-01 00:00:00' + interval {day} day saved_at")
    for n in range(12):
        tables.save_targets(row(f"f{n % 3}", n, n), path)
    tables.save_targets(row("f0", 99, -5), path)  # an older row does not count
    stored = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(stored) <= 3 * publish.KEEP
    assert sorted((r.fixture_id, r.base_target) for r in tables.load_targets(spark, path).collect()) == [("f0", 9.0), ("f1", 10.0), ("f2", 11.0)]
    before = publish.current(spark, path)
    tables.save_targets(row("f3", 1, 50), path)
    with pytest.raises(publish.Conflict):
        publish.publish({"targets": row("f9", 1, 1)}, path, after=before)
    assert {r.fixture_id for r in tables.load_targets(spark, path).collect()} == {"f0", "f1", "f2", "f3"}


def test_customer_buckets_move_no_ticket(spark, tmp_path):
    plain = spark.range(4000).select(
        F.concat(F.lit("t"), F.col("id")).alias("transaction_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.abs(F.xxhash64("id")) % 300)).alias("customer_id"),
        F.concat(F.lit("202"), F.col("id") % 3, F.lit("/2"), F.col("id") % 3 + 1).alias("season_label"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 9000).cast("timestamp_ntz").alias("transaction_date"),
        F.lit("general").alias("sales_window"), F.lit(1.0).alias("tickets_sold"), (F.col("id") % 90).cast("double").alias("gross_revenue"), (F.col("id") % 2 == 0).alias("purchaser_family_flag"), F.lit(True).alias("marketing_opt_in"),
    )
    facts.write_facts(plain, str(tmp_path / "facts"), 8)
    laid = facts.read_facts(spark, str(tmp_path / "facts"))
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 8 * 3
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lived = cust.lifetime(plain, "salt")
        for made, wanted in (
            (cust.purchase_status(laid), cust.purchase_status(plain)), (cust.lifetime(laid, "salt"), lived),
            (cust.add_behaviour(laid, lived.withColumn("customer_id", F.upper("customer_id"))), cust.add_behaviour(plain, lived.withColumn("customer_id", F.upper("customer_id")))),
        ):
            lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
            join = next((i for i, line in enumerate(lines) if "SortMergeJoin" in line), 0)
            scan = next(i for i, line in enumerate(lines) if i >= join and "FileScan" in line)
            assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in lines[join:scan])
            rows = made.select(*wanted.columns)
            assert rows.exceptAll(wanted).count() == 0 and rows.count() == wanted.count()
        assert "Exchange" not in cust.lifetime(laid, "salt")._jdf.queryExecution().executedPlan().toString()
        again = F.explode(F.when(F.col("transaction_id").endswith("7"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        bare = lambda df: quality.repeated_share(df.withColumns({"order_id": F.lit("o"), "fixture_id": F.lit(None).cast("string"), "copy": again}))
        assert bare(laid).first() == bare(plain).first() and bare(plain).first()[0] == 1 - 4000 / 4400
        assert "Exchange hashpartitioning" not in bare(laid)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in cust.purchase_status(laid)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_row(spark, seed):
    r = random.Random(seed)
    kind = "id int, k string, g int, at int"
    some = lambda n: [(i, r.choice(["a", "b", None]), r.choice([1, 2]), r.choice([*range(40), None])) for i in range(n)]
    rows, others = some(60), some(r.choice([3, 40]))
    frame, other = spark.createDataFrame(rows, kind), spark.createDataFrame([(*o, o[0] % 4) for o in others], kind + ", d int")
    found = asof.nearest(frame, other, ["k", "g"], F.col("at"), F.col("at"), "id", ["d"])
    assert found.columns == ["id", "k", "g", "at", "nearest"] and found.count() == len(rows)
    for row in found.collect():
        fit = [(abs(o[3] - row["at"]), o[0] % 4, o[0]) for o in others if o[1] == row["k"] and o[2] == row["g"] and o[3] is not None and row["at"] is not None]
        assert (tuple(row["nearest"]) if row["nearest"] else None) == (min(fit) if fit else None)
    assert asof.nearest(frame, other.where("false"), [], F.col("at"), F.col("at"), "id").where("nearest is not null").count() == 0


def test_forests_do_not_depend_on_cores():
    code = (
        "import sys\n"
        "from pyspark.sql import functions as F\n"
        "from boxline.operators import features, forest\n"
        "from boxline.sources.session import local_session\n"
        "spark = local_session(cores=sys.argv[1], shuffle_partitions=int(sys.argv[1]) + 1, memory='2g')\n"
        "rows = spark.range(600, numPartitions=int(sys.argv[1]) + 2).select(F.concat(F.lit('m'), F.col('id') % 40).alias('match_id'), F.col('id').alias('date'),\n"
        "    *[(F.xxhash64('id', F.lit(c)) % 50).cast('double').alias(c) for c in features.NUMERIC if c != 'cumulative_sales'], F.col('id').cast('double').alias('cumulative_sales'),\n"
        "    *[F.concat(F.lit(c), F.abs(F.xxhash64('id', F.lit(c)) % 4)).alias(c) for c in features.CATEGORICAL], (F.abs(F.xxhash64('id')) % 3000 + F.col('id') * 5).cast('double').alias('final_sales'))\n"
        "made = forest.fit(rows, forest.ForestSettings(trees=12, max_depth=8))\n"
        "found = forest.predict(made, rows.filter('date % 9 = 0').withColumn('match_id', F.col('date').cast('string'))).orderBy('match_id').collect()\n"
        "print('RESULT', [tuple(r) for r in found])\n"
    )
    said = []
    for cores in ("2", "8"):
        done = subprocess.run([sys.executable, "-c", code, cores], capture_output=True, text=True, cwd=ROOT, timeout=400)
        assert not done.returncode, done.stderr[-2000:]
        said.append(next(line for line in done.stdout.splitlines() if line.startswith("RESULT")))
    assert said[0] == said[1] and len(said[0]) > 1000


def test_load_moves_compact_rows_once(spark, tmp_path):
    path = str(tmp_path)
    put = lambda name, df: df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    at = F.lit("1998-03-01").cast("timestamp_ntz")
    put("region", spark.sql("select 0 r_regionkey, 'ASIA' r_name"))
    put("nation", spark.sql("select cast(id as int) n_nationkey, concat('N', id) n_name, if(id = 4, null, 0) n_regionkey from range(5)"))
    put("supplier", spark.sql("select id s_suppkey, cast(id % 5 as int) s_nationkey from range(5)"))
    put("customer", spark.sql("select id c_custkey, cast(id % 25 as int) c_nationkey, if(id = 3, null, id - 2.0D) c_acctbal, 'HOUSEHOLD' c_mktsegment from range(20)"))
    put("part", spark.sql("select id p_partkey, 'Brand#1' p_brand, 'PROMO' p_type, cast(id * 30 as int) p_size from range(3)"))
    put("orders", spark.range(300).select(F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.when(F.col("id") % 3 == 0, "P").otherwise("O").alias("o_orderstatus"), (at + F.make_dt_interval(F.col("id").cast("int"))).alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")))
    put("lineitem", spark.sql(
        "select id div 4 l_orderkey, id % 3 l_partkey, id % 5 l_suppkey, cast(id % 4 + 1 as int) l_linenumber, 2.0D l_quantity, 10.0D l_extendedprice, if(id % 7 = 0, 0.0D, 0.1D) l_discount,"
        " if(id % 2 = 0, 0.08D, null) l_tax, if(id % 3 = 0, 'R', 'N') l_returnflag, 'O' l_linestatus from range(1200)"))
    plan = star.transactions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(l_suppkey" in line for line in plan.split("\n"))  # the whole of lineitem was moved for it
    m, laid = star.load(spark, path), star.bucketed(spark, path)
    wanted = cust.purchase_status(star.transactions(spark, path))
    assert m.tickets.count() == 960 and m.tickets.select(*wanted.columns).exceptAll(wanted).count() == 0  # a fifth has a nation without region
    assert laid.select(*m.tickets.columns).exceptAll(m.tickets).count() == 0 and laid.count() == 960
    assert "Exchange" not in cust.lifetime(laid, "salt")._jdf.queryExecution().executedPlan().toString()
    # Distinct seasons no longer move the groups a second time.
    assert cust.lifetime(m.tickets, "salt")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    seasons = m.tickets.where("customer_id is not null").groupBy("customer_id").agg(F.count_distinct("season_label").alias("n"))
    assert sorted(m.customers.where("has_ticket_history").select("customer_id", "seasons_purchased_count").collect()) == sorted(seasons.collect())


def test_index_reads_the_buckets_once(spark, tmp_path, monkeypatch):
    path, plans, kept = str(tmp_path / "facts"), [], ix.materialise
    rows = spark.sql(
        "select concat('t', id) transaction_id, concat('o', id div 2) order_id, if(id % 9 = 0, null, concat('C', id div 2 % 20)) customer_id, 'BBL' competition,"
        " if(id % 3 = 0, '2026/27', '2025/26') season_label, cast(if(id % 3 = 0, '2026-09-01', '2025-09-01') as timestamp_ntz) transaction_date, date'2025-12-31' match_date,"
        " 'Presale' sales_window, if(id % 2 = 0, 'Gold', null) ticket_class, 'Adult' price_type, id % 5 = 0 is_comp, false is_refund, 1.0D paid_tickets_sold, 0.0D comp_tickets_sold,"
        " 1.0D tickets_sold, cast(id as decimal(18,4)) gross_revenue from range(400)"
    )
    people = spark.sql("select concat('C', id) customer_id, cast(id as double) lifetime_tickets, cast(id as double) lifetime_revenue, 'Presale' usual_purchase_window from range(15)")
    matches = spark.sql("select '2026/27' season_label, 'BBL' competition, date'2026-12-31' event_date")
    facts.write_facts(rows, path, 8)
    # A ticket's order is not what it is moved by, and its row is written before five aggregates read it.
    monkeypatch.setattr(ix, "materialise", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        measures = lambda tickets: ix.index_measures(tickets, people, matches, "2026/27", "BBL", "2026-10-01", seg.SEGMENT_PRODUCT)
        laid = sorted(map(str, measures(facts.read_facts(spark, path)).collect()))
        assert laid == sorted(map(str, measures(facts.read_plain(spark, path)).collect())) and len(laid) > 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ["order_id" in line for plan in plans for line in plan.split("\n") if "Exchange hashpartitioning" in line].count(True) > 0
    assert not any("Exchange" in line and "order_id" in line for line in plans[0].split("\n"))
