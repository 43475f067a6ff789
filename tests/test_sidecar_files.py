"""Files' tables from sections: only the projects that may hold a first label are numbered, and odd keys come out as in SQL."""

import duckdb
from pyspark.sql import functions as F

from framekit.plans import catalog
from framekit.plans.fixtures import TABLES, table, view
from framekit.plans.q_io import first_tracks
from framekit.sources import sidecar

SF = "/root/testdata/sf0.01"


def test_few_sections_are_numbered_for_the_first_labels(spark):
    rows = first_tracks(view(spark, SF, "lineitem")).cache()
    sections = view(spark, SF, "fx_section").filter("start_frame < 4")
    assert rows.count() < sections.count() / 8
    every = sections.select(
        (F.col("project_id") % 200).alias("cvbs_file_id"), (F.col("project_id") * 10 + F.col("section_no")).alias("section_no"),
        F.col("start_frame").alias("channel_pair"), F.when(F.col("pn_anchor").isNull(), "").otherwise(F.col("name")).alias("label"),
    )
    got, want = (sorted(map(str, sidecar.audio_pair_rows(r).collect())) for r in (rows, every))
    assert got == want and len(got) > 700


def test_long_projects_repeated_orders_and_null_keys(spark, tmp_path):
    """The label of project 1 stands at its section 2,050, behind the first section of project 201 of the same file; order 3 is there twice."""
    for name in TABLES:
        if name not in ("lineitem", "orders"):
            (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    line = table(spark, "/root/testdata/sf0.001", "lineitem").limit(1)
    keys = spark.range(2103).select(
        F.when(F.col("id") < 2100, 1).when(F.col("id") < 2101, 201).when(F.col("id") < 2102, 3).cast("bigint").alias("l_orderkey"),
        F.when(F.col("id") < 2100, F.col("id") + 1).otherwise(1).cast("int").alias("l_linenumber"),
        F.when((F.col("id") >= 2049), 0.08).otherwise(0.01).alias("l_discount"), (F.col("id") + 1).alias("l_partkey"), F.lit(6).cast("bigint").alias("l_suppkey"),
    )
    keys.crossJoin(line.drop(*keys.columns)).select(*line.columns).coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    order = table(spark, "/root/testdata/sf0.001", "orders").limit(1).drop("o_orderkey")
    ids = spark.createDataFrame([(1,), (201,), (3,), (3,)], "o_orderkey bigint")
    ids.crossJoin(order).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog.QUERIES["sidecar_files"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if name in ('lineitem', 'orders') else ''}'")
    want = con.sql(catalog.ORACLES["sidecar_files"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
    assert ("audio_channel_pair", 1, "1|sec_2101") in [tuple(r) for r in rows]
