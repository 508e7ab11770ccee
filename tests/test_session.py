"""Shared-folder helpers: scale tags, the shared folder and checkpoints."""

from pyspark.sql import functions as F

from roadstats.session import reliable_checkpoint, scale_tag, shared_dir


def test_scale_tag_keeps_name_and_separates_paths():
    a, b = scale_tag("/data/x/sf0.01"), scale_tag("/data/y/sf0.01/")
    assert a.startswith("sf0.01-") and b.startswith("sf0.01-") and a != b
    assert scale_tag("/data/x/sf0.01/") == a


def test_shared_dir_is_the_configured_folder(spark):
    conf = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == conf.rstrip("/")


def test_reliable_checkpoint_cuts_lineage_and_frees_memory(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).groupBy("v").count()
    ck = reliable_checkpoint(df)
    assert sorted(tuple(r) for r in ck.collect()) == sorted(tuple(r) for r in df.collect())
    plan = ck._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan          # reads the checkpoint, not the lineage
    assert not df.is_cached                 # the temporary persist was released
