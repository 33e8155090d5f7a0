from quarry.llm import common


def test_checkpoint_leaves_no_shuffle_files(spark):
    """What was shuffled for a checkpoint goes with it, and the session's setting stays as it was."""
    was = spark.conf.get(common.CLEANUP)
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = store.shuffleStatuses().size()
    kept = common.checkpointed(spark.range(1000).repartition(5, "id").groupBy("id").count())
    assert store.shuffleStatuses().size() <= before and kept.count() == 1000 and spark.conf.get(common.CLEANUP) == was
