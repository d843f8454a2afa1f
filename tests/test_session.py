"""Settings that every registered query runs under."""

from pyspark.sql import functions as F

from lumirank import session
from lumirank.plans import registry


def test_registered_queries_bound_what_a_task_reads(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_SIZE", "1m")
    monkeypatch.setattr(registry, "QUERIES", {})
    monkeypatch.setattr(registry, "SQL", {})
    names = [f"spark.sql.adaptive.{n}" for n in ("advisoryPartitionSizeInBytes", "coalescePartitions.initialPartitionNum")]
    old = {k: spark.conf.get(k, None) for k in names}

    @registry.query("parts")
    def _(s, sf):
        return s.range(3_000_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))

    try:
        for k in names:
            spark.conf.unset(k)
        # the session has four shuffle partitions: without more to merge, a task would read a quarter of any table
        parts = registry.QUERIES["parts"](spark, "").select(F.spark_partition_id().alias("p")).distinct()
        assert parts.count() > 20
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
