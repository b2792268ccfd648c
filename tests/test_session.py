"""Cluster settings helpers."""

from kestrel.session import resilience_conf, scale_conf


def test_scale_conf_sizes_partitions():
    c = scale_conf(100 * 1024 ** 4, 8000)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)
    assert 100_000 <= int(c["spark.sql.shuffle.partitions"]) <= 110_000
    small = scale_conf(10 * 1024 ** 2, 16)
    assert int(small["spark.sql.shuffle.partitions"]) == 48  # never below 3 x cores


def test_resilience_conf_migrates_blocks():
    c = resilience_conf()
    assert c["spark.decommission.enabled"] == "true"
    assert c["spark.storage.decommission.shuffleBlocks.enabled"] == "true"
