"""Sizing helpers and the shared checkpoint folder."""

from quire.session import TARGET_PARTITION_BYTES, checkpoint_dir, partitions_for, scale_conf

def test_partitions_for():
    assert partitions_for(None, minimum=8) == 8
    assert partitions_for(0, minimum=3) == 3
    assert partitions_for(10 * TARGET_PARTITION_BYTES + 1) == 11
    assert partitions_for(10 ** 18) == -(-10 ** 18 // TARGET_PARTITION_BYTES)  # no cap


def test_scale_conf_for_100_tb():
    conf = scale_conf(100 * 2 ** 40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 16000
    assert conf["spark.sql.files.maxPartitionBytes"] == "128m"


def test_checkpoint_dir_is_set(spark):
    path = checkpoint_dir(spark)
    assert path
