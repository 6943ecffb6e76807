from hammerline.llm import bpe, common


def test_what_a_worker_keeps_goes_before_a_task_of_another_kind():
    first = bpe.encoder(bpe.default_vocabulary())
    assert list(common.released(lambda batches: batches, keeps=True)(iter([1]))) == [1]
    assert bpe.encoder(bpe.default_vocabulary()) is first
    assert list(common.released(lambda batches: batches)(iter([1]))) == [1]
    assert not common._kept


def test_executors_collect_their_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    common.collect_garbage(spark)
    assert sum(b.getCollectionCount() for b in beans()) > before
