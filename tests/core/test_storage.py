import threading

from fabula.plans.storage import materialize, scratch


def test_blocks_of_two_threads_dont_meet(spark):
    """A block that ends in one thread leaves the tables of another."""
    begun, ended, got = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            table = materialize(spark.range(5), "other")
            begun.set()
            ended.wait(60)
            got.append(table.count())

    thread = threading.Thread(target=other)
    thread.start()
    begun.wait(60)
    with scratch(spark):
        mine = materialize(spark.range(3), "mine")
        with scratch(spark):
            kept = materialize(spark.range(4), "kept", kept=True)
            materialize(spark.range(2), "gone")
        assert mine.count() == 3 and kept.count() == 4
    ended.set()
    thread.join()
    assert got == [5]
