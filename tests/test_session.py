"""What release() gives back."""

import time

from lodestar.session import cut, release


def test_shuffle_files_go_with_released_frames(spark):
    """Rounds of frames that are made and released do not pile up their shuffles on the disk."""
    held = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = held.size()
    for k in range(12):
        release(cut(spark.range(100 + k).repartition(3).groupBy("id").count()))
    until = time.time() + 5
    while held.size() > before + 6 and time.time() < until:
        time.sleep(0.2)
    assert held.size() <= before + 6  # two a round were made
