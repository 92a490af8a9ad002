"""A word file that grows between batches is decoded as the whole file would be."""

import numpy as np

from lumenframe.sources import decode, encode
from lumenframe.streaming import recordings


def test_a_file_that_grows_is_decoded_once_and_as_a_whole(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = np.concatenate([encode.words(c, np.sort(rng.integers(c << 28, (c + 1) << 28, 200)), rng.integers(1, 4, 200), c < 9) for c in (3, 4, 5, 6)])
    folder, work, size = tmp_path / "in", tmp_path / "work", 1 << 18
    folder.mkdir()
    seen = []
    for to in (len(w) // 3, len(w) // 3 + 17, 4 * len(w) // 5, len(w)):
        w[:to].tofile(folder / "a.bin")
        query = recordings.decoded_as_it_grows(spark, str(folder), str(work), size).trigger(availableNow=True).start()
        query.awaitTermination(300)
        seen.append(recordings.events(spark, str(work)).where("kind = 'photon'").count())
    assert seen[0] <= seen[1] <= seen[2] <= seen[3] and 0 < seen[3]
    recordings.finish(spark, str(folder), str(work), size)
    columns = ["kind", "pos", "beam", "color", "tick", "phase"]
    got = recordings.events(spark, str(work)).where("beam = 1 and kind in ('photon', 'aod')").select(*columns).collect()
    cut = decode.ranges(spark, str(folder), size)
    want = decode.decoded(cut, decode.index(decode.scan(cut))).where("beam = 1 and kind in ('photon', 'aod')").select(*columns).collect()
    assert len(got) == len(want) and sorted(map(str, got)) == sorted(map(str, want))
