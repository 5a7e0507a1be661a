import numpy as np
import pytest
from fixtures import CUBE

from sumloom.functions.paths import Indices
from sumloom.functions.semiring import Arctic, Reals
from sumloom.operators.sums import IteratedSums
from sumloom.streaming.online import advance, online_sums


@pytest.mark.parametrize("ring", [Reals(), Arctic()], ids=lambda r: r.name)
def test_steps_in_pieces(ring):
    sums = IteratedSums(("[1][2][1]", "[12]"), True, ring)
    want = np.stack(list(sums.arrays(CUBE)))[:, 0]
    state, out = None, []
    for a, b in ((0, 2), (2, 3), (3, 5)):
        part, state = advance(sums, CUBE[0][:, a:b], state)
        out.append(part)
    np.testing.assert_allclose(np.concatenate(out, axis=1), want)


def test_stream(spark, tmp_path):
    rows = [(i, t, *map(float, CUBE[i, :, t])) for i in range(2) for t in range(5)]
    schema = "series_id long, t long, x1 double, x2 double"
    for k, (a, b) in enumerate(((0, 2), (2, 5))):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    sums = IteratedSums(("[1][2]",), True)
    out = online_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), sums, ["x1", "x2"])
    q = out.writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = np.array([[r.s1, r.s2] for r in spark.table("sums").orderBy("series_id", "t").collect()]).reshape(2, 5, 2)
    np.testing.assert_allclose(got.transpose(2, 0, 1), np.stack(list(sums.arrays(CUBE))))
    with pytest.raises(ValueError):
        online_sums(spark.range(1), IteratedSums(("[1]",), weighting=Indices()), ["x1"])
