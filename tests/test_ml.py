import numpy as np
import pytest
from fixtures import CUBE, packed_rows
from pyspark.ml import Pipeline as MlPipeline
from pyspark.ml.feature import StandardScaler

from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import IteratedSums
from sumloom.plans.ml import Builder, SeriesFeatures


def test_builder():
    b = Builder("b").add(P.INC, IteratedSums(("[1]", "[2]")), S.MAX, S.PPV()).copycut().clear("sieves").add(S.END).sample(0.5).cut().add(IteratedSums(("[1]",)), S.MIN)
    p = b.switch(0).add(S.MIN).build()
    assert [len(s) for s in p.slices] == [6, 2, 1] and p.slices[1].fit_sample == 0.5 and len(p.slices[0].preparateurs) == 1
    with pytest.raises(TypeError):
        b.add(3)
    with pytest.raises(IndexError):
        b.switch(9)


def test_stage_of_ml(spark):
    df = packed_rows(spark, CUBE, [0, 1])
    p = Builder().add(IteratedSums(("[1]", "[2]", "[11]")), S.MAX).build()
    model = MlPipeline(stages=[SeriesFeatures(p, output="v", keep=("label",)), StandardScaler(inputCol="v", outputCol="z", withMean=True)]).fit(df)
    rows = model.transform(df).orderBy("series_id").collect()
    np.testing.assert_allclose([r.v.toArray() for r in rows], [[1.8, 3, 50.64], [21, -5, 129]])
    assert [r.label for r in rows] == [0, 1] and len(rows[0].z) == 3
