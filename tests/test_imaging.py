import numpy as np
from pyspark.sql import functions as F

from phasemill.jobs import imaging
from phasemill.sources import dataset

SF = "/root/testdata/sf0.001"


def test_simulate_and_reconstruct(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    imaging.simulate(spark, SF, folder)
    d = dataset.read(spark, folder)
    assert d.scan.count() == d.data.count() == 500 and d.probe.shape == d.lens.shape == (8, 8)
    assert np.isclose(abs(d.probe).max(), 1) and 0 < d.lens.sum() < 64
    image, residuals, *_ = imaging.reconstruct(spark, folder, 3)
    rows = residuals.orderBy("iter").collect()
    assert rows[-1].r_data < rows[0].r_data
    assert imaging.last_error(residuals).first()["nmse"] == rows[-1].r_truth
    assert imaging.last_error(residuals.limit(0)).first()["nmse"] is None
    assert image.filter(F.col("re").isNull()).count() == 0
