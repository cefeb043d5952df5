import numpy as np
import pandas as pd

from casebook.spec import MatrixSpec


def matrix(spark, n=200, p=3, seed=0, signal=1.0):
    """Random cases with a label that depends on the first feature."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(3)
    y = (x[:, 0] * signal + rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(p)])
    pdf.insert(0, "label", y)
    pdf.insert(0, "case_id", [f"c{i:05d}" for i in range(n)])
    return spark.createDataFrame(pdf), MatrixSpec(tuple(f"f{i}" for i in range(p))), pdf


def survival_frame(spark, n=150, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(3)
    t = rng.exponential(np.exp(-0.7 * x[:, 0]))
    t = np.ceil(t * 8) if ties else t
    e = (rng.random(n) < 0.7).astype(int)
    pdf = pd.DataFrame({"case_id": [f"c{i:05d}" for i in range(n)], "event": e, "duration": t, "a": x[:, 0], "b": x[:, 1]})
    return spark.createDataFrame(pdf), MatrixSpec(("a", "b"), label="event", duration="duration"), pdf
