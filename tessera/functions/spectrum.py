"""Spectra of evenly sampled series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def real_spectrum(series: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """(by, k, re, im) of each group's values in the order of t: the real forward transform, not scaled.

    A group is one transform and must fit a task; cut long series into blocks first.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.rfft(pdf.sort_values(t)[value].to_numpy(float))
        return pd.DataFrame({by: pdf[by].iloc[0], "k": np.arange(len(f)), "re": f.real, "im": f.imag})

    return series.select(by, t, value).groupBy(by).applyInPandas(work, f"{by} {dict(series.dtypes)[by]}, k long, re double, im double")
