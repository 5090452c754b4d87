"""Arrow-vectorised column functions that Spark has no built-in for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import kernels


@pandas_udf(T.LongType())
def float_bits(x: pd.Series) -> pd.Series:
    """IEEE bits of a 32-bit float."""
    return pd.Series(x.to_numpy(np.float32).view(np.uint32).astype(np.int64))


@pandas_udf(T.FloatType())
def bits_float(x: pd.Series) -> pd.Series:
    return pd.Series((x.to_numpy(np.int64) & 0xFFFFFFFF).astype(np.uint32).view(np.float32))


@pandas_udf(T.StringType())
def shortest_17(x: pd.Series) -> pd.Series:
    """A double with 17 significant digits, no trailing zeros."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.17g}")


def quantizer(bits: int = 8):
    """UDF from array<float> to quantized bytes."""

    @pandas_udf(T.BinaryType())
    def quantized(v: pd.Series) -> pd.Series:
        return pd.Series(kernels.quantize(np.stack(v.to_numpy()).astype(np.float64), bits)) if len(v) else pd.Series([], dtype=object)

    return quantized


def dequantizer(bits: int, dim: int):
    """UDF from quantized bytes to array<float>."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def dequantized(c: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.dequantize(list(c), dim, bits).astype(np.float32))) if len(c) else pd.Series([], dtype=object)

    return dequantized


@pandas_udf(T.ArrayType(T.FloatType()))
def l2_normalized(v: pd.Series) -> pd.Series:
    return pd.Series(list(kernels.l2_normalize(np.stack(v.to_numpy()).astype(np.float64)).astype(np.float32))) if len(v) else pd.Series([], dtype=object)


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision by higher-order functions, for a few rows; batches use ``operators.vector``."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def inverse_distance(d: Column) -> Column:
    return 1 / (1 + d)
