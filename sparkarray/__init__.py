"""Array analytics on Spark: arrays are DataFrames with a dense index.

>>> import sparkarray as sa
>>> v = sa.vector(spark.read.parquet("events.parquet"), "event_id", v="value")
>>> sa.scan(v, F.col("v"), "+")
"""

from .functions import philox, unitfloat8
from .functions.philox import Bernoulli, Categorical, Distribution, Exponential, Normal, Uniform, rand, randn
from .operators.order import ORDER_KEYS, keys_of, sort, sort_arrays, sort_columns, sort_keyval, sort_lt, sortperm
from .operators.product import matvec, matvec_into, matvec_rows, vecmat, vecmat_into
from .operators.reduce import extremum, fold, mapreduce, mapreduce2d, mapreduce_arrays, mapreduce_dims, mapreduce_into, mapreduce_struct, maximum, multi_reduce
from .operators.scan import scan, scan_into, scan_many
from .operators.search import argbest, argmax, argmin, coordinates, find
from .sources.store import release
from .sources.tables import fill, iota, matrix, reversed_view, tensor, vector, view, write_into

__all__ = [
    "ORDER_KEYS", "Bernoulli", "Categorical", "Distribution", "Exponential", "Normal", "Uniform", "argbest", "argmax", "argmin", "coordinates", "extremum", "fill",
    "find", "fold", "iota", "keys_of", "mapreduce", "mapreduce2d", "mapreduce_arrays", "mapreduce_dims", "mapreduce_into", "mapreduce_struct", "matrix", "matvec",
    "matvec_into", "matvec_rows", "maximum", "multi_reduce", "philox", "rand", "randn", "release", "reversed_view", "scan", "scan_into", "scan_many", "sort",
    "sort_arrays", "sort_columns", "sort_keyval", "sort_lt", "sortperm", "tensor", "unitfloat8", "vecmat", "vecmat_into", "vector", "view", "write_into",
]
