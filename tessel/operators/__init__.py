"""The array operators."""

from tessel.operators.array import (
    Array,
    arange,
    eye,
    from_numpy,
    from_relation,
    full,
    make_index_lambda,
    ones,
    ones_like,
    zeros,
    zeros_like,
)
from tessel.operators.calls import call_kernel, map_kernel, row_batches, trace_call
from tessel.operators.elementwise import (
    abs,
    arccos,
    arcsin,
    arctan,
    arctan2,
    conj,
    cos,
    cosh,
    equal,
    exp,
    greater,
    greater_equal,
    imag,
    isnan,
    less,
    less_equal,
    log,
    log10,
    logical_and,
    logical_not,
    logical_or,
    maximum,
    minimum,
    not_equal,
    real,
    sin,
    sinh,
    sqrt,
    tan,
    tanh,
    where,
)
from tessel.operators.exchange import Receive, RouteError, Send, exchange, number_tags, ring, verified_routes
from tessel.operators.indexing import NON_NEGATIVE, checked_gather
from tessel.operators.linalg import distribute_einsum, dot, einsum, gram, matmul, vdot
from tessel.operators.reductions import all, amax, amin, any, prod, sum
from tessel.operators.reshaping import (
    broadcast_to,
    concatenate,
    expand_dims,
    pad,
    ravel,
    reshape,
    roll,
    squeeze,
    stack,
    transpose,
)
from tessel.operators.shapes import CannotBroadcastError
from tessel.operators.sparse import CSRMatrix, from_coordinates, make_csr_matrix, sparse_matmul, to_csr

__all__ = [n for n in dir() if not n.startswith("_")]
