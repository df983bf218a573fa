"""The relations that the operators work on, and the orders that rows can be put in."""

from __future__ import annotations

from pyspark.sql import types as T

TRACE = T.ArrayType(T.StructType([T.StructField("err", T.IntegerType()), T.StructField("blen", T.IntegerType())]))
OVERLAP = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("ovl_id", "aread", "bread")]
    + [T.StructField(c, T.BooleanType()) for c in ("is_inverse", "is_start", "is_next", "is_primary", "is_true", "is_haplo")]
    + [T.StructField(c, T.LongType()) for c in ("abpos", "aepos", "bbpos", "bepos", "diffs")]
    + [T.StructField("trace", TRACE)]
)
READS = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("rlen", T.LongType()), T.StructField("seq", T.StringType())])

#: The coordinates that two exact copies share.
CONTENT = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "diffs"]
#: Leading keys of each order; the rest of CONTENT and a tie-break follow, which makes every order total.
ORDERS = {
    "canonical": ["aread", "bread", "is_inverse", "abpos"],
    "ba": ["bread", "aread", "is_inverse", "abpos"],
    "aidbid": ["aread", "bread"],
    "bidaid": ["bread", "aread"],
    "full": CONTENT,
    "aidapos": ["aread", "abpos"],
}


def order_keys(order: str, tie: list[str] = ()) -> list[str]:
    """The columns of an order; an unknown name is an error."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; one of {', '.join(ORDERS)}")
    return list(dict.fromkeys([*ORDERS[order], *CONTENT, *tie]))
