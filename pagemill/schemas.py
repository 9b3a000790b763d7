"""Table layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# One row per tree node.  `id` is the preorder position inside the page and
# `end` is one past the last descendant, so `d` lies inside `a` exactly when
# a.id <= d.id < a.end.  Row 0 of every page is the document itself.
#   kind: doc | elem | text | data (script, style, template, ruby) | comment | decl
NODES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("feed", T.BooleanType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, with the missing names, when an input table has the wrong shape."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df
