"""Coordinate lists as text. Strict: blanks or one comma separate numbers; what is no number makes the row bad.

Lists are split first and numbers are tested one by one: one regular expression over a whole list would recurse for every
number and overflow the stack on long rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\x0c\r"
_BETWEEN = r"\s*,\s*|\s+"
_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"


def _tokens(text: str) -> Column:
    return F.split(F.btrim(F.col(text), F.lit(_BLANKS)), _BETWEEN)


def is_pos_list(text: str = "pos_list") -> Column:
    return F.coalesce(F.forall(_tokens(text), lambda t: t.rlike(_NUMBER)), F.lit(False))


def ordinates(text: str = "pos_list") -> Column:
    """The numbers of a list, null where it is no list."""
    o = F.transform(_tokens(text), lambda t: F.when(t.rlike(_NUMBER), t.try_cast("double")))
    return F.when(F.forall(o, lambda x: x.isNotNull()), o)


def tokenize_pos_lists(pos_lists: DataFrame, text: str = "pos_list", dim: int = 2) -> DataFrame:
    """One row per vertex: all columns but the text, v_ord, x, y, and z where `dim` is 3 or more. Consecutive equal vertices of a list
    are one. Odd ordinates at the end are left out. Bad rows give no vertex; `bad_pos_lists` has them. Filtering happens in arrays: no shuffle."""
    rest = [c for c in pos_lists.columns if c != text]
    axes = ("x", "y", "z")[: max(2, min(dim, 3))]
    o = pos_lists.withColumn("_o", ordinates(text)).where("_o IS NOT NULL")
    n = F.expr(f"size(_o) div {dim}")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("int").alias("v_ord"), *[F.get("_o", i * dim + k).alias(a) for k, a in enumerate(axes)]))
    p = o.where(n > 0).withColumn("_p", points)

    def moved(s: Column, i: Column) -> Column:
        before = F.get("_p", i - 1)
        out = i == 0
        for a in axes:
            out = out | (s[a] != before[a])
        return out

    return p.select(*rest, F.inline(F.filter("_p", moved)))


def bad_pos_lists(pos_lists: DataFrame, text: str = "pos_list") -> DataFrame:
    return pos_lists.where(~is_pos_list(text))
