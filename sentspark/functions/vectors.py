"""Vector arithmetic as columns over array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM = 1e-12
MIN_COUNT = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            _col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(v: Column | str) -> Column:
    """Divide by the length; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(MIN_NORM))
    # as the argument of a function the length is found once, and not for every component
    divided = F.transform(F.array(length), lambda n: F.transform(_col(v), lambda x: x.cast("double") / n))
    return F.get(divided, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of the two normalised vectors; 0 if either is zero."""
    floor = F.lit(MIN_NORM)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def one_hot(index: Column | str, size: int) -> Column:
    """``size`` floats, 1 at ``index``; an index out of range is an error."""
    i = _col(index)
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (j == i).cast("float")
    )
    return F.when((i >= 0) & (i < size), hot).otherwise(
        F.raise_error(F.concat(F.lit(f"index outside 0..{size - 1}: "), i.cast("string")))
    )


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """Negative log-softmax of the logit at ``label``."""
    x = _col(logits)
    top = F.array_max(x).cast("double")
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top))
    picked = F.element_at(x, _col(label).cast("int") + 1).cast("double")
    return top + F.log(total) - picked
