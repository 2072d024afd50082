"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den with a zero denominator read as 1 and infinities as 0."""
    d = as_col(den).cast("double")
    q = as_col(num).cast("double") / F.when(d == 0, F.lit(1.0)).otherwise(d)
    return F.when(F.abs(q) == float("inf"), F.lit(0.0)).otherwise(q)


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def _sum_of(a, b, term) -> Column:
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: term(x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum_of(a, b, lambda d: d * d))


def l1(a: Column | str, b: Column | str) -> Column:
    return _sum_of(a, b, F.abs)


def pad_to(a: Column | str, size: Column) -> Column:
    a = as_col(a).cast("array<double>")
    return F.concat(a, F.array_repeat(F.lit(0.0), size - F.size(a)))


def combine_embeddings(
    a: Column | str, b: Column | str, strategy: str = "weighted_sum", wa: float = 0.5, wb: float = 0.5
) -> Column:
    """Weighted sum or average (shorter vector zero-padded), or concatenation."""
    a, b = as_col(a), as_col(b)
    if strategy == "concatenate":
        return F.concat(a.cast("array<double>"), b.cast("array<double>"))
    if strategy == "weighted_sum":
        if abs(wa + wb - 1.0) > 1e-6:
            raise ValueError("weights must add up to 1")
    elif strategy == "average":
        wa = wb = 0.5
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    size = F.greatest(F.size(a), F.size(b))
    return F.zip_with(pad_to(a, size), pad_to(b, size), lambda x, y: x * wa + y * wb)


def dataset_parts(uri: Column | str) -> Column:
    """Split a dataset URI into struct(namespace, name).

    The namespace is the scheme (``file`` without one); the name is host plus path
    without outer slashes, query and fragment, or ``unknown`` when empty.
    """
    u = as_col(uri)
    local = u.startswith("/")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?s)[?#].*$", ""), "^/+|/+$", "")
    return F.struct(
        F.when(local | (scheme == ""), F.lit("file")).otherwise(scheme).alias("namespace"),
        F.when(local, F.regexp_replace(u, "^/+", ""))
        .when(rest == "", F.lit("unknown"))
        .otherwise(rest)
        .alias("name"),
    )


def is_json(c: Column | str) -> Column:
    """True for well-formed JSON, null for null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


# The text shapes counted as integer, float and timestamp.
INTEGER_SHAPE = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT_SHAPE = (
    r"^[+-]?((([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"
)
TIMESTAMP_SHAPES = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}")
