"""Scalar functions: activations, losses, identifiers, condition strings, CPU lists, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import let


def relu(v: Column) -> Column:
    """Zero for everything that is not above zero, NaN included (Spark holds NaN above all numbers)."""
    return F.when((v > 0) & ~F.isnan(v), v).otherwise(F.lit(0.0))


def relu_backward(x: Column, d: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), d).otherwise(F.lit(0.0))


def softmax(z: Column) -> Column:
    """Stable softmax of an array; maximum and total are taken once."""
    e = let(z, lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m))))
    return let(e, lambda y: let(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(y, lambda v: v / t)))


def argmax_first(z: Column) -> Column:
    """0-based place of the first maximum; NaN is never chosen."""
    clean = F.transform(z, lambda v: F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(v))
    return F.array_position(clean, F.array_max(clean)).cast("int") - 1


def cross_entropy(p: Column) -> Column:
    return -F.log(p + F.lit(1e-9))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def condition(raw: Column) -> dict[str, Column]:
    """Family (eq, dir or null), alpha and IID flag of a data-condition name."""
    rest = F.regexp_replace(raw, "^peq_", "")
    known = rest.rlike("^iid(_|$)") | rest.rlike("^alpha_")
    alpha = F.replace(F.regexp_extract(rest, r"^alpha_([0-9]+p?[0-9]*)(_|$)", 1), F.lit("p"), F.lit("."))
    return {
        "family": F.when(~known, F.lit(None)).when(raw.startswith("peq_"), F.lit("eq")).otherwise(F.lit("dir")),
        "alpha": F.when(alpha != "", alpha).try_cast("double"),
        "iid": rest.rlike("^iid(_|$)"),
    }


def numeric_node_id(name: Column) -> Column:
    """N of ``pi-N``; anything else raises."""
    n = F.regexp_extract(name, "^pi-([0-9]+)$", 1)
    return F.when(n != "", n.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("no node number in "), name)).cast("long"))


def cpu_list_count(text: Column) -> Column:
    """Number of CPUs in a list such as 0-1,3; -1 if it is empty or malformed."""
    ok = text.rlike(r"^\d+(-\d+)?(,\d+(-\d+)?)*$")
    first = lambda s: F.split_part(s, F.lit("-"), F.lit(1)).cast("int")
    last = lambda s: F.when(s.contains("-"), F.split_part(s, F.lit("-"), F.lit(2)).cast("int")).otherwise(first(s))
    sizes = F.transform(F.split(text, ","), lambda s: last(s) - first(s) + 1)
    return F.when(ok, F.when(F.array_min(sizes) >= 1, F.aggregate(sizes, F.lit(0), lambda a, x: a + x)).otherwise(-1)).otherwise(-1)


def pretty_name(lines: Column) -> Column:
    """The quoted value of the first PRETTY_NAME line of an os-release text."""
    return F.regexp_extract(lines, r'(?m)^PRETTY_NAME="?([^"\n]*)"?', 1)


def two_digits(n: Column) -> Column:
    return F.format_string("%02d", n)


def backoff(attempts: int) -> Column:
    """Seconds before each retry: 0.5 doubled each time, five at most."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.lit(0.5) * F.pow(F.lit(2.0), i), F.lit(5.0)))


def instrumented(v: Column) -> Column:
    """Null for the -1 that stands for a value never measured."""
    return F.nullif(v, F.lit(-1))


def evaluates(round_no: Column, every: int, last: int) -> Column:
    return F.lit(every <= 1) | (round_no % max(every, 1) == 0) | (round_no == last)
