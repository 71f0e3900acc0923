"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import ALPHABET, HYDROGEN


def ravel(i: Column, j: Column, n: Column | int) -> Column:
    return i * n + j


def unravel(k: Column, n: int) -> tuple[Column, Column]:
    return F.floor(k / n).cast("long"), k % n


def combine_symbols(left: Column, right: Column, separator: str = "/") -> Column:
    """x for equal symbols, else x/y."""
    return F.when(left == right, left).otherwise(F.concat(left, F.lit(separator), right))


def decharged(mz: Column, charge: Column | int) -> Column:
    charge = charge if isinstance(charge, Column) else F.lit(charge)
    return charge * mz - F.lit(HYDROGEN) * (charge - 1)


def quantised(x: Column, tolerance: float) -> Column:
    """The integer key of fuzzy equality: x / tolerance, truncated towards zero."""
    return (x / F.lit(tolerance)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """Ties go to even, on the scaled value."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def micro(x: Column) -> Column:
    """Millionths as a whole number, to compare results across engines."""
    return F.rint(x * F.lit(1e6)).cast("long")


def in_alphabet(word: Column, alphabet: str = ALPHABET) -> Column:
    return word.rlike(f"^[{alphabet}]*$")


def loss_name(loss: Column) -> Column:
    """Formula names of library losses: a count of 1 is written out."""
    named = F.when(loss == "NH3", "H3N1").when(loss == "H2O", "H2O1").otherwise(loss)
    return F.when(named.rlike(r"\D$"), F.concat(named, F.lit("1"))).otherwise(named)


def ion_parts(name: Column) -> tuple[Column, Column, Column, Column]:
    """Series, position, loss and charge of an ion name such as y3-H2O1++: '', null, '' and 0 if it isn't one.

    The pluses at its end are the charge; what precedes a dash is the series letter and the position, what follows it the loss.
    """
    body = F.rtrim(name, F.lit("+"))
    charge = F.length(name) - F.length(body)
    ion, loss = F.substring_index(body, "-", 1), F.substring(body, F.length(F.substring_index(body, "-", 1)) + 2, F.length(body))
    series, position = F.substring(ion, 1, 1), F.substring(ion, F.lit(2), F.length(ion))
    dashed = F.length(ion) < F.length(body)
    valid = (charge > 0) & (F.instr(F.lit("abcxyz"), series) > 0) & (F.length(series) == 1) & position.rlike("^[0-9]+$") & (~dashed | (F.length(loss) > 0)) & (F.instr(loss, "+") == 0)
    return F.when(valid, series).otherwise(""), F.when(valid, position.cast("int")), F.when(valid, loss).otherwise(""), F.when(valid, charge).otherwise(0)


def residue_series(n: Column) -> tuple[Column, Column]:
    """Series b, y, b, y, ... and positions 1, 1, 2, 2, ... of a sequence of ``n`` residues."""
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    keep = lambda x, kind: F.when(n > 1, x).otherwise(F.array().cast(f"array<{kind}>"))
    return keep(F.flatten(F.transform(steps, lambda _: F.array(F.lit("b"), F.lit("y")))), "string"), keep(F.flatten(F.transform(steps, lambda i: F.array(i, i))), "int")


def shares(values: Column) -> Column:
    """A map's values over their sum."""
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform_values(values, lambda _, x: x / total)


def edges_of(nodes: Column) -> Column:
    """Consecutive pairs of an array, as strings."""
    return F.filter(F.zip_with(nodes, F.slice(nodes, 2, F.greatest(F.size(nodes), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(">", a, b))), lambda e: e.isNotNull())


def edge_disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(edges_of(a), edges_of(b))


def first_match(left: Column, right: Column) -> Column:
    """The first (i, j), by i and then j, at which the arrays are equal, or (-1, -1)."""
    hit = F.filter(F.transform(left, lambda x, i: F.struct(i.alias("i"), (F.array_position(right, x) - 1).cast("int").alias("j"))), lambda p: p["j"] >= 0)
    return F.coalesce(F.get(hit, F.lit(0)), F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
