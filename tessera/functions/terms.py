"""Search terms and their hashed index positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, at least two characters long, in order."""
    # A capital sigma lower-cases by character, not by word position.
    plain = F.regexp_replace(F.replace(text, F.lit("Σ"), F.lit("σ")), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(plain), " "), lambda t: F.length(t) >= 2)


def hash_mod(hex32: Column, modulus: int) -> Column:
    """A 128-bit hex digest modulo a small number, folded word by word so it stays in a long; the modulus is at most
    two to the power of 20."""
    rest = None
    for start, digits in ((1, 12), (13, 10), (23, 10)):
        word = F.conv(F.substring(hex32, start, digits), 16, 10).cast("long")
        rest = (word if rest is None else rest * F.lit(1 << 4 * digits) + word) % F.lit(modulus)
    # Never null, so joins on it add no null test that would hash every term again.
    return F.coalesce(rest, F.lit(0).cast("long"))


def term_index(term: Column) -> Column:
    return F.coalesce(hash_mod(F.md5(term.cast("binary")), K.SPARSE_SPACE).cast("int"), F.lit(0))


def saturate(tf: Column) -> Column:
    return tf / (tf + F.lit(0.5))
