"""Integer, bit and partition-id functions as column expressions over BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(n: Column) -> Column:
    """Bits of a positive number; 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n))).cast("long")


def prev_power_of_two(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.expr("1L")).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bit_length(n) - 1, F.lit(0)).cast("int"))


def lowest_set_bit(n: Column) -> Column:
    """Index of the lowest set bit; null for 0."""
    return F.when(n != 0, F.bit_count(n.bitwiseAND(-n) - 1).cast("long"))


def lowest_set_bit_or_zero(n: Column) -> Column:
    """Index of the lowest set bit; 0 for 0 too."""
    return F.coalesce(lowest_set_bit(n), F.lit(0).cast("long"))


def zigzag(v: Column) -> Column:
    """Unsigned 32-bit zigzag code of a signed 32-bit number."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)).bitwiseAND(F.lit(0xFFFFFFFF))


def set_bits(v: Column) -> Column:
    """Indices of the set bits of a 32-bit number, highest first."""
    return F.filter(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), lambda i: F.getbit(v, i) == 1)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a decimal; 0 where k > n."""
    wide = "decimal(38,0)"
    value = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1).cast(wide), lambda a, i: F.when(i > k, a).otherwise(F.floor(a * (n - i + 1) / i).cast(wide)))
    return F.when(k > n, F.lit(0).cast(wide)).otherwise(value)


def fibonacci_hash(n: Column) -> Column:
    """Bits 16 to 31 of a folded 32-bit value times the 32-bit golden ratio constant, kept to 32 bits."""
    n = n.bitwiseAND(F.lit(0xFFFFFFFF))
    folded = n.bitwiseXOR(F.shiftright(n, 16))
    return F.shiftright((folded * F.lit(0x9E3779B9)).bitwiseAND(F.lit(0xFFFFFFFF)), 16)


def subsets(mask: Column) -> Column:
    """All subsets of a bit mask of few bits (the array runs over all numbers up to the mask), ascending from 0. Wider masks
    are for the table function ``bit_subsets`` of roadloom.functions.sql."""
    return F.filter(F.sequence(F.lit(0).cast("long"), mask), lambda x: x.bitwiseAND(F.bitwise_not(mask)) == 0)


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text."""
    return F.encode(text, "utf-8")


# Partition ids: 1 is the root, the children of p are 2p and 2p + 1.


def _shift_left(v: Column, by: Column) -> Column:
    return F.call_function("shiftleft", v, by.cast("int"))


def _shift_right(v: Column, by: Column) -> Column:
    return F.call_function("shiftright", v, by.cast("int"))


def parent(p: Column) -> Column:
    return F.greatest(F.shiftright(p, 1), F.lit(1).cast("long"))


def parent_at_level(p: Column, level: Column) -> Column:
    """The id with its `level` low bits cleared."""
    return p.bitwiseAND(F.bitwise_not(_shift_left(F.lit(1).cast("long"), level) - 1))


def left_child(p: Column) -> Column:
    return F.shiftleft(p, 1)


def right_child(p: Column) -> Column:
    return F.shiftleft(p, 1) + 1


def leftmost_descendant(p: Column, k: Column) -> Column:
    return _shift_left(p, k)


def rightmost_descendant(p: Column, k: Column) -> Column:
    return _shift_left(p, k) + _shift_left(F.lit(1).cast("long"), k) - 1


def level(p: Column) -> Column:
    return bit_length(p) - 1


def is_left_child(p: Column) -> Column:
    return p % 2 == 0


def lowest_common_ancestor(a: Column, b: Column) -> Column:
    low = F.least(level(a), level(b))
    x, y = _shift_right(a, level(a) - low), _shift_right(b, level(b) - low)
    return _shift_right(x, bit_length(x.bitwiseXOR(y)))


def extract_bit(p: Column, index: Column) -> Column:
    return F.getbit(p, index) == 1


def hilbert_index(x: Column, y: Column, bits: int = 16) -> Column:
    """Position of a point (coordinates below 2**bits) along the Hilbert curve: two bits a step from the highest, and the
    square is turned so that the curve goes on where it left off."""
    one = F.lit(1).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = _shift_left(one, F.lit(bits - 1) - k)
        right, up = s["x"].bitwiseAND(side) > 0, s["y"].bitwiseAND(side) > 0
        quarter = F.when(right & ~up, 3).when(right & up, 2).when(up, 1).otherwise(0).cast("long")
        mirror = right & ~up
        a, b = (F.when(mirror, side - 1 - s[c].bitwiseAND(side - 1)).otherwise(s[c].bitwiseAND(side - 1)) for c in "xy")
        return F.struct(F.when(up, a).otherwise(b).alias("x"), F.when(up, b).otherwise(a).alias("y"), (s["d"] * 4 + quarter).alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda s: s["d"])
