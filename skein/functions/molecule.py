"""Molecule names: `<original>_<barcode>_<umi>` parsed from the right, and two-bit packing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OK, MISSING, MALFORMED, UNSUPPORTED = "ok", "missing", "malformed", "unsupported"


def check_lengths(barcode: int, umi: int) -> None:
    for what, n in (("raw CB", barcode), ("raw UMI", umi)):
        if not 1 <= n <= 32:
            raise ValueError(f"{what} length must be 1..32, not {n}")


def molecule(name: Column, barcode_length: int = 16, umi_length: int = 12) -> Column:
    """struct(status, original_name, barcode, umi). The first rule that applies decides: fewer than three parts, or an
    empty one of the last two: missing; an empty rest or a wrong length: malformed; another base than ACGTN in either
    case: unsupported."""
    check_lengths(barcode_length, umi_length)
    parts = F.split(F.coalesce(name, F.lit("")), "_", -1)
    n = F.size(parts)
    umi, barcode = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    original = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")
    status = (
        F.when((n < 3) | (umi == "") | (barcode == ""), MISSING)
        .when(original == "", MALFORMED)
        .when((F.octet_length(barcode) != barcode_length) | (F.octet_length(umi) != umi_length), MALFORMED)
        .when(~barcode.rlike("^[ACGTNacgtn]+$") | ~umi.rlike("^[ACGTNacgtn]+$"), UNSUPPORTED)
        .otherwise(OK)
    )
    return F.struct(status.alias("status"), original.alias("original_name"), barcode.alias("barcode"), umi.alias("umi"))


def pack(sequence: Column) -> Column:
    """Two bits a base, A and N 0, C 1, G 2, T 3, the last base lowest: the bit pattern of a 64-bit integer."""
    bases = F.filter(F.split(F.upper(sequence), ""), lambda b: b != "")
    code = lambda b: F.when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(0).cast("long")
    return F.aggregate(bases, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 2).bitwiseOR(code(b)))


def packed_width(length: int) -> int:
    """Bytes of the least unsigned integer that holds a packed sequence of this length."""
    return 1 if length <= 4 else 2 if length <= 8 else 4 if length <= 16 else 8


def target_word(target_id: Column, forward: Column) -> Column:
    """A target's id with the orientation in bit 31."""
    return target_id.cast("long") + F.when(forward, F.lit(2147483648)).otherwise(F.lit(0))


def umi_of(number: Column, length: int = 12) -> Column:
    """A counter written in base 4 with ACGT for 0123."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), length, "0"), "0123", "ACGT")
