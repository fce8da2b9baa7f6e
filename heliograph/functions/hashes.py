"""Column expressions that read hashes however they are spelt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_B64 = r"^[A-Za-z0-9+/_-]{43}=?$"
_HEX = r"^[0-9A-Fa-f]{64}$"
#: What may follow the name of an algorithm: 32 bytes in hexadecimal, with separators or without, or in base64.
_DIGEST = r"([0-9a-f]{2}[:-]?){32}$|[a-z0-9+/_-]{43}=?$"


def _bytes32(text: Column) -> Column:
    padded = F.concat(F.translate(F.regexp_replace(text, "=$", ""), "-_", "+/"), F.lit("="))
    return F.when(text.rlike(_HEX), F.try_to_binary(F.when(text.rlike(_HEX), text), F.lit("hex"))).when(
        text.rlike(_B64), F.try_to_binary(F.when(text.rlike(_B64), padded), F.lit("base64"))
    )


def perceptual_bits(text: Column) -> Column:
    """The 32 bytes of a perceptual hash (hex, or base64 of either alphabet with or without padding and blanks).

    Null for anything that is not exactly 256 bits, and for the hash of all zero bits.
    """
    # a base64 value may begin with 0x too, so the prefix counts only before 64 hexadecimal digits
    found = _bytes32(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "^0[xX](?=[0-9A-Fa-f]{64}$)", ""))
    return F.when(F.hex(found) != "0" * 64, found)


def sha256_bytes(text: Column) -> Column:
    """The 32 bytes of a SHA-256 digest; blanks, case, separators and a leading algorithm name do not matter."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), rf"(?i)^(sha-?256[:=-](?={_DIGEST})|0x(?=([0-9a-f]{{2}}[:-]?){{32}}$))", "")
    return _bytes32(F.when(bare.rlike(r"^([0-9A-Fa-f]{2}[:-]){31}[0-9A-Fa-f]{2}$"), F.regexp_replace(bare, "[:-]", "")).otherwise(bare))


def words64(bits: Column) -> Column:
    """Four 64-bit words of a 32-byte value, as ``array<bigint>``."""
    return F.array(*(F.conv(F.hex(F.substring(bits, 8 * k + 1, 8)), 16, -10).cast("bigint") for k in range(4)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two ``array<bigint>`` of four words."""
    total = F.lit(0)
    for k in range(4):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total
