"""24-bit code words, 40-bit FM words and their check bits, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framekit.dims import WORD_CLV, WORD_LEAD_IN, WORD_LEAD_OUT, WORD_PICTURE_STOP
from framekit.functions.clocks import idiv, imod

FIXED_WORDS = {
    "lead_in": WORD_LEAD_IN,
    "lead_out": WORD_LEAD_OUT,
    "picture_stop": WORD_PICTURE_STOP,
    "clv_code": WORD_CLV,
}


def bcd(value: Column, digits: int) -> Column:
    """Decimal digits as nibbles: each carry into a higher digit adds 6 at the digit below."""
    total = value
    for i in range(1, digits):
        total = total + idiv(value, 10**i) * (6 * 16 ** (i - 1))
    return total


def nibble(word: Column, low_bit: int, width: int = 4) -> Column:
    return F.shiftright(word, low_bit).bitwiseAND((1 << width) - 1)


def picture_word(number: Column) -> Column:
    return F.lit(0xF00000) + bcd(number, 5)


def chapter_word(chapter: Column, stop: Column) -> Column:
    high = stop * 8 + imod(idiv(chapter, 16), 8)
    return F.lit(0x800DDD) + high * 0x10000 + imod(chapter, 16) * 0x1000


def programme_time_word(hour: Column, minute: Column) -> Column:
    return F.lit(0xF0DD00) + hour * 0x10000 + bcd(minute, 2)


def clv_picture_word(second: Column, frame: Column) -> Column:
    return F.lit(0x80E000) + (idiv(second, 10) + 10) * 0x10000 + imod(second, 10) * 0x100 + bcd(frame, 2)


def masked(word: Column, mask: int, value: int) -> Column:
    return word.bitwiseAND(mask) == value


def _decimal(word: Column, low_bits: Sequence[int]) -> Column:
    out = F.lit(True)
    for bit in low_bits:
        out = out & (nibble(word, bit) <= 9)
    return out


def _bcd_value(word: Column, low_bits: Sequence[int]) -> Column:
    """Digits at the given bit positions, most significant first."""
    value = F.lit(0)
    for bit in low_bits:
        value = value * 10 + nibble(word, bit)
    return value


def code_type(word: Column) -> Column:
    """Kind of a captured word; the most specific pattern wins."""
    out = F.when(word == WORD_LEAD_IN, "lead_in")
    for name in ("lead_out", "picture_stop", "clv_code"):
        out = out.when(word == FIXED_WORDS[name], name)
    return (
        out.when(masked(word, 0xF00FFF, 0x800DDD), "chapter_number")
        .when(masked(word, 0xFFF000, 0x8DC000) | masked(word, 0xFFF000, 0x8BA000), "programme_status")
        .when(
            masked(word, 0xF0F000, 0x80E000) & (nibble(word, 16) >= 10) & _decimal(word, [8, 4, 0]),
            "clv_picture_number",
        )
        .when(masked(word, 0xF8F000, 0x80D000), "users_code")
        .when(masked(word, 0xF0FF00, 0xF0DD00) & _decimal(word, [4, 0]), "programme_time_code")
        .when(masked(word, 0xF00000, 0xF00000) & _decimal(word, [12, 8, 4, 0]), "picture_number")
        .otherwise("unknown")
    )


def decoded_fields(word: Column, kind: Column) -> dict[str, Column]:
    is_chapter, is_time, is_clv = kind == "chapter_number", kind == "programme_time_code", kind == "clv_picture_number"
    return {
        "picture_number": F.when(kind == "picture_number", _bcd_value(word, [16, 12, 8, 4, 0])),
        "chapter": F.when(is_chapter, nibble(word, 16, 3) * 16 + nibble(word, 12)),
        "stop_bit": F.when(is_chapter, nibble(word, 19, 1)),
        "hour": F.when(is_time, nibble(word, 16)),
        "minute": F.when(is_time, _bcd_value(word, [4, 0])),
        "clv_second": F.when(is_clv, (nibble(word, 16) - 10) * 10 + nibble(word, 8)),
        "clv_frame": F.when(is_clv, _bcd_value(word, [4, 0])),
        "status_x4": F.when(kind == "programme_status", nibble(word, 4)),
    }


def key_ok(word: Column) -> Column:
    """Bit 23 of a valid word is set."""
    return nibble(word, 23, 1) == 1


def hamming_check(x4: Column) -> Column:
    """Check nibble of the (8,4) code over the data nibble d1 d2 d3 d4 (d1 is the high bit)."""
    # Data bits under each parity bit, high parity bit first.
    masks = (0b1101, 0b1011, 0b0111, 0b1110)
    out = F.lit(0)
    for i, mask in enumerate(masks):
        out = out + F.bit_count(x4.bitwiseAND(mask)).bitwiseAND(1) * (1 << (3 - i))
    return out


def hamming_ok(word: Column) -> Column:
    return hamming_check(nibble(word, 4)) == nibble(word, 0)


def fm_bits(digits: Column) -> Column:
    """40-bit FM word of field one as BIGINT, first sent bit highest; ``digits`` holds X1..X5 as nibbles, X1 highest."""
    # each digit's bits are sent last first
    turned = F.array(*(F.lit(int(f"{n:04b}"[::-1], 2)) for n in range(16)))
    data = F.lit(0).cast("bigint")
    for i in range(5):
        data = data.bitwiseOR(F.shiftleft(F.get(turned, nibble(digits, 4 * i).cast("int")).cast("bigint"), 16 - 4 * i))
    parity = F.lit(1) - F.bit_count(digits).bitwiseAND(1)
    # Clock bits 0011, field one, recognition bits 1110010 before and 0001101 after the data.
    head = (0b00111 << 7 | 0b1110010) << 28
    return F.lit(head) + F.shiftleft(data, 8) + parity * 128 + 0b0001101


def fm_word(field_one: Column, digits: Sequence[Column]) -> Column:
    """40-bit FM word as BIGINT, first sent bit highest; ``digits`` are X1..X5."""
    # each digit's bits are sent last first; a table names the digit once, so that the expression stays small
    turned = F.array(*(F.lit(int(f"{n:04b}"[::-1], 2)) for n in range(16)))
    data = F.lit(0).cast("bigint")
    for x in reversed(list(digits)):
        data = data * 16 + F.get(turned, x.cast("int"))
    parity = F.lit(1) - F.bit_count(data).bitwiseAND(1)
    # Clock bits 0011, recognition bits 1110010 before and 0001101 after the data.
    head = (F.lit(0b0011) * 2 + field_one.cast("int")) * 128 + 0b1110010
    return ((head.cast("bigint") * (1 << 20) + data) * 2 + parity) * 128 + 0b0001101


def fm_parity_ok(word: Column) -> Column:
    """The 20 data bits and the parity bit hold an odd number of ones."""
    return F.bit_count(F.shiftright(word, 7).bitwiseAND((1 << 21) - 1)).bitwiseAND(1) == 1


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        rem = byte << 8
        for _ in range(8):
            rem = ((rem << 1) ^ 0x1021) & 0xFFFF if rem & 0x8000 else (rem << 1) & 0xFFFF
        table.append(rem)
    return table


def q_crc(payload: Column) -> Column:
    """CRC-16 (polynomial 0x1021, start 0, inverted) over an array of byte values."""
    table = F.array(*[F.lit(v) for v in _crc_table()])
    rem = F.aggregate(
        payload, F.lit(0),
        lambda acc, byte: F.shiftleft(acc.bitwiseAND(0xFF), 8).bitwiseXOR(
            F.element_at(table, F.shiftright(acc, 8).bitwiseXOR(byte) + 1)
        ),
    )
    return rem.bitwiseXOR(F.lit(0xFFFF))
