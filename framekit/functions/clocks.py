"""Frame-count clocks as column expressions; every one is a closed form, none needs ordered state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framekit.dims import by_standard

SUBCODE_SAMPLES = 588
SUBCODE_RATE = 75


def idiv(a: Column, b: Column | int) -> Column:
    """Integer quotient (BIGINT) of non-negative operands."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def imod(a: Column, b: Column | int) -> Column:
    return F.pmod(a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def hmsf(frame: Column, standard: Column | str = "standard") -> Column:
    """HH:MM:SS:FF at the code clock rate of the standard; hours do not wrap."""
    fps = by_standard("code_fps", standard)
    seconds = idiv(frame, fps)
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        idiv(seconds, 3600), imod(idiv(seconds, 60), 60), imod(seconds, 60), imod(frame, fps),
    )


def programme_hour(frame: Column, standard: Column | str = "standard") -> Column:
    return F.least(idiv(idiv(frame, by_standard("frames_per_minute", standard)), 60), F.lit(15).cast("bigint"))


def programme_minute(frame: Column, standard: Column | str = "standard") -> Column:
    return imod(idiv(frame, by_standard("frames_per_minute", standard)), 60)


def msf(sections: Column) -> Column:
    """75 Hz M:S:F time; minutes stop at 99."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.least(idiv(sections, 4500), F.lit(99).cast("bigint")),
        idiv(imod(sections, 4500), 75),
        imod(sections, 75),
    )


def msf_order(sections: Column) -> Column:
    """The sections that ``msf`` shows, which order as its texts; a maximum of numbers needs no sort. Shown texts are ``msf`` of them."""
    return F.least(idiv(sections, 4500), F.lit(99).cast("bigint")) * 4500 + imod(sections, 4500)


def sections_of_msf(text: Column) -> Column:
    part = F.split(text, ":")
    return (part[0].cast("bigint") * 4500 + part[1].cast("bigint") * 75 + part[2].cast("bigint")).cast("bigint")


def _clv_correction(frame: Column) -> tuple[Column, Column]:
    """NTSC colour-time correction: steps taken so far, and frames since the last step."""
    cycle, rest = idiv(frame, 8991), imod(frame, 8991)
    step = F.least(idiv(rest, 899), F.lit(9).cast("bigint"))
    return cycle * 10 + step, rest - step * 899


def clv_second(frame: Column, standard: Column | str = "standard") -> Column:
    std = F.col(standard) if isinstance(standard, str) else standard
    steps, since = _clv_correction(frame)
    return F.when(std == "NTSC", imod(steps * 30 + idiv(since, 30), 60)).otherwise(imod(idiv(frame, 25), 60))


def clv_frame(frame: Column, standard: Column | str = "standard") -> Column:
    std = F.col(standard) if isinstance(standard, str) else standard
    _, since = _clv_correction(frame)
    return F.when(std == "NTSC", imod(since, 30)).otherwise(imod(frame, 25))


def audio_offset_48k(frame: Column, standard: Column | str = "standard") -> Column:
    """First 48 kHz sample of a frame: 1920 per PAL frame, 8008 per five System M frames."""
    std = F.col(standard) if isinstance(standard, str) else standard
    rest = imod(frame, 5)
    # Samples before each frame of the five-frame cycle.
    part = F.element_at(F.array(*[F.lit(v) for v in (0, 1602, 3203, 4805, 6406)]), (rest + 1).cast("int"))
    return F.when(std == "PAL", frame.cast("bigint") * 1920).otherwise(idiv(frame, 5) * 8008 + part)


def audio_offset_44k(frame: Column, standard: Column | str = "standard") -> Column:
    """First 44.1 kHz sample of a frame; null where the standard defines no such audio."""
    std = F.col(standard) if isinstance(standard, str) else standard
    rest = imod(frame, 100)
    short = sum((F.when(rest >= n, 1).otherwise(0) for n in (23, 47, 71)), F.lit(0))
    ntsc = idiv(frame, 100) * 147147 + rest * 1471 + idiv(rest + 1, 2) - short
    return F.when(std == "PAL", frame.cast("bigint") * 1764).when(std == "NTSC", ntsc)


def audio_samples_48k(frame: Column, standard: Column | str = "standard") -> Column:
    return audio_offset_48k(frame + 1, standard) - audio_offset_48k(frame, standard)


def audio_samples_44k(frame: Column, standard: Column | str = "standard") -> Column:
    return audio_offset_44k(frame + 1, standard) - audio_offset_44k(frame, standard)
