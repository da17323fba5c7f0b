"""Width and height of images from the heads of their files, as column expressions over bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of the formats, file name endings by type, and JPEG markers (frames; markers without a length).
PNG, GIFS, JPEG = "89504E470D0A1A0A", ("474946383761", "474946383961"), "FFD8FF"
ENDINGS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp"}
FRAMES = (0xC0, 0xC1, 0xC2)
ALONE = (0x01, *range(0xD0, 0xD8))
SCAN, END, FILL = 0xDA, 0xD9, 0xFF
SIZE = "struct<width: int, height: int>"
#: Steps over a JPEG's segments that are taken together; a run of them is left out once the size is known.
RUN = 64


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once: the one element of an array is its own variable."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _number(data: Column, at: Column | int, size: int = 1, small_first: bool = False) -> Column:
    """A number of `size` bytes from byte `at`, counted from 1; null beyond the end."""
    digits = F.hex(F.substring(data, at if isinstance(at, Column) else F.lit(at), F.lit(size)))
    if small_first:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("bigint"))


def _jpeg(data: Column) -> Column:
    """Segments are followed by their lengths up to the first frame; the scan, the end or a broken one stop without a size."""
    state = "struct<at: bigint, open: boolean, width: int, height: int>"

    def step(s: Column, _: Column) -> Column:
        at = s["at"].cast("int")
        mark, size = _number(data, at + 1), _number(data, at + 2, 2)
        go = lambda by: F.struct((s["at"] + by).alias("at"), F.lit(True).alias("open"), F.lit(0).alias("width"), F.lit(0).alias("height")).cast(state)
        stop = lambda w, h: F.struct(s["at"].alias("at"), F.lit(False).alias("open"), F.coalesce(w, F.lit(0)).cast("int").alias("width"), F.coalesce(h, F.lit(0)).cast("int").alias("height")).cast(state)
        none = stop(F.lit(0), F.lit(0))
        return (F.when(~s["open"], s).when(F.coalesce(_number(data, at), F.lit(0)) != 0xFF, none).when(mark == FILL, go(1)).when(mark.isin(*ALONE), go(2))
                .when(mark.isin(*FRAMES), stop(_number(data, at + 7, 2), _number(data, at + 5, 2))).when(mark.isin(SCAN, END) | size.isNull() | (size < 2), none).otherwise(go(2 + size)))

    first = F.struct(F.lit(3).cast("bigint").alias("at"), F.lit(True).alias("open"), F.lit(0).alias("width"), F.lit(0).alias("height")).cast(state)
    # a step takes a byte at least
    left = F.greatest(F.octet_length(data), F.lit(1))
    run = lambda s, _: F.when(s["open"], F.aggregate(F.sequence(F.lit(1), F.least(left, F.lit(RUN))), s, step)).otherwise(s)
    found = F.aggregate(F.sequence(F.lit(1), F.ceil(left / RUN)), first, run)
    size = lambda s: F.struct(F.when(s["open"], 0).otherwise(s["width"]).alias("width"), F.when(s["open"], 0).otherwise(s["height"]).alias("height")).cast(SIZE)
    return _once(found, size)


def dimensions(data: Column) -> Column:
    """struct (width, height) of a PNG, GIF or JPEG; zeros for anything else, and for a head that is cut off."""
    size = lambda w, h: F.struct(F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height")).cast(SIZE)
    head = F.coalesce(F.hex(F.substring(data, F.lit(1), F.lit(16))), F.lit(""))
    return _once(head, lambda head: F.when(head.startswith(PNG) & (F.substring(head, 25, 8) == "49484452"), size(_number(data, 17, 4), _number(data, 21, 4)))
                 .when(F.substring(head, 1, 12).isin(*GIFS), size(_number(data, 7, 2, True), _number(data, 9, 2, True)))
                 .when(head.startswith(JPEG), _jpeg(data)).otherwise(size(F.lit(0), F.lit(0))))


def ending(mime: Column) -> Column:
    found = F.lit(".bin")
    for kind, name in ENDINGS.items():
        found = F.when(mime == kind, name).otherwise(found)
    return found
