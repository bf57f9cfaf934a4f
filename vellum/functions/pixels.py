"""Image samples to PNG and data URIs."""

from __future__ import annotations

import base64
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

JPEG = ("DCTDecode", "DCT")


def png(width: int, height: int, samples: bytes, channels: int) -> bytes:
    """A PNG of 8-bit samples: 1 gray, 2 gray and alpha, 3 RGB, 4 RGBA."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    row = width * channels
    samples = samples[: row * height].ljust(row * height, b"\0")
    lines = b"".join(b"\0" + samples[i * row : (i + 1) * row] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def to_rgb(samples: bytes, colorspace: str, palette: bytes | None, inverted: bool = False) -> bytes:
    """8-bit samples as RGB; CMYK ink is multiplied with black."""
    if palette is not None:
        return b"".join(palette[3 * i : 3 * i + 3].ljust(3, b"\0") for i in samples)
    if "CMYK" in colorspace:
        raw = bytes(255 - v for v in samples) if inverted else samples
        return bytes((255 - raw[i + k]) * (255 - raw[i + 3]) // 255 for i in range(0, len(raw) - 3, 4) for k in range(3))
    return samples


def image_bytes(width: int, height: int, bpc: int, colorspace: str, filter_name: str, stream: bytes, smask: bytes | None, palette: bytes | None, decode: list[float] | None = None) -> tuple[str, bytes]:
    """Extension and file bytes: JPEG data as it is, 8-bit samples as PNG with the mask as alpha, anything else raw."""
    if filter_name in JPEG:
        return "jpeg", stream
    if bpc != 8 or width <= 0 or height <= 0:
        return "raw", stream
    inverted = bool(decode) and decode[0] > decode[1]
    gray = palette is None and "CMYK" not in colorspace and len(stream) < 3 * width * height
    rgb = stream if gray else to_rgb(stream, colorspace, palette, inverted)
    channels = 1 if gray else 3
    if gray and inverted:
        rgb = bytes(255 - v for v in rgb)
    if smask and len(smask) >= width * height:
        rgb = b"".join(rgb[i * channels : (i + 1) * channels].ljust(channels, b"\0") + smask[i : i + 1] for i in range(width * height))
        channels += 1
    return "png", png(width, height, rgb, channels)


def data_uri(kind: str, data: bytes) -> str:
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


@F.pandas_udf(StructType([StructField("ext", StringType()), StructField("uri", StringType())]))
def image_uri(width: pd.Series, height: pd.Series, bpc: pd.Series, colorspace: pd.Series, filter_name: pd.Series, stream: pd.Series, smask: pd.Series, palette: pd.Series) -> pd.DataFrame:
    """Data URI of image columns as ``images`` gives them."""
    found = [image_bytes(*row) for row in zip(width, height, bpc, colorspace, filter_name, stream, smask, palette, strict=True)]
    return pd.DataFrame({"ext": [k for k, _ in found], "uri": [data_uri(k, d) for k, d in found]})


def pixel(samples: Column, stride: Column, channels: Column, x: Column, y: Column) -> Column:
    """Bytes of one pixel."""
    return F.substring(samples, y * stride + x * channels + 1, channels)
