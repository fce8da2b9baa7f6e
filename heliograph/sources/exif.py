"""EXIF fields and dimensions of image files from their bytes, without an image library: JPEG, TIFF and PNG."""

from __future__ import annotations

import base64
import json
import struct
from fractions import Fraction

# Numbers and names of the tags that are kept, by the standard.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
    0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "PhotographicSensitivity",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9201: "ShutterSpeedValue",
    0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA001: "ColorSpace",
    0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
# Bytes and struct letters of the value types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
_SUB = {0x8769: TAGS, 0x8825: GPS_TAGS}
#: Bytes of an undefined value above which only its size is kept.
LONGEST_BINARY = 1024


def _tiff(data: bytes) -> bytes | None:
    """The TIFF structure of a file, which holds its EXIF fields."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _directory(data: bytes, order: str, at: int, names: dict[int, str], out: dict[str, tuple[int, list]], seen: set[int]) -> int:
    """Read the fields of one directory into ``out``; the place of the next one, 0 if there is none."""
    if at in seen or at + 2 > len(data):
        return 0
    seen.add(at)
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            return 0
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        letter = TYPES.get(kind)
        if letter is None:
            continue
        size = struct.calcsize(order + letter) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if start + size > len(data):
            continue
        if letter == "s":
            values = [data[start : start + size]]
        else:
            values = list(struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", data, start))
            if len(letter) == 2:
                values = list(zip(values[::2], values[1::2], strict=True))
        if tag in _SUB and values:
            _directory(data, order, values[0], _SUB[tag], out, seen)
        elif tag in names and names[tag] not in out:
            out[names[tag]] = kind, values
    after = at + 2 + 12 * n
    return struct.unpack_from(order + "I", data, after)[0] if after + 4 <= len(data) else 0


def _json(kind: int, values: list):
    """A value as JSON has it: texts without their end, fractions as numbers, single values by themselves but for bytes."""
    if kind == 2:
        return values[0].split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind == 7:
        return {"type": "binary", "size": len(values[0])} if len(values[0]) > LONGEST_BINARY else base64.b64encode(values[0]).decode()
    plain = [(v[0] / v[1] if v[1] else None) if isinstance(v, tuple) else v for v in values]
    return plain[0] if len(plain) == 1 and kind not in (1, 6) else plain


def _dimensions(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def read(data: bytes) -> dict:
    """The catalogue's columns that a file's own bytes give; those that they do not give are null. Never raises."""
    wide, high = _dimensions(data)
    found: dict = {"width": wide, "height": high}
    tiff = _tiff(data)
    if not tiff or len(tiff) < 8:
        return found
    order = "<" if tiff[:2] == b"II" else ">"
    primary: dict[str, tuple[int, list]] = {}
    thumbnail: dict[str, tuple[int, list]] = {}
    seen: set[int] = set()
    after = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0], TAGS, primary, seen)
    if after:
        _directory(tiff, order, after, TAGS, thumbnail, seen)
    value = {name: _json(*held) for name, held in primary.items()}
    number = lambda name: value.get(name) if isinstance(value.get(name), int | float) else None

    def degrees(name: str) -> float | None:
        parts, side = value.get(name), value.get(f"{name}Ref")
        if not isinstance(parts, list) or len(parts) != 3 or None in parts:
            return None
        size = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -size if side in ("S", "W") else size

    exposure = next((v for k, vs in [primary.get("ExposureTime", (0, []))] if k == 5 for v in vs), None)
    sensitivity = primary.get("PhotographicSensitivity", (0, []))
    every = {f"{place}:{name}": _json(*held) for place, fields in (("primary", primary), ("thumbnail", thumbnail)) for name, held in fields.items()}
    return found | {
        "width": wide or number("PixelXDimension") or number("ImageWidth"),
        "height": high or number("PixelYDimension") or number("ImageLength"),
        "camera_make": value.get("Make") or None, "camera_model": value.get("Model") or None, "lens": value.get("LensModel") or None,
        "focal_length": number("FocalLength"), "aperture": number("FNumber"),
        "shutter_speed": str(Fraction(*exposure)) if exposure and exposure[1] else None,
        "iso": sensitivity[1][0] if sensitivity[0] == 3 and sensitivity[1] else None,
        "taken_at": value.get("DateTimeOriginal") or value.get("DateTime") or None,
        "gps_latitude": degrees("GPSLatitude"), "gps_longitude": degrees("GPSLongitude"),
        "exif_orientation": number("Orientation"), "all_exif": json.dumps(every) if every else None,
    }
