"""EXIF entries of JPEG, TIFF and WebP bytes, by the public TIFF and EXIF layout."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_IMAGE = {
    11: "ProcessingSoftware", 254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample",
    259: "Compression", 262: "PhotometricInterpretation", 263: "Threshholding", 264: "CellWidth", 265: "CellLength", 266: "FillOrder",
    269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation",
    277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution",
    284: "PlanarConfiguration", 290: "GrayResponseUnit", 291: "GrayResponseCurve", 292: "T4Options", 293: "T6Options",
    296: "ResolutionUnit", 301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer",
    317: "Predictor", 318: "WhitePoint", 319: "PrimaryChromaticities", 320: "ColorMap", 321: "HalftoneHints", 322: "TileWidth",
    323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 330: "SubIFDs", 332: "InkSet", 333: "InkNames", 334: "NumberOfInks",
    336: "DotRange", 337: "TargetPrinter", 338: "ExtraSamples", 339: "SampleFormat", 347: "JPEGTables", 512: "JPEGProc",
    513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 529: "YCbCrCoefficients", 530: "YCbCrSubSampling",
    531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 700: "XMLPacket", 18246: "Rating", 18249: "RatingPercent",
    33432: "Copyright", 34377: "ImageResources", 34665: "ExifTag", 34675: "InterColorProfile", 34853: "GPSTag",
    40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject", 50341: "PrintImageMatching",
    50706: "DNGVersion", 50707: "DNGBackwardVersion", 50708: "UniqueCameraModel", 50735: "CameraSerialNumber",
}
#: Entry names by directory (fixed values from the TIFF and EXIF standards).
TAGS = {
    "0th": _IMAGE,
    "1st": _IMAGE,
    "Exif": {
        33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram", 34852: "SpectralSensitivity", 34855: "ISOSpeedRatings",
        34856: "OECF", 34864: "SensitivityType", 34865: "StandardOutputSensitivity", 34866: "RecommendedExposureIndex",
        34867: "ISOSpeed", 34868: "ISOSpeedLatitudeyyy", 34869: "ISOSpeedLatitudezzz", 36864: "ExifVersion",
        36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime", 36881: "OffsetTimeOriginal",
        36882: "OffsetTimeDigitized", 37121: "ComponentsConfiguration", 37122: "CompressedBitsPerPixel", 37377: "ShutterSpeedValue",
        37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue",
        37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength",
        37396: "SubjectArea", 37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal",
        37522: "SubSecTimeDigitized", 37888: "Temperature", 37889: "Humidity", 37890: "Pressure", 37891: "WaterDepth",
        37892: "Acceleration", 37893: "CameraElevationAngle", 40960: "FlashpixVersion", 40961: "ColorSpace",
        40962: "PixelXDimension", 40963: "PixelYDimension", 40964: "RelatedSoundFile", 40965: "InteroperabilityTag",
        41483: "FlashEnergy", 41484: "SpatialFrequencyResponse", 41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution",
        41488: "FocalPlaneResolutionUnit", 41492: "SubjectLocation", 41493: "ExposureIndex", 41495: "SensingMethod",
        41728: "FileSource", 41729: "SceneType", 41730: "CFAPattern", 41985: "CustomRendered", 41986: "ExposureMode",
        41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType",
        41991: "GainControl", 41992: "Contrast", 41993: "Saturation", 41994: "Sharpness", 41995: "DeviceSettingDescription",
        41996: "SubjectDistanceRange", 42016: "ImageUniqueID", 42032: "CameraOwnerName", 42033: "BodySerialNumber",
        42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber", 42080: "CompositeImage",
        42081: "SourceImageNumberOfCompositeImage", 42082: "SourceExposureTimesOfCompositeImage", 42240: "Gamma",
    },
    "GPS": {
        0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef",
        6: "GPSAltitude", 7: "GPSTimeStamp", 8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP",
        12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack", 16: "GPSImgDirectionRef", 17: "GPSImgDirection",
        18: "GPSMapDatum", 19: "GPSDestLatitudeRef", 20: "GPSDestLatitude", 21: "GPSDestLongitudeRef", 22: "GPSDestLongitude",
        23: "GPSDestBearingRef", 24: "GPSDestBearing", 25: "GPSDestDistanceRef", 26: "GPSDestDistance", 27: "GPSProcessingMethod",
        28: "GPSAreaInformation", 29: "GPSDateStamp", 30: "GPSDifferential", 31: "GPSHPositioningError",
    },
    "Interop": {1: "InteroperabilityIndex", 2: "InteroperabilityVersion", 4096: "RelatedImageFileFormat", 4097: "RelatedImageWidth", 4098: "RelatedImageLength"},
}
#: Words of a label that are not those of the name (fixed values, as the labels of the reference have them).
_WORDS = {
    "Sub Sec": "Sub seconds", "Lens Model": "Lense model", "Map Datum": "geodetic datum", "Img Direction": "image direction",
    "Dest ": "destination ", "Rating Percent": "RatingPercent", "JPEG Interchange Format Length": "JPEGInterchangeFormatLength",
    "JPEG Interchange Format": "JPEGInterchangeFormat", "Date Time": "DateTime", "Date Stamp": "DateStamp", "Exif Tag": "ExifTag",
    "GPS Tag": "GPSTag",
}
_POINTERS = {("0th", 34665): "Exif", ("0th", 34853): "GPS", ("Exif", 40965): "Interop"}
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4)}
SCHEMA = "path string, key string, key_label string, value string, value_label string"


class Rational(tuple):
    """Numerator and denominator, told apart from two numbers."""


def label_of(name: str) -> str:
    """``ExposureMode`` as ``Exposure mode``, with the words that the reference has."""
    text = " ".join(re.findall(r"YCbCr|35mm|[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|\d+", name))
    for words, other in _WORDS.items():
        text = text.replace(words, other)
    if name.startswith("GPS"):
        text = re.sub(r"\bRef\b", "reference", text)
    first, *rest = text.split(" ")
    return " ".join([first, *[w.lower() if re.fullmatch(r"[A-Z][a-z]+", w) else w for w in rest]])


#: (key, label) by directory and tag.
_NAMES = {ifd: {tag: (name, label_of(name)) for tag, name in names.items()} for ifd, names in TAGS.items()}


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure of a JPEG's EXIF segment, of a WebP's EXIF chunk or of a TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
        return None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def entries(data: bytes) -> Iterator[tuple[str, int, object]]:
    """(directory, tag, value) of every entry, pointers to directories included.

    Text is bytes, a rational is a ``Rational``, several values are a tuple."""
    block = tiff_block(data)
    if block is None or len(block) < 8:
        return
    order = "<" if block[:2] == b"II" else ">"
    waiting, seen = [("0th", struct.unpack(order + "I", block[4:8])[0])], set()
    while waiting:
        name, at = waiting.pop(0)
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        (n,) = struct.unpack(order + "H", block[at : at + 2])
        for i in range(n):
            raw = block[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(raw) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", raw[:8])
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            where = struct.unpack(order + "I", raw[8:])[0] if size * count > 4 else None
            body = raw[8 : 8 + size * count] if where is None else block[where : where + size * count]
            if len(body) < size * count:
                continue
            if code == "s":
                value: object = body
            else:
                flat = struct.unpack(order + code * count, body)
                values = tuple(map(Rational, zip(flat[::2], flat[1::2]))) if len(code) == 2 else flat
                value = values[0] if len(values) == 1 else values
            if (name, tag) in _POINTERS and isinstance(value, int):
                waiting.append((_POINTERS[name, tag], value))
            yield name, tag, value
        after = block[at + 2 + 12 * n : at + 6 + 12 * n]
        if name == "0th" and len(after) == 4 and any(after):
            waiting.append(("1st", struct.unpack(order + "I", after)[0]))


def decode(value: object) -> str:
    """Readable text: NULs at the end vanish, bytes are ASCII or else Latin-1, rationals are ``n/d``."""
    if isinstance(value, bytes):
        bare = value.rstrip(b"\0")
        try:
            return bare.decode("ascii")
        except UnicodeDecodeError:
            return bare.decode("latin-1")
    if isinstance(value, Rational):
        return f"{value[0]}/{value[1]}"
    if isinstance(value, tuple):
        return ", ".join(decode(x) for x in value)
    return str(value)


def exif_rows(files: DataFrame) -> DataFrame:
    """One row per entry of (path, content), named by its number if not known; files without readable EXIF have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "key", "key_label", "value", "value_label"]
        for b in batches:
            rows = []
            for path, data in zip(b.path, b.content):
                for ifd, tag, value in entries(bytes(data or b"")):
                    name, label = _NAMES[ifd].get(tag, (tag, tag))
                    rows.append((path, f"{ifd}-{name}", f"{ifd} {label}", repr(value), decode(value)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
