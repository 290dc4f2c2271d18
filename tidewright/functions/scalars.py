"""Scalar column functions: identity hashes, boxes, paths, secrets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Areas in pixels below which an object is small or medium.
SMALL, MEDIUM = 1024, 9216
# What a text may not contain: wider than keys of three kinds and one sort of token with thirty signs at least.
SECRETS = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": "AKIA[0-9A-Z]{16}",
    "token": "gh[pousr]_[A-Za-z0-9]{20,}",
}
# What file names and suffixes of secrets are.
SECRET_NAMES = (".env", "credentials.json", "service_account.json")
SECRET_SUFFIXES = (".key", ".pem", ".p12", ".pfx")


def size_bucket(area: Column) -> Column:
    return F.when(area < SMALL, "small").when(area < MEDIUM, "medium").otherwise("large")


def hash_order(seed: int | str, key: Column) -> Column:
    """SHA-256 of ``seed|key`` as hex: a deterministic shuffle or tie-break."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def derived_seed(*parts: Column) -> Column:
    """The first eight digest bytes of the parts joined by ``|``, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_uniform(seed: int | str, key: Column) -> Column:
    """32 bits of ``hash_order`` as a long: a uniform integer that needs no random state."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bits_of(values: Column, n: int = 64) -> Column:
    """A 64-bit signature of an array: bit i (from the top) is set if element i is over the next one, the last with the first."""
    bit = lambda i: F.when(F.get(values, i) > F.get(values, (i + 1) % n), 1).otherwise(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def intersection(a: Column, b: Column) -> Column:
    """The common area of two structs x1, y1, x2, y2."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Column) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def occlusion(existing: Column, new: Column) -> Column:
    """The share of ``existing`` that ``new`` covers; 1 for an empty box."""
    return F.when(area(existing) > 0, intersection(existing, new) / area(existing)).otherwise(1.0)


def yolo_fault(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Why a normalised centre box is no box of the image: not positive, not shares, outside by over 1e-6 pixels, or empty; null if it is one."""
    outside = ((x - w / 2) * width < -1e-6) | ((y - h / 2) * height < -1e-6) | ((x + w / 2) * width > width + 1e-6) | ((y + h / 2) * height > height + 1e-6)
    box = _pixels(x, y, w, h, width, height)
    empty = (box["x2"] <= box["x1"]) | (box["y2"] <= box["y1"])
    shares = (F.least(x, y, w, h) < 0) | (F.greatest(x, y, w, h) > 1)
    return F.when((w <= 0) | (h <= 0), "not positive").when(shares, "not shares of the image").when(outside, "outside the image").when(empty, "empty in pixels")


def _pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    low = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    high = lambda v, most: F.least(most, F.ceil(v)).cast("int")
    return F.struct(
        low((x - w / 2) * width).alias("x1"), low((y - h / 2) * height).alias("y1"),
        high((x + w / 2) * width, width).alias("x2"), high((y + h / 2) * height, height).alias("y2"),
    )


def yolo_to_xyxy(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A normalised centre box as whole pixels; raises for what ``yolo_fault`` names."""
    fault = yolo_fault(x, y, w, h, width, height)
    return F.when(fault.isNull(), _pixels(x, y, w, h, width, height)).otherwise(F.raise_error(F.concat(F.lit("box "), fault)))


def xyxy_to_yolo(box: Column, width: Column, height: Column) -> Column:
    """A box of whole pixels as a normalised centre box; raises unless it is positive and inside the image."""
    good = (box["x1"] >= 0) & (box["x1"] < box["x2"]) & (box["x2"] <= width) & (box["y1"] >= 0) & (box["y1"] < box["y2"]) & (box["y2"] <= height)
    made = F.struct(
        ((box["x1"] + box["x2"]) / 2 / width).alias("x"), ((box["y1"] + box["y2"]) / 2 / height).alias("y"),
        ((box["x2"] - box["x1"]) / width).alias("w"), ((box["y2"] - box["y1"]) / height).alias("h"),
    )
    return F.when(good, made).otherwise(F.raise_error(F.lit("pixel box is not inside the image")))


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box of corner and size as a struct of two corners."""
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def iou_xywh(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays x, y, width, height; 0 where the union is empty."""
    of = lambda v: corners(*[F.get(v, i).cast("double") for i in range(4)])
    return iou(of(a), of(b))


def box_shares(box: Column, width: Column, height: Column) -> Column:
    """An array x, y, width, height of pixels as shares of the image."""
    return F.array(*[F.get(box, i) / (width if i % 2 == 0 else height) for i in range(4)])


def edge_touches(box: Column, width: Column, height: Column) -> Column:
    return F.struct((box["x1"] == 0).alias("left"), (box["y1"] == 0).alias("top"), (box["x2"] == width).alias("right"), (box["y2"] == height).alias("bottom"))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height)


def capture_id(path: Column) -> Column:
    """The stem of a file without an export's hash and the name of its former format."""
    return F.regexp_replace(F.regexp_replace(stem(path), r"\.rf\.[0-9a-f]+$", ""), r"(_jpeg_jpg|_jpg|_png)$", "")


def leading_number(text: Column, prefix: str) -> Column:
    """The number after ``prefix`` at the start; raises without one."""
    digits = F.regexp_extract(text, f"^{prefix}([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("no number in "), F.coalesce(text, F.lit("null")))))


def first_part(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def safe_name(text: Column) -> Column:
    """Runs of signs other than letters, digits, ``_``, ``.`` and ``-`` become one ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")


def is_digest(text: Column, digits: int = 64) -> Column:
    return F.coalesce(text.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def utc_text(time: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, with a Z."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tokens(text: Column) -> Column:
    """The words of ``text`` between any white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def json_text(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and all signs but the printable ones are escaped; null becomes null."""
    unit = lambda c: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(c), 4, "0")))

    def sign(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 0x10000
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F.when((c == '"') | (c == "\\"), F.concat(F.lit("\\"), c))
        for raw, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            out = out.when(c == raw, F.lit("\\" + short))
        return out.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(pair)

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    escaped = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), sign), ""))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_value(value: Column, kind: str) -> Column:
    """A text, whole number or boolean as JSON."""
    return json_text(value) if kind == "string" else F.coalesce(value.cast("string"), F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A flat JSON object with sorted keys and no spaces, of columns that are JSON already."""
    parts = [F.concat(json_text(F.lit(k)), F.lit(":"), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def object_id(path: Column, line: Column, text: Column) -> Column:
    """The first 16 digits of the digest of [path, line, text] as canonical JSON."""
    value = F.concat(F.lit("["), json_text(path), F.lit(","), line.cast("string"), F.lit(","), json_text(F.trim(text)), F.lit("]"))
    return F.substring(F.sha2(value, 256), 1, 16)


def unsafe_path(p: Column) -> Column:
    """Absolute, with a drive, a backslash or NUL, or with an empty, ``.`` or ``..`` part."""
    part = F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.contains("\\") | p.contains("\x00") | part


def positive_tokens(text: Column, sep: str = ";") -> Column:
    """A joined list as an array, without empty tokens."""
    return F.filter(F.split(text, sep), lambda x: x != "")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def url_quote(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def fixed10(x: Column) -> Column:
    """Ten decimals as text."""
    return F.format_string("%.10f", x)


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(values: Column) -> Column:
    """Whether an array of numbers, or of arrays of them, has only finite ones."""
    return F.forall(values, lambda x: finite(x))


def number(text: Column) -> Column:
    """A finite number from text, null where it is none. Suffixes that Spark's parser takes for types are refused."""
    return F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double"))


def contains_any(document: Column, banned: tuple[str, ...]) -> Column:
    """Whether a serialised document holds one of the strings."""
    out = F.lit(False)
    for x in banned:
        out = out | F.contains(document, F.lit(x))
    return out


def _starts(prefix: str):
    return lambda part: part.startswith(prefix)


def prohibited(path: Column, parts: tuple[str, ...] = ("datasets", "test"), prefixes: tuple[str, ...] = ("test_predictions", "test-results")) -> Column:
    """Whether a path holds protected data or a secret, by its parts, name or suffix, in any case."""
    own = F.split(F.lower(path), "/")
    by_part = F.arrays_overlap(own, F.array(*[F.lit(x) for x in parts]))
    for x in prefixes:
        by_part = by_part | F.exists(own, _starts(x))
    return by_part | F.element_at(own, -1).isin(*SECRET_NAMES) | F.lower(suffix(path)).isin(*SECRET_SUFFIXES)


def canonical_hash(value) -> str:
    """SHA-256 of JSON with sorted keys, no spaces and ASCII escapes, for documents on the driver."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
