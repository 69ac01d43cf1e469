"""Base64 text as columns: coding, data URIs, sizes and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URI = r"^data:([^;,]*)(?:;[^,]*)?,(.*)$"


def encode(data: Column) -> Column:
    return F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))


def decode(text: Column) -> Column:
    return F.unbase64(text)


def encode_url(data: Column) -> Column:
    """URL-safe and without padding."""
    return F.rtrim(F.translate(encode(data), "+/", "-_"), F.lit("="))


def decode_url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), encode(data))


def uri_mime(uri: Column) -> Column:
    return F.regexp_extract(uri, _URI, 1)


def uri_payload(uri: Column) -> Column:
    return F.regexp_extract(uri, _URI, 2)


def is_data_uri(text: Column) -> Column:
    return text.rlike(_URI)


def decoded_size(text: Column) -> Column:
    """Bytes that the text stands for."""
    body = F.rtrim(text, F.lit("="))
    return F.floor(F.length(body) * 3 / 4).cast("long")


def is_image(mime: Column) -> Column:
    return mime.startswith("image/")


def is_text(mime: Column) -> Column:
    return mime.startswith("text/")


def truncated(text: Column, most: int = 32) -> Column:
    """The first characters and the length of a long text."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...("), F.length(text).cast("string"), F.lit(" chars)")))
