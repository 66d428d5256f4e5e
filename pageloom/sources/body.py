"""Bodies as bytes: their charset (native), their size, their text. A body that is too large is a row with an error, never a failed job."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_BODY_BYTES, META_CHARSET_SNIFF_BYTES = 25 * 1024 * 1024, 8192
# Labels that mean another encoding on the web.
LABELS = {
    **dict.fromkeys("ascii us-ascii latin1 l1 iso-8859-1 iso8859-1 iso88591 iso_8859-1 cp1252 x-cp1252 windows-1252".split(), "cp1252"),
    **dict.fromkeys("shift_jis shift-jis sjis ms_kanji x-sjis windows-31j ms932".split(), "cp932"),
    **dict.fromkeys("gb2312 gbk gb_2312-80 chinese x-gbk".split(), "gb18030"), **dict.fromkeys("euc-kr ks_c_5601-1987 ksc5601 korean".split(), "cp949"),
    **dict.fromkeys("iso-8859-9 latin5".split(), "cp1254"), "iso-8859-11": "cp874", "tis-620": "cp874", "big5": "big5hkscs", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf-16": "utf-16-le", "x-user-defined": "latin-1",
}


def header(headers: Column, name: str) -> Column:
    """A header of any case from map<string, string>."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))


def detect_charset(content_type: Column, body: Column) -> Column:
    """The charset in lower case: of the header, else of a meta element in the first 8192 bytes, else utf-8."""
    head = F.decode(F.substring(body, 1, META_CHARSET_SNIFF_BYTES), "ISO-8859-1")
    named = F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1)
    meta = F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)
    equiv = F.regexp_extract(head, r"(?i)<meta[^>]+http-equiv=[\"']?content-type[\"']?[^>]*content=[\"'][^\"']*charset=([\w-]+)", 1)
    return F.lower(F.coalesce(F.nullif(named, F.lit("")), F.nullif(meta, F.lit("")), F.nullif(equiv, F.lit("")), F.lit("utf-8")))


def decoded(body: bytes, label: str) -> str:
    """Bytes as text: bad sequences are replaced, a byte order mark goes, an unknown label is utf-8."""
    name = LABELS.get(label, label)
    try:
        codecs.lookup(name)
    except LookupError:
        name = "utf-8"
    text = body.decode(name, "replace")
    return text.removeprefix("\ufeff")


def decode_body(body: Column, charset: Column) -> Column:
    """The text. UTF-8, which nearly all is, stays native when it is valid; the rest goes through one Arrow function."""

    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([decoded(x, y or "utf-8") if x is not None else None for x, y in zip(b, c, strict=True)], dtype=object)

    plain = charset.isin("utf-8", "utf8") & F.is_valid_utf8(body.cast("string"))
    slow = F.pandas_udf(run, "string")(F.when(~plain, body), charset)
    return F.when(plain, F.regexp_replace(body.cast("string"), "^\ufeff", "")).otherwise(slow)


def read_body(df: DataFrame, *, body: str = "body", headers: str | None = "headers", max_bytes: int = DEFAULT_MAX_BODY_BYTES) -> DataFrame:
    """df with text, charset and error struct<kind, message, limit, size>. Exactly at the limit is not too large; what a header declares is looked at first."""
    size, length = F.octet_length(body).cast("long"), F.lit(None).cast("long")
    kind = F.lit(None).cast("string")
    if headers:
        length = F.regexp_extract(F.coalesce(header(F.col(headers), "content-length"), F.lit("")), r"^\s*(\d+)", 1).try_cast("long")
        kind = header(F.col(headers), "content-type")
    declared, large = length > max_bytes, size > max_bytes
    message = F.when(declared, F.concat(F.lit("Response body too large: Content-Length "), length.cast("string"), F.lit(f" exceeds limit of {max_bytes} bytes"))).when(large, F.lit(f"Response body too large: exceeded limit of {max_bytes} bytes"))
    error = F.when(message.isNotNull(), F.struct(F.lit("BodyTooLarge").alias("kind"), message.alias("message"), F.lit(max_bytes).cast("long").alias("limit"), F.when(declared, length).otherwise(size).alias("size")))
    kept = F.when(message.isNull(), F.col(body))
    out = df.withColumn("charset", detect_charset(F.coalesce(kind, F.lit("")), kept)).withColumn("error", error)
    return out.withColumn("text", decode_body(F.when(F.col("error").isNull(), F.col(body)), F.col("charset")))


def read_files(spark: SparkSession, path: str, *, max_bytes: int = DEFAULT_MAX_BODY_BYTES) -> DataFrame:
    """Files as bodies: path, text, charset, error. Files above the limit aren't read: the filter on their length reaches the source."""
    files = spark.read.format("binaryFile").load(path)
    small = read_body(files.where(F.col("length") <= max_bytes).select("path", F.col("content").alias("body")), headers=None, max_bytes=max_bytes).select("path", "text", "charset", "error")
    large = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("charset"), F.struct(F.lit("BodyTooLarge").alias("kind"), F.concat(F.lit("Response body too large: Content-Length "), F.col("length").cast("string"), F.lit(f" exceeds limit of {max_bytes} bytes")).alias("message"), F.lit(max_bytes).cast("long").alias("limit"), F.col("length").alias("size")).alias("error"))
    return small.unionByName(large)
