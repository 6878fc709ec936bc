"""Request bodies: inputs, content parts, data URIs, capability checks; answers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A content part; fields of other kinds are null.
PART = "struct<type:string,text:string,url:string,mime_type:string,data:binary>"
_RAW = "array<struct<type:string,text:string,image_url:struct<url:string>,mime_type:string,data:string>>"


def read_inputs(requests: DataFrame, id_col: str = "id", input_col: str = "input", *carried: str) -> DataFrame:
    """(id, carried columns, pos, part, error): the contents of JSON inputs: an array of strings, a string, or
    an array of parts. Anything else, and empty ones, is one row with an error."""
    c = F.col(input_col)
    shape = F.schema_of_variant(F.try_parse_json(c))
    null = lambda t: F.lit(None).cast(t)
    text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), null("string").alias("url"), null("string").alias("mime_type"), null("binary").alias("data"))
    strings = F.transform(F.from_json(c, "array<string>"), text)
    one = F.array(text(F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")))

    def part(p):
        url = p["image_url"]["url"]
        inline = F.when(url.startswith("data:"), url)
        return (
            F.when(p["type"] == "text", text(p["text"]))
            .when(p["type"] == "image_url", F.struct(p["type"].alias("type"), null("string").alias("text"), url.alias("url"), data_uri_mime(inline).alias("mime_type"), data_uri_bytes(inline).alias("data")))
            .when(p["type"] == "media", F.struct(p["type"].alias("type"), null("string").alias("text"), null("string").alias("url"), p["mime_type"].alias("mime_type"), F.try_to_binary(p["data"], F.lit("base64")).alias("data")))
        )

    parts = F.transform(F.from_json(c, _RAW), part)
    found = F.when(shape == "ARRAY<STRING>", strings).when((shape == "STRING") & (c != '""'), one).when(shape.startswith("ARRAY<OBJECT"), parts)
    rows = requests.select(id_col, *carried, F.posexplode_outer(found).alias("pos", "part"))
    error = F.when(F.col("pos").isNull(), "input must be a string, array of strings, or array of content parts").when(F.col("part").isNull(), F.concat(F.lit("unknown content type at index "), F.col("pos").cast("string")))
    return rows.withColumn("error", error)


def data_uri_mime(uri: Column) -> Column:
    """Media type of a data URI; text/plain if it names none, null for other addresses."""
    kind = F.regexp_extract(uri, "^data:([^;,]*)", 1)
    return F.when(uri.startswith("data:"), F.when(kind == "", "text/plain").otherwise(kind))


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a data URI, base64 or percent-encoded; null for other addresses."""
    body = F.regexp_extract(uri, "(?s)^data:[^,]*,(.*)$", 1)
    plain = F.encode(F.try_url_decode(body), "utf-8")
    return F.when(uri.startswith("data:"), F.when(F.regexp_extract(uri, "^data:[^,]*(;base64),", 1) != "", F.try_to_binary(body, F.lit("base64"))).otherwise(plain))


def allowed_address(url: Column) -> Column:
    """Schemes that can be read (in any case) and, for hosts of the network, a public
    name or four plain numbers of a public range. Other spellings of numbers (one
    number, octal, hexadecimal, short forms, bracketed addresses) are refused."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = F.regexp(host, F.lit(r"^(localhost\.?|.*\.localhost\.?|0\..*|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*)$"))
    number = F.regexp(host, F.lit(r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"))
    plain = F.regexp(host, F.lit(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"))
    public = (host != "") & ~host.startswith("[") & ~private & (~number | plain)
    return F.regexp(url, F.lit("(?i)^(data:|file://|s3://)")) | (F.regexp(url, F.lit("(?i)^https?://")) & public)


def unsupported(parts: DataFrame, capabilities: DataFrame, mime_col: str = "mime_type") -> DataFrame:
    """Parts whose media type their model does not list, exactly. ``capabilities`` has
    (model, mime_type), a few rows a model; text counts as text/plain."""
    mime = F.when(F.col("type") == "text", "text/plain").otherwise(F.col(mime_col))
    listed = capabilities.select(F.col("model").alias("_m"), F.col("mime_type").alias("_t"))
    return parts.withColumn("_mime", mime).join(listed, (F.col("model") == F.col("_m")) & (F.col("_mime") == F.col("_t")), "left_anti").withColumnRenamed("_mime", "checked_mime")


def checked(parts: DataFrame, capabilities: DataFrame, mime_col: str = "mime_type") -> DataFrame:
    """All parts with ``checked_mime`` and ``listed``: whether their model lists that media type.
    What unsupported() and supported() tell apart, in one pass."""
    mime = F.when(F.col("type") == "text", "text/plain").otherwise(F.col(mime_col))
    names = [c.lower() for c in parts.columns]
    listed = capabilities.select(F.col("model").alias("_m"), F.col("mime_type").alias("_t")).distinct()
    assert not {"_m", "_t"} & set(names), "columns _m and _t are taken"
    both = parts.withColumn("checked_mime", mime).join(listed, (F.col("model") == F.col("_m")) & (F.col("checked_mime") == F.col("_t")), "left")
    return both.withColumn("listed", F.col("_m").isNotNull()).drop("_m", "_t")


def supported(parts: DataFrame, capabilities: DataFrame, mime_col: str = "mime_type") -> DataFrame:
    """The parts that unsupported() leaves out."""
    mime = F.when(F.col("type") == "text", "text/plain").otherwise(F.col(mime_col))
    listed = capabilities.select(F.col("model").alias("_m"), F.col("mime_type").alias("_t"))
    return parts.withColumn("_mime", mime).join(listed, (F.col("model") == F.col("_m")) & (F.col("_mime") == F.col("_t")), "left_semi").drop("_mime")


def first_content(parts: Column) -> Column:
    """struct(kind, text, data) of the first usable part: text or an address that stayed
    one, else bytes of an image or of audio; null for none."""
    image, audio = (lambda p, t=t: F.coalesce(p["mime_type"].startswith(t), F.lit(False)) & p["data"].isNotNull() for t in ("image/", "audio/"))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    usable = F.filter(parts, lambda p: has(p["text"]) | image(p) | audio(p) | (has(p["url"]) & p["data"].isNull()))
    p = F.try_element_at(usable, F.lit(1))
    null = lambda t: F.lit(None).cast(t)
    made = lambda kind, text, data: F.struct(F.lit(kind).alias("kind"), text.alias("text"), data.alias("data"))
    return (
        F.when(has(p["text"]), made("text", p["text"], null("binary")))
        .when(image(p), made("image", null("string"), p["data"]))
        .when(audio(p), made("audio", null("string"), p["data"]))
        .when(has(p["url"]), made("text", p["url"], null("binary")))
    )


def answer_format(accept: Column) -> Column:
    """JSON where the client accepts exactly that, else binary."""
    return F.when(accept == "application/json", "json").otherwise("binary")


def to_answers(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """(id, body): the columns as one JSON object."""
    return rows.select(id_col, F.to_json(F.struct(*columns)).alias("body"))
