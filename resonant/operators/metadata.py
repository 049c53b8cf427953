"""Text tags: named fields, encoder signatures, bounded claims, gain audits, size budgets, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tag keys, upper case, of each named field.
NAMED_KEYS = {
    "title": ("TITLE", "TRACK", "INAM", "©NAM"),
    "album": ("ALBUM", "IPRD", "©ALB"),
    "date": ("DATE", "YEAR", "RECORDED_DATE", "ICRD", "©DAY"),
    "album_artist": ("ALBUMARTIST", "ALBUM_ARTIST", "ALBUM ARTIST", "ALBUM_PERFORMER", "AART"),
    "artist": ("ARTIST", "PERFORMER", "IART", "©ART"),
    "bpm": ("BPM", "IBPM", "TMPO"),
    "comment_quality": ("COMMENTQUALITY",),
    "comments": ("COMMENT", "COMMENTS", "DESCRIPTION", "ICMT", "©CMT"),
    "replaygain_track_gain": ("REPLAYGAIN_TRACK_GAIN", "COM.APPLE.ITUNES:REPLAYGAIN_TRACK_GAIN"),
    "replaygain_album_gain": ("REPLAYGAIN_ALBUM_GAIN", "COM.APPLE.ITUNES:REPLAYGAIN_ALBUM_GAIN"),
    "writing_library": ("VENDOR", "ENCODER", "ENCODED_LIBRARY", "WRITING_LIBRARY", "ISFT", "©TOO"),
    "format_profile": ("FORMAT_PROFILE",),
}
# Encoder signatures that are looked for in lower-cased tag text.
SIGNATURES = ("lame", "libmp3lame", "fraunhofer", " fhg", "nero aac", "fdk-aac", "320kbps", "320 kbps", "v0 (vbr", "joint stereo", "xing")


def named_field(key: Column) -> Column:
    """The field that a tag key means, case ignored; null for another key."""
    pairs = [F.lit(x) for field, keys in NAMED_KEYS.items() for k in keys for x in (k, field)]
    return F.create_map(*pairs)[F.upper(key)]


def first_of_each_field(tags: DataFrame, key: str, name: str = "key", value: str = "value", order: str = "source_order") -> DataFrame:
    """The first tag, in order, of each named field."""
    named = tags.withColumn("field", named_field(F.col(name))).where("field is not null")
    return named.groupBy(key, "field").agg(F.min_by(value, order).alias("value"), F.count("*").alias("tags"))


def signatures(text: Column) -> Column:
    """The signatures that a text holds, a tagging tool's own name left out first."""
    low = F.replace(F.lower(text), F.lit("mp3tag"), F.lit(""))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)), s) for s in SIGNATURES]))


def bounded_claim(text: Column, word: str = "mqa", endings: tuple[str, ...] = ("encoder", "encode", "studio")) -> Column:
    """Whether the word stands alone in the text, or right before one of the endings."""
    tail = "|".join(endings)
    return F.lower(text).rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])|(?<![a-z0-9]){word}\s*(?:{tail})(?![a-z0-9])")


def gain_audit(stored: Column, measured: Column, reference: float = -18.0) -> Column:
    """A stored gain against a measured level: status, gain, implied level, difference and its class."""
    text = F.trim(stored)
    token = F.regexp_replace(F.element_at(F.split(text, r"\s+"), 1), r"[^0-9.\-]", "")
    gain = F.when(token.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), token.cast("double"))
    delta = F.abs(F.lit(reference) + gain - measured)
    status = F.when(text.isNull() | (text == ""), "missing_tag").when(measured.isNull(), "missing_loudness").when(gain.isNull(), "invalid_tag").otherwise("available")
    ok = status == "available"
    kind = F.when(delta < 1, "matches").when(delta < 3, "minor_discrepancy").otherwise("discrepancy")
    return F.struct(status.alias("status"), F.when(ok, gain).alias("gain_db"), F.when(ok, F.lit(reference) + gain).alias("implied"), F.when(ok, delta).alias("delta_db"), F.when(ok, kind).alias("comparison"))


def budgeted(tags: DataFrame, key: str, value: str, order: str, each: int, total: int) -> DataFrame:
    """Which values fit: each within its own bytes, then in order within a total; what was left out is counted, not hidden."""
    n = F.octet_length(value)
    fits = tags.withColumn("bytes", F.when(n <= each, n).otherwise(0)).withColumn("upto", F.sum("bytes").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.octet_length(value) <= each) & (F.col("upto") <= total)
    return fits.groupBy(key).agg(F.count("*").alias("entries"), F.count_if(keep).alias("kept"), F.sum(F.when(keep, F.col("bytes")).otherwise(0)).alias("kept_bytes"), F.count_if(~keep).alias("omitted"))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def marker_positions(bits: DataFrame, marker: str) -> DataFrame:
    """Places (part, frame) where a marker of zeros and ones begins in a bit series (part, frame, bit)."""
    n = len(marker)
    ahead = Window.partitionBy("part").orderBy("frame").rowsBetween(0, n - 1)
    text = bits.withColumn("text", F.array_join(F.collect_list(F.col("bit").cast("string")).over(ahead), ""))
    return text.where(F.col("text") == marker).select("part", "frame")
