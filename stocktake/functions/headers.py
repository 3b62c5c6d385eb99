"""Fixed-offset headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_CHIPS = {5: "Nintendo MMC5 — audio expansion", 19: "Namco 163 — audio expansion", 24: "Konami VRC6 — audio expansion", 26: "Konami VRC6 — audio expansion", 85: "Konami VRC7 — audio expansion"}


def byte(hex_text: Column, i: int) -> Column:
    return F.conv(F.substring(hex_text, 2 * i + 1, 2), 16, 10).cast("int")


def cartridge_header(text: Column) -> Column:
    """struct<mapper, prg_kb, chr_kb, has_battery, mirroring, tv_system, audio_chip> of a hexadecimal header; null if it is none."""
    h = F.upper(F.regexp_replace(text, r"[ \t]", ""))
    b6, b7, b9 = byte(h, 6), F.coalesce(byte(h, 7), F.lit(0)), F.coalesce(byte(h, 9), F.lit(0))
    mapper = b7.bitwiseAND(F.lit(0xF0)).bitwiseOR(F.shiftright(b6, 4))
    chips = F.create_map(*[x for k, v in AUDIO_CHIPS.items() for x in (F.lit(k), F.lit(v))])
    fields = F.struct(
        mapper.alias("mapper"), (byte(h, 4) * 16).alias("prg_kb"), (byte(h, 5) * 8).alias("chr_kb"), (b6.bitwiseAND(F.lit(2)) != 0).alias("has_battery"),
        F.when(b6.bitwiseAND(F.lit(8)) != 0, "Four-screen").when(b6.bitwiseAND(F.lit(1)) != 0, "Vertical").otherwise("Horizontal").alias("mirroring"),
        F.when(b9.bitwiseAND(F.lit(1)) != 0, "PAL").otherwise("NTSC").alias("tv_system"), F.try_element_at(chips, mapper).alias("audio_chip"),
    )
    return F.when(h.rlike("^4E45531A([0-9A-F]{2}){4,}$"), fields)


def disk_image_header(content: Column) -> Column:
    """struct<version, logical_bytes, sha1, parent_sha1> of a version 5 disk image header of 124 bytes; null if it is none."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    digest = lambda at: F.lower(F.hex(F.substring(content, at, 20)))
    parent = digest(105)
    fields = F.struct(number(13, 4).cast("int").alias("version"), number(33, 8).alias("logical_bytes"), digest(85).alias("sha1"), F.when(parent != "0" * 40, parent).alias("parent_sha1"))
    return F.when((F.substring(content, 1, 8) == F.lit("MComprHD").cast("binary")) & (F.length(content) >= 124) & (number(13, 4) == 5), fields)
