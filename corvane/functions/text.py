"""Text functions: blankness, chunk windows, sanitising, paths and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, format and control characters only.
BLANK = r"^[\p{IsWhite_Space}\p{Cf}\p{Cc}]*$"
#: Terminal escapes: CSI; OSC, DCS, SOS, PM and APC up to their terminator; other two-character escapes.
ESCAPE = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b[ -/]*[0-~]"

#: Characters that take no cell of a terminal, and the ranges of those that take two.
NO_CELL = r"[\p{Mn}\p{Me}\p{Cf}\p{Cc}]"
WIDE = (
    r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}"
    r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}"
)


def blank(text: Column) -> Column:
    """Whether a text is null, empty or made of white space, format and control characters."""
    return F.coalesce(text, F.lit("")).rlike(BLANK)


def split_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of `size` characters that share `overlap` with the one before: array<struct<idx, text>>.

    size <= 0 or a short text gives one window; overlap is held within [0, size - 1]. Blank windows are left out
    but keep their index; a null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    if size <= 0:
        windows = F.array(F.struct(F.lit(0).alias("idx"), text.alias("text")))
    else:
        step = size - min(max(overlap, 0), size - 1)
        n = F.char_length(text)
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.filter(windows, lambda w: ~w["text"].rlike(BLANK))


def strip_escapes(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "")


def sanitize_block(text: Column) -> Column:
    """Without terminal escapes and without control and format characters but line feeds and tabs."""
    return F.regexp_replace(strip_escapes(text), r"[\p{Cf}\p{Cc}&&[^\n\t]]", "")


def sanitize_line(text: Column) -> Column:
    """One line: line breaks and tabs become a space each."""
    return F.translate(sanitize_block(F.regexp_replace(strip_escapes(text), "\r\n", "\n")), "\n\t", "  ")


def display_width(text: Column) -> Column:
    """Cells of a terminal: none for marks, format and control characters, two for wide ones, one for others.

    An emoji sequence counts each of its wide parts.
    """
    shown = F.regexp_replace(strip_escapes(text), NO_CELL, "")
    return F.char_length(shown) + F.char_length(F.regexp_replace(shown, f"[^{WIDE}]", ""))


def truncate(text: Column, cells: int, tail: str = "…") -> Column:
    """The text if it fits in `cells`, else its longest start that does with the tail (one cell for each character)."""
    shown = F.regexp_replace(strip_escapes(text), NO_CELL, "")
    room = cells - len(tail)
    widths = F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c: F.when(c.rlike(f"[{WIDE}]"), 2).otherwise(1))
    step = lambda acc, w: F.struct((acc["used"] + w).alias("used"), (acc["n"] + (acc["used"] + w <= room).cast("int")).alias("n"))
    fit = F.aggregate(widths, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step)["n"]
    cut = F.concat(F.substring(shown, F.lit(1), fit), F.lit(tail)) if room >= 0 else F.substring(F.lit(tail), 1, cells)
    return F.when(display_width(text) <= cells, shown).otherwise(cut)


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB in units of 1024 with one decimal, ties to even."""
    out = F.format_string("%d B", n.cast("long"))
    for unit, power in (("KB", 1), ("MB", 2), ("GB", 3)):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out


def loose_path(digest: Column, compressed: Column | None = None) -> Column:
    """The sharded path of an object: first two characters, then the digest, with .zst if compressed."""
    ext = F.when(compressed, ".zst").otherwise("") if compressed is not None else F.lit("")
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, ext)


def is_digest(c: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def path_problem(path: Column, reserved: tuple[str, ...] = ()) -> Column:
    """Why a relative path is unsafe, else null; the first reason in this order counts."""
    parts = F.split(path, "/")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty").when(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.contains("\\"), "not relative")
        .when(F.exists(parts, lambda p: p == ".."), "parent").when(F.exists(parts, lambda p: (p == "") | (p == ".")), "not clean")
        .when(F.exists(parts, lambda p: p.rlike(r"[. ]$")), "trailing dot or space").when(F.lower(parts[0]).isin(*reserved) if reserved else F.lit(False), "reserved")
    )
