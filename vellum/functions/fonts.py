"""Font names, styles, widths and metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts that tell a style.
BOLD = ("bold", "black", "heavy", "demi", "semibold", "extrabold")
ITALIC = ("italic", "oblique")
SANS = ("sans", "arial", "helvetica", "calibri", "tahoma", "verdana", "futura", "optima", "segoe", "gill")
MONO = ("courier", "mono", "consolas", "lucida console")

# Suffixes of which a family name loses at most one, in this order.
SUFFIXES = ("-BoldOblique", "-BoldItalic", "-Bold", "-Oblique", "-Italic", "-BoldMT", "-ItalicMT", "-RomanMT", "MT", "PS", "-Roman")

# Ascent and descent of the standard fonts by name part, in order; the last stands for all others.
STANDARD_METRICS = ((("courier", "nimbusmono"), 0.629, -0.157), (("times", "nimbusroman"), 0.683, -0.217), (("symbol", "standardsymbols"), 0.692, -0.241), (("zapfdingbats", "dingbats"), 0.820, -0.143), ((), 0.718, -0.207))

# Advances of the standard sans font for codes 32 to 127, in thousandths.
SANS_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    730, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    222, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584, 278,
)


def normalize_name(name: Column) -> Column:
    """Without the leading slash and the subset tag."""
    return F.regexp_replace(F.regexp_replace(name, "^/", ""), "^[^+]{1,7}[+]", "")


def family(name: Column) -> Column:
    """Family name for matching: no subset tag, at most one style suffix gone, letters and digits in lower case."""
    bare = F.when(F.char_length(name) > 7, F.regexp_replace(name, "^[^+]{0,7}[+]", "")).otherwise(name)
    out = bare
    lower = F.lower(bare)
    for suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(lower, F.lit(suffix.lower())), F.left(bare, F.char_length(bare) - len(suffix))).otherwise(out)
    return F.lower(F.regexp_replace(out, "[^0-9A-Za-z]", ""))


def _has(name: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def is_bold(name: Column, flags: Column, weight: Column) -> Column:
    return (flags.bitwiseAND(262144) != 0) | (weight >= 700) | _has(name, BOLD)


def is_italic(name: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(64) != 0) | _has(name, ITALIC)


def is_serif(name: Column) -> Column:
    return ~_has(name, SANS)


def is_mono(name: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(1) != 0) | _has(name, MONO)


def style_bits(italic: Column, serif: Column, mono: Column, bold: Column) -> Column:
    """The flags of a span in the outputs."""
    return sum((F.when(c, v).otherwise(0) for c, v in ((italic, 2), (serif, 4), (mono, 8), (bold, 16))), F.lit(0))


def standard_metric(name: Column, which: int) -> Column:
    out: Column = F.lit(STANDARD_METRICS[-1][1 + which])
    for parts, *values in reversed(STANDARD_METRICS[:-1]):
        out = F.when(_has(normalize_name(name), parts), values[which]).otherwise(out)
    return out


def ascent(name: Column, given: Column) -> Column:
    """Ascent in ems: as given, else of the standard font; kept within reason."""
    v = F.coalesce(given, standard_metric(name, 0))
    return F.least(F.when(v <= 0.01, 0.8).otherwise(v), F.lit(3.0))


def descent(name: Column, given: Column) -> Column:
    v = F.coalesce(given, standard_metric(name, 1))
    return F.greatest(F.when(v >= -0.01, -0.2).otherwise(v), F.lit(-3.0))


def standard_width(name: Column, code: Column) -> Column:
    """Advance in ems of a code in the standard font that a name stands for."""
    n = normalize_name(name)
    table = F.array(*[F.lit(w / 1000) for w in SANS_WIDTHS])
    sans = F.when(code < 32, 0.278).when(code < 128, F.element_at(table, F.greatest(F.least(code, F.lit(127)), F.lit(32)).cast("int") - 31)).otherwise(0.0)
    c = F.when(code.between(32, 126), F.chr(code)).otherwise("")
    times = (
        F.when(c.isin(" ", "'", ",", ".", ":", ";"), 0.25).when(c.isin("!", "I"), 0.333).when(c.rlike("[0-9]"), 0.5).when(c == "M", 0.889).when(c == "W", 0.944)
        .when(c.rlike("[A-Z]"), 0.667).when(c.isin("i", "l"), 0.278).when(c == "m", 0.778).when(c == "w", 0.722).when(c.rlike("[a-z]"), 0.444).otherwise(0.5)
    )
    outside = F.when(_has(n, ("times", "symbol", "zapfdingbats")), 0.5).otherwise(0.55)
    return F.when(_has(n, ("courier",)), 0.6).when((code < 0) | (code >= 256), outside).when(_has(n, ("times",)), times).when(_has(n, ("symbol", "zapfdingbats")), 0.5).otherwise(sans)


def width(exact: Column, default: Column, code: Column) -> Column:
    """Advance: the font's own, its default, or a fixed guess."""
    return F.coalesce(exact, default, F.when(code == 32, 0.33).otherwise(0.55))


def unicode_sequence(*sources: Column, code: Column) -> Column:
    """The first source that knows a code decides; unknown codes stand for themselves."""
    return F.coalesce(*sources, F.array(code))


def code_bytes(is_composite: Column, widest_range: Column) -> Column:
    """Bytes of a code: at least two in composite fonts, else one."""
    return F.when(is_composite, F.greatest(F.lit(2), F.coalesce(widest_range, F.lit(2)))).otherwise(1)
