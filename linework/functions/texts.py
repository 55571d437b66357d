"""Column builders for the texts of annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the kinds of dimension by their code's low three bits.
DIMENSION_TYPES = {0: "linear", 1: "aligned", 2: "angular", 3: "diameter", 4: "radius", 5: "angular3p", 6: "ordinate"}


def clean_mtext(text: Column) -> Column:
    """Multi-line text without its codes: \\P is a line break, \\~ a space, \\S..; a fraction; fonts and colours go."""
    out = F.regexp_replace(text, r"\\P", "\n")
    out = F.regexp_replace(out, r"\\~", " ")
    out = F.regexp_replace(out, r"\\S([^;^/#]*)[\^/#]([^;]*);", "$1/$2")
    out = F.regexp_replace(out, r"\\[ACcFfHhQTWp][^;\\{}]*;", "")
    out = F.regexp_replace(out, r"\\[LlOoKk]", "")
    out = F.regexp_replace(out, r"(?<!\\)[{}]", "")
    out = F.regexp_replace(out, r"\\([\\{}])", "$1")
    return F.when(F.trim(out) == "<>", "").otherwise(F.trim(out))


def decode_override(text: Column) -> Column:
    """Codes in a dimension's own text: %%c, %%d, %%p and \\U+hhhh of the signs that drawings use."""
    out = F.regexp_replace(text, "(?i)%%c", "⌀")
    out = F.regexp_replace(out, "(?i)%%d", "°")
    out = F.regexp_replace(out, "(?i)%%p", "±")
    for code, sign in (("2205", "⌀"), ("00B0", "°"), ("00B1", "±"), ("00D8", "Ø")):
        out = F.regexp_replace(out, rf"(?i)\\U\+{code}", sign)
    return out


def shown_value(texts: Column, value: Column) -> Column:
    """The first rendered text that is a number, else the value without trailing zeros."""
    number = F.get(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.rlike(r"^\s*[+-]?[0-9]+([.,][0-9]+)?\s*$")), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")
    return F.coalesce(number, plain)


def dimension_text(override: Column, texts: Column, value: Column) -> Column:
    """An override with <> standing for the shown value, else the rendered texts, else the value; one blank hides all."""
    shown = shown_value(texts, value)
    joined = F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "")
    return F.when(override == " ", "").when(F.coalesce(override, F.lit("")) != "", F.replace(override, F.lit("<>"), shown)).when(joined != "", joined).otherwise(shown)


def leader_text(text: Column, texts: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.get(texts, F.lit(0)))


def dimension_type(code: Column) -> Column:
    low, out = code.bitwiseAND(F.lit(7)), F.lit("unknown")
    for k, v in DIMENSION_TYPES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def path_label(path: Column) -> Column:
    """Short name of an element's path: clusters[0].inners[2] is C1.3, clusters[0].outer is C1."""
    c = F.regexp_extract(path, r"clusters\[(\d+)\]", 1)
    i = F.regexp_extract(path, r"inners\[(\d+)\]", 1)
    name = F.regexp_extract(path, r"detected\.(\w+)\[(\d+)\]", 1)
    d = F.regexp_extract(path, r"detected\.(\w+)\[(\d+)\]", 2)
    up = lambda n: (n.try_cast("int") + 1).cast("string")
    return F.when(c == "", path).when(i != "", F.concat(F.lit("C"), up(c), F.lit("."), up(i))).when(name != "", F.concat(F.lit("C"), up(c), F.lit("."), name, up(d))).otherwise(F.concat(F.lit("C"), up(c)))
