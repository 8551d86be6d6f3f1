"""Text, number and date expressions of the cleaning rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from depotspark import reference_values as R


def strip(c: Column) -> Column:
    """Without white space at both ends. The first and last character tell that most texts have none; only others meet the pattern."""
    last = F.substring(c, -1, 1)
    plain = (c >= "!") & (last >= "!") & ~last.isin("\u0085", "\u2028", "\u2029")  # `$` also stands before a last line end
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def null_tokens(c: Column) -> Column:
    """Null where the trimmed upper-case text is a null token."""
    return F.when(F.upper(strip(c)).isin(R.NULL_TOKENS), None).otherwise(c)


def number(c: Column) -> Column:
    """Double, null where the text is no number. The cast itself ignores white space at both ends."""
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Rounded half to even; null where the text is no number."""
    return F.bround(number(c)).cast("long")


def ship_date(ship_no: Column) -> Column:
    """Date inside a well-formed ship number; null for a malformed one or no calendar date."""
    return F.when(ship_no.rlike(R.SHIP_NO), F.try_to_timestamp(F.substring(ship_no, 3, 8), F.lit("yyyyMMdd")).cast("date"))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def week_key(d: Column) -> Column:
    """Monday of the week."""
    return F.date_format(F.date_trunc("week", d), "yyyy-MM-dd")


def keyword_category(name: Column) -> Column:
    """Category of the first keyword rule that matches; -1 for test data, null for none."""
    out = F.lit(None).cast("int")
    for pattern, category in reversed(R.KEYWORD_RULES):
        out = F.when(name.rlike(pattern), F.lit(category)).otherwise(out)
    return out


def nondescriptive(name: Column) -> Column:
    """A name that isn't blank but has fewer than two letters (Han or Latin)."""
    letter, other = "[一-鿿A-Za-z]", "[^一-鿿A-Za-z]*"
    enough = name.rlike(other.join([letter] * R.MIN_NAME_LETTERS))
    return F.coalesce(~enough & name.rlike(r"\S"), F.lit(False))


def storage_class(volume: Column, edge: Column) -> Column:
    """貨架 (shelf) or 棧板 (pallet): pallet without a volume, above the volume or above the edge limit."""
    pallet = volume.isNull() | (volume > R.SHELF_MAX_VOLUME) | (edge > R.SHELF_MAX_EDGE)
    return F.when(F.coalesce(pallet, F.lit(True)), "棧板").otherwise("貨架")


def storage_reason(volume: Column, edge: Column) -> Column:
    """Why: the limits that are passed, or that both hold, or that a dimension is missing."""
    whole = lambda c: F.bround(c).cast("long").cast("string")
    v, e = f"{R.SHELF_MAX_VOLUME / 1000:.0f}L", f"{R.SHELF_MAX_EDGE:.0f}cm"
    over = F.concat_ws(";", F.when(volume > R.SHELF_MAX_VOLUME, F.concat(F.lit("材積"), whole(volume / 1000), F.lit(f"L>{v}"))), F.when(edge > R.SHELF_MAX_EDGE, F.concat(F.lit("最長邊"), whole(edge), F.lit(f"cm>{e}"))))
    return F.when(volume.isNull(), "缺尺寸暫歸棧板(待量測)").when(over != "", over).otherwise(f"材積≤{v}且最長邊≤{e}")


def category_label(category: Column, name: Column) -> Column:
    """name（id）, （空白） without a category."""
    return F.when(category.isNull(), F.lit("(空白)")).when(name.isNull(), category.cast("string")).otherwise(F.concat(name, F.lit("（"), category.cast("string"), F.lit("）")))
