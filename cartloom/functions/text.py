"""Column helpers for text whose rules follow ECMAScript strings rather than Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space, as a Java character class body.
JS_SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# Leading numeric part that a lenient float parse accepts.
NUMBER_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


JS_SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_SPACE_CHARS))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(js_trim(c), F.lit(""))


def non_blank(c: Column) -> Column:
    """The text itself (untrimmed) unless it is blank."""
    return F.when(js_trim(c) != "", c)


def parse_number(c: Column) -> Column:
    """Numeric prefix of a text as double, null when there is none."""
    return F.regexp_extract(js_trim(c), NUMBER_PREFIX, 1).try_cast("double")


def parse_integer(c: Column) -> Column:
    """Integer prefix of a text as long, null when there is none."""
    return F.regexp_extract(js_trim(c), r"^([+-]?[0-9]+)", 1).try_cast("long")


def round_half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity and returns a long."""
    return F.floor(c + F.lit(0.5)).cast("long")


def spaces_collapsed(c: Column) -> Column:
    """Runs of white space as one space; single spaces are left alone instead of being replaced by themselves."""
    return F.regexp_replace(c, f"[{JS_SPACE}]{{2,}}|[{JS_SPACE}&&[^ ]]", " ")


def comparable(c: Column) -> Column:
    """Lower-cased, trimmed, inner space runs collapsed."""
    return spaces_collapsed(js_trim(F.lower(c)))


def comparable_title(c: Column) -> Column:
    """Lower-cased title without punctuation except hyphens, single-spaced."""
    return js_trim(spaces_collapsed(F.regexp_replace(F.lower(c), f"[^A-Za-z0-9_{JS_SPACE}-]", "")))


def comparable_url(c: Column) -> Column:
    """Lower-cased URL without trailing slashes; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), "/+$", ""), F.lit(""))


def words(c: Column) -> Column:
    """Distinct words of a trimmed single-spaced text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, " ")))


def character_pairs(c: Column) -> Column:
    """Distinct two-character windows of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), F.lit(1)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two distinct-element arrays: 1 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(
        (F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)
    ).otherwise(1.0 - F.levenshtein(a, b) / longest)


def with_title_similarity(df, a: str, b: str, out: str = "score"):
    """Adds the similarity of two columns of titles that went through ``comparable_title``.

    Words and character pairs are built only for pairs that are neither equal nor one the head of the other.
    """
    ca, cb = F.col(a), F.col(b)
    is_head = F.when(F.length(ca) <= F.length(cb), cb.startswith(F.concat(ca, F.lit(" ")))).otherwise(
        ca.startswith(F.concat(cb, F.lit(" ")))
    )
    quick = F.when(ca == cb, F.lit(1.0)).when((ca == "") | (cb == ""), F.lit(0.0)).when(is_head, F.lit(0.95))
    open_pair = F.col("s_quick").isNull()
    staged = df.withColumn("s_quick", quick)
    for side, c in (("a", ca), ("b", cb)):
        staged = staged.withColumn(f"s_words_{side}", F.when(open_pair, words(c)))
        staged = staged.withColumn(f"s_pairs_{side}", F.when(open_pair, character_pairs(c)))
    slow = F.greatest(
        dice(F.col("s_words_a"), F.col("s_words_b")),
        dice(F.col("s_pairs_a"), F.col("s_pairs_b")),
        levenshtein_similarity(ca, cb),
    )
    return staged.withColumn(out, F.coalesce("s_quick", F.when(open_pair, slow))).drop(
        "s_quick", "s_words_a", "s_words_b", "s_pairs_a", "s_pairs_b"
    )


def simple_title_similarity(a: Column, b: Column) -> Column:
    """Report-grade similarity of lower-cased trimmed titles: equal 1, contained 0.9, else shared words."""
    wa = F.array_distinct(F.split(a, f"[{JS_SPACE}]+"))
    wb = F.array_distinct(F.split(b, f"[{JS_SPACE}]+"))
    return (
        F.when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.9))
        .otherwise(2.0 * F.size(F.array_intersect(wa, wb)) / (F.size(wa) + F.size(wb)))
    )


def image_sku_ids(image_url: Column) -> Column:
    """Upper-case product codes in the file name of an image URL, in order of appearance."""
    file_name = F.substring_index(image_url, "/", -1)
    return F.coalesce(
        F.regexp_extract_all(file_name, F.lit(r"([A-Z][A-Z0-9]{3,9})(?=[-_.])"), F.lit(1)),
        F.array().cast("array<string>"),
    )


def with_title_parts(df, title_col: str = "title"):
    """Adds ``title_base`` and ``title_color``: cart titles carry a colour as "base colour size:- rest" or "base - colour".

    The colour is null when the title names none.
    """
    title = F.col(title_col)
    colon_form = rf"^(.+?)[{JS_SPACE}]+([A-Za-z]+(?:[{JS_SPACE}]+[A-Z0-9]+)?)[{JS_SPACE}]*:-[{JS_SPACE}]*.+$"
    has_colon = F.contains(title, F.lit(":-")) & title.rlike(colon_form)
    return (
        df.withColumn("t_colon", F.coalesce(has_colon, F.lit(False)))
        .withColumn("t_parts", F.when(~F.col("t_colon"), F.split(title, rf"[{JS_SPACE}]+[-–—][{JS_SPACE}]+")))
        .withColumn(
            "title_base",
            F.when(F.col("t_colon"), js_trim(F.regexp_extract(title, colon_form, 1)))
            .when(F.size("t_parts") >= 2, js_trim(F.array_join(F.slice("t_parts", F.lit(1), F.size("t_parts") - 1), " - ")))
            .otherwise(js_trim(title)),
        )
        .withColumn(
            "title_color",
            F.when(F.col("t_colon"), js_trim(F.regexp_extract(title, colon_form, 2))).when(
                F.size("t_parts") >= 2, js_trim(F.element_at("t_parts", -1))
            ),
        )
        .withColumn("title_base", F.nullif("title_base", F.lit("")))
        .withColumn("title_color", F.nullif("title_color", F.lit("")))
        .drop("t_colon", "t_parts")
    )
