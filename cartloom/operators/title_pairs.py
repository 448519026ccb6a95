"""Candidate title pairs inside a session, without comparing every title with every other in large sessions.

A session with few distinct product titles is compared directly: the work per cart title is bounded by that number. Larger sessions are
compared through blocking keys that keep every pair that can reach the wanted similarity, so both ways give the same result and the limit
only chooses the plan. Within a session the rarest elements of a title are its keys; what a sixteenth of the titles share comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.text import character_pairs, words

SMALL_SESSION_TITLES = 64
#: From this similarity on, blocking keys say enough; below it, what is still open is compared with everything.
LEAST_KEYED = 0.6
#: An element that one of so many titles holds is frequent; a session has at most so many times a title's elements of that kind.
FREQUENT_SHARE = 16

Keys = Callable[[Column, Column], Column]


def _rarest_first(items: Column, ranks: Column) -> Column:
    """Elements by frequency in the session (0 unless frequent), then by text: the same order for all titles of a session."""
    ranked = F.transform(items, lambda x: F.struct(F.coalesce(F.try_element_at(ranks, x), F.lit(0).cast("bigint")).alias("r"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda y: y["x"])


def _prefix(items: Column, overlap: Column, ranks: Column) -> Column:
    """The items that any partner sharing ``overlap`` of them must hit: all but the last ``overlap - 1`` in order."""
    return F.slice(_rarest_first(items, ranks), F.lit(1), F.greatest(F.size(items) - overlap + 1, F.lit(0)))


def _numbered_pairs(t: Column) -> Column:
    """Character pairs with their occurrence number, so that repeated pairs count separately."""
    raw = F.when(
        F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(
        raw,
        lambda g, i: F.concat(g, F.size(F.filter(F.slice(raw, F.lit(1), i + 1), lambda o: o == g)).cast("string")),
    )


def _tagged(tag: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(tag), x))


def _heads(t: Column) -> Column:
    """The text up to each of its words, shortest first."""
    all_words = F.split(t, " ")
    return F.transform(F.sequence(F.lit(1), F.size(all_words)), lambda i: F.array_join(F.slice(all_words, F.lit(1), i), " "))


def title_elements(t: Column) -> Column:
    """Everything of a title that can be a key: words, character pairs, numbered character pairs."""
    return F.concat(_tagged("w", words(t)), _tagged("b", character_pairs(t)), _tagged("e", _numbered_pairs(t)))


def similarity_keys(threshold: float) -> tuple[Keys, Keys]:
    """Blocking keys of cart and product titles for ``title_similarity >= threshold``, which is at least LEAST_KEYED.

    Dice of at least s between sets needs s/(2-s) of either view's elements in common. An edit distance of at most (1-s) of the longer length
    L leaves at least L*(2s-1) - 1 numbered character pairs untouched, and where that is nothing, titles are so short that their single
    characters serve. Sharing that many elements means sharing one of the first n - overlap + 1 in a fixed order. A title that heads another
    is met by its whole text on one side and by the other's heads, in either direction.
    """
    if threshold < LEAST_KEYED:
        raise ValueError(f"blocking keys need a similarity of {LEAST_KEYED} at least")
    share, slack = threshold / (2 - threshold), 2 * threshold - 1

    def common(t: Column, ranks: Column) -> Column:
        word_list, pairs, numbered = _tagged("w", words(t)), _tagged("b", character_pairs(t)), _tagged("e", _numbered_pairs(t))
        word_keys = _prefix(word_list, F.ceil(F.size(word_list) * share - 1e-9).cast("int"), ranks)
        # texts without any pair count as equal in their pairs, so all of them meet
        pair_keys = F.when(F.size(pairs) == 0, F.array(F.lit("b"))).otherwise(_prefix(pairs, F.ceil(F.size(pairs) * share - 1e-9).cast("int"), ranks))
        untouched = F.greatest(F.ceil(F.length(t) * slack - 1 - 1e-9).cast("int"), F.lit(1))
        letters = F.when(F.length(t) * slack <= 1 + 1e-9, _tagged("u", F.array_distinct(F.split(t, "")))).otherwise(F.array().cast("array<string>"))
        return F.concat(word_keys, pair_keys, _prefix(numbered, untouched, ranks), letters)

    def cart(t: Column, ranks: Column) -> Column:
        return F.array_distinct(F.concat(F.array(F.concat(F.lit(">"), t)), _tagged("<", _heads(t)), common(t, ranks)))

    def product(t: Column, ranks: Column) -> Column:
        return F.array_distinct(F.concat(F.array(F.concat(F.lit("<"), t)), _tagged(">", _heads(t)), common(t, ranks)))

    return cart, product


def containment_elements(t: Column) -> Column:
    """The three-character windows of a text, tagged as the keys they give."""
    return F.when(F.length(t) >= 3, _tagged("<", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: t.substr(i, F.lit(3)))))).otherwise(
        F.array().cast("array<string>")
    )


def containment_keys() -> tuple[Keys, Keys]:
    """Keys that meet whenever one text contains the other or both share a word.

    The contained text offers its rarest three-character window (or itself, when shorter); the containing text offers
    all of its windows of one to three characters.
    """
    return (lambda t, ranks: _containment_sides(t, ranks)[0]), (lambda t, ranks: _containment_sides(t, ranks)[1])


def _containment_sides(t: Column, ranks: Column) -> tuple[Column, Column]:
    windows = F.flatten(
        F.transform(
            F.array(F.lit(1), F.lit(2), F.lit(3)),
            lambda n: F.when(
                F.length(t) >= n,
                F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: t.substr(i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    anchor = F.when(F.length(t) < 3, F.concat(F.lit("<"), t)).otherwise(F.get(_rarest_first(containment_elements(t), ranks), F.lit(0)))
    empty = F.lit("<")
    container = _tagged("<", windows)
    shared_words = _tagged("w", words(t))
    # each side is offered both as the contained and as the containing text
    as_container = F.array_distinct(F.concat(_tagged("c", container), F.array(F.concat(F.lit("c"), empty)), shared_words))
    as_contained = F.array(F.concat(F.lit("p"), anchor))
    cart = F.concat(as_container, as_contained)
    product = F.concat(
        F.array(F.concat(F.lit("c"), anchor)),
        F.array_distinct(F.concat(_tagged("p", container), F.array(F.concat(F.lit("p"), empty)), shared_words)),
    )
    return cart, product


def busy_sessions(rows: DataFrame, small_session: int) -> DataFrame:
    """Sessions with more than ``small_session`` rows: the only ones that can have as many distinct titles."""
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_session).select("session_id")


def _frequent(titles: DataFrame, elements: Callable[[Column], Column], small_session: int, many: DataFrame | None = None) -> DataFrame:
    """For each session with more than ``small_session`` product titles, its frequent elements with their counts.

    The map is bounded: an element in a sixteenth of the titles is one of at most sixteen times a title's elements.
    """
    if many is not None:
        # most sessions go before their titles are made comparable and told apart; so many rows a session keep the other side small
        titles = titles.join(many.select("session_id").distinct().hint("shuffle_hash"), "session_id", "left_semi")
    sizes = titles.where("side = 'p'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_session)
    large = titles.join(sizes, "session_id")
    counted = large.select("session_id", "n", F.explode(elements(F.col("title"))).alias("x")).groupBy("session_id", "n", "x").agg(F.count(F.lit(1)).alias("c"))
    often = counted.where(F.col("c") * FREQUENT_SHARE > F.col("n")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("x", "c"))).alias("ranks"))
    return sizes.join(often, "session_id", "left").select("session_id", F.coalesce("ranks", F.expr("cast(map() as map<string, bigint>)")).alias("ranks"))


def title_pairs(
    cart_titles: DataFrame,
    product_titles: DataFrame,
    keys: tuple[Keys, Keys],
    elements: Callable[[Column], Column],
    small_session: int = SMALL_SESSION_TITLES,
    many: DataFrame | None = None,
) -> DataFrame:
    """Pairs worth scoring: ``session_id, c_title`` and the product columns prefixed ``p_``; every pair occurs once.

    Both inputs are distinct per (session_id, title); ``keys`` gives the keys of cart and product titles from a title and the session's
    frequent elements, which are among its ``elements``. Titles of small sessions share one block, titles of large ones meet per key. ``many`` may tell which
    sessions can be large at all (``busy_sessions``).
    """
    both = cart_titles.select("session_id", "title", F.lit("c").alias("side")).unionByName(product_titles.select("session_id", "title", F.lit("p").alias("side")))
    frequent = _frequent(both, elements, small_session, many)

    def blocked(titles: DataFrame, own: Keys, prefix: str) -> DataFrame:
        flagged = titles.join(frequent, "session_id", "left").withColumn("keys", F.when(F.col("ranks").isNotNull(), own(F.col("title"), F.col("ranks")))).drop("ranks")
        return flagged.select(
            "session_id",
            *[F.col(c).alias(prefix + c) for c in titles.columns if c != "session_id"],
            F.col("keys").alias(prefix + "keys"),
            F.explode(F.coalesce("keys", F.array(F.lit("")))).alias("block"),
        )

    met = blocked(cart_titles, keys[0], "c_").join(blocked(product_titles, keys[1], "p_"), ["session_id", "block"])
    first_block = F.array_min(F.array_intersect("c_keys", "p_keys"))
    return met.where(F.col("c_keys").isNull() | (F.col("block") == first_block)).drop("block", "c_keys", "p_keys")


def all_title_pairs(cart_titles: DataFrame, product_titles: DataFrame, parts: int = 16) -> DataFrame:
    """Every cart title with every product title of its session, dealt out over ``parts`` squared cells of each session."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    carts = cart_titles.select("session_id", F.col("title").alias("c_title"), F.pmod(F.hash("title"), F.lit(parts)).alias("i"), F.explode(every).alias("j"))
    products = product_titles.select(
        "session_id", *[F.col(c).alias(f"p_{c}") for c in product_titles.columns if c != "session_id"], F.pmod(F.hash("title"), F.lit(parts)).alias("j"), F.explode(every).alias("i")
    )
    return carts.join(products, ["session_id", "i", "j"]).drop("i", "j")
