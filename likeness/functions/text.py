"""Column builders for the text fields of a card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FACE_SEPARATOR = " || "
TYPE_SEPARATOR = " :: "

# The one-letter colour codes and their words.
COLOR_WORDS = {"W": "White", "U": "Blue", "B": "Black", "R": "Red", "G": "Green"}
NO_COLOR_WORD = "Colorless"

# The address of a card's public page.
CARD_PAGE_ROOT = "https://scryfall.com/"


# What counts as white space around a name.
SPACE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _no_text() -> Column:
    return F.array().cast("array<string>")


def or_no_items(items: Column) -> Column:
    return F.coalesce(items, _no_text())


def first_non_empty(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def parse_int(text: Column, default: int) -> Column:
    """The whole number written in ``text``; ``default`` for blank or anything else."""
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(number, F.lit(default).cast("bigint"))


def stored_text(oracle_text: Column, faces: Column) -> Column:
    """The record's own text, else the non-empty texts of its faces."""
    texts = F.filter(F.transform(faces, lambda f: f["oracle_text"]), lambda t: t != "")
    from_faces = F.array_join(F.coalesce(texts, _no_text()), FACE_SEPARATOR)
    return F.when(oracle_text != "", oracle_text).otherwise(from_faces)


def described_text(oracle_text: Column, faces: Column) -> Column:
    """As ``stored_text``, but every face is named by its type line."""

    def describe(face: Column) -> Column:
        kind, text = or_empty(face["type_line"]), or_empty(face["oracle_text"])
        return F.when((kind != "") | (text != ""), F.concat(kind, F.lit(TYPE_SEPARATOR), text))

    parts = F.array_compact(F.transform(faces, describe))
    from_faces = F.array_join(F.coalesce(parts, _no_text()), FACE_SEPARATOR)
    return F.when(oracle_text != "", oracle_text).otherwise(from_faces)


def image_uri(image_uris: Column, faces: Column, key: str) -> Column:
    """The image under ``key``: the record's own entry decides if there is one, even an
    empty one; else the first face that has the key."""

    def has(uris: Column) -> Column:
        return F.coalesce(F.map_contains_key(uris, key), F.lit(False))

    face = F.get(F.filter(faces, lambda f: has(f["image_uris"])), F.lit(0))
    source = F.when(has(image_uris), image_uris).otherwise(face["image_uris"])
    return or_empty(F.try_element_at(source, F.lit(key)))


def legalities_json(legalities: Column) -> Column:
    return F.when(F.size(legalities) > 0, F.to_json(legalities)).otherwise(F.lit(""))


def parse_legalities(text: Column) -> Column:
    """Format → status; text that is no such JSON gives an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def color_words(colors: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in COLOR_WORDS.items() for x in pair])
    named = F.transform(colors, lambda c: F.coalesce(F.try_element_at(words, c), c))
    return F.when(F.size(colors) > 0, F.array_join(named, "/")).otherwise(F.lit(NO_COLOR_WORD))


def embedding_text(
    name: Column,
    type_line: Column,
    mana_cost: Column,
    colors: Column,
    tags: Column,
    text: Column,
    include_name: bool = False,
    tags_weight: int = 1,
) -> Column:
    """The lines an encoder reads; empty fields are left out, colours never are."""

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    tag_line = line("Tags", F.array_join(tags, " "))
    lines = [line("Name", name)] if include_name else []
    lines += [
        line("Type", type_line),
        line("ManaCost", mana_cost),
        line("Colors", color_words(colors)),
        *[tag_line] * max(1, tags_weight),
        line("Oracle", text),
    ]
    return F.concat_ws("\n", *lines)


def card_page(set_code: Column, number: Column, card_id: Column) -> Column:
    root = F.lit(CARD_PAGE_ROOT)
    return (
        F.when(
            (set_code != "") & (number != ""),
            F.concat(root, F.lit("card/"), set_code, F.lit("/"), number),
        )
        .when(card_id != "", F.concat(root, F.lit("card/"), card_id))
        .otherwise(root)
    )


def stats_label(power: Column, toughness: Column) -> Column:
    """``power/toughness`` if either is known, else an empty label."""
    known = (or_empty(power) != "") | (or_empty(toughness) != "")
    label = F.concat(or_empty(power), F.lit("/"), or_empty(toughness))
    return F.when(known, label).otherwise(F.lit(""))


def list_label(items: Column, separator: str) -> Column:
    return F.array_join(or_no_items(items), separator)


def mana_value_label(cmc: Column) -> Column:
    """Rounded half to even, as printf does; empty for zero or unknown."""
    label = F.format_string("%d", F.bround(cmc, 0).cast("bigint"))
    return F.when(cmc > 0, label).otherwise(F.lit(""))


def similarity_label(similarity: Column) -> Column:
    """Rounded half to even, as printf does. Only odd multiples of 1/16 lie exactly half
    way between two numbers of three decimals."""
    sixteenths = similarity * 16
    half_way = (sixteenths == F.floor(sixteenths)) & (F.floor(sixteenths) % 2 != 0)
    even = F.bround(similarity.cast("decimal(20,10)"), 3).cast("double")
    label = F.format_string("sim %.3f", F.when(half_way, even).otherwise(similarity))
    return F.when(similarity > 0, label).otherwise(F.lit(""))


def any_of(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def all_of(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(True)
    for needle in needles:
        found = found & F.contains(text, F.lit(needle))
    return found
