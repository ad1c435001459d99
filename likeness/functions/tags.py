"""Rule-derived tags: ordered rules over a type line and a text, as one Column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.text import all_of, any_of, or_empty

# The spelling that is unified before matching. It is replaced before
# the text is lowercased, so a capitalised form is left alone.
OLD_WORDING = "converted mana cost"
NEW_WORDING = "mana value"


# Stands between tags while they are one string; no tag holds it.
_BREAK = "\x01"


@dataclass(frozen=True)
class Words:
    """Gives ``tag`` when the lowercased text holds every word of ``needs``, at least
    one of ``either`` (if any are listed) and not the whole of ``unless``.

    With ``in_type`` the first word of ``needs`` may stand in the type line instead.
    """

    tag: str
    needs: tuple[str, ...] = ()
    either: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    in_type: bool = False

    def column(self, type_line: Column, text: Column) -> Column:
        if self.in_type:
            word = F.lit(self.needs[0])
            return F.when(F.contains(type_line, word) | F.contains(text, word), F.lit(self.tag))
        applies = all_of(text, self.needs)
        if self.either:
            applies = applies & any_of(text, self.either)
        if self.unless:
            applies = applies & ~all_of(text, self.unless)
        return F.when(applies, F.lit(self.tag))


@dataclass(frozen=True)
class Threshold:
    """Gives ``prefix`` followed by the number the pattern finds first."""

    prefix: str
    pattern: str

    def column(self, type_line: Column, text: Column) -> Column:
        number = F.regexp_extract(text, self.pattern, 1)
        return F.when(number != "", F.concat(F.lit(self.prefix), number))


Rule = Words | Threshold

# The card tags and the words that give them, in output order.
CARD_RULES: tuple[Rule, ...] = (
    Words("type_enchantment", ("enchantment",), in_type=True),
    Words("type_aura", ("aura",), in_type=True),
    Words("type_equipment", ("equipment",), in_type=True),
    Words("type_artifact", ("artifact",), in_type=True),
    Words("type_creature", ("creature",), in_type=True),
    Words("type_planeswalker", ("planeswalker",), in_type=True),
    Words("type_legendary", ("legendary",), in_type=True),
    Words("tutor", ("search your library",)),
    Words("tutor_to_battlefield", ("search your library", "put", "onto the battlefield")),
    Words(
        "tutor_to_hand",
        ("search your library",),
        either=("reveal", "put it into your hand"),
        unless=("put", "onto the battlefield"),
    ),
    Words("cheat_battlefield", ("onto the battlefield",)),
    Words("attack_trigger", ("whenever", "attacks")),
    Words("etb_trigger", ("whenever", "enters the battlefield")),
    Threshold("mv_leq_", r"mana value (\d+) or less"),
    Words("kw_aura", ("aura",)),
    Words("kw_constellation", ("constellation",)),
    Words("kw_mentor", ("mentor",)),
    Words("kw_equip", ("equip",)),
    Words("kw_saga", ("sagas",)),
    Words("kw_tutor", ("tutor",)),
)


def unify_wording(text: Column) -> Column:
    return F.lower(F.replace(or_empty(text), F.lit(OLD_WORDING), F.lit(NEW_WORDING)))


def card_tags(type_line: Column, text: Column, rules: Sequence[Rule] = CARD_RULES) -> Column:
    """The distinct tags that apply, in rule order.

    ``concat_ws`` leaves out the rules that do not apply. Filtering an array would need
    a lambda, which takes the whole expression out of generated code and lowercases the
    text again for every rule.
    """
    kind, words = F.lower(or_empty(type_line)), unify_wording(text)
    tags = F.concat_ws(_BREAK, *[rule.column(kind, words) for rule in rules])
    none = F.array().cast("array<string>")
    return F.when(tags == "", none).otherwise(F.array_distinct(F.split(tags, _BREAK)))
