"""Secret scans over a trigram index, with DataFrame functions alone.

From each rule's regex comes a Boolean trigram query: alternatives, each with trigrams
that any match of it must hold. The index has one posting (trigram, document) for each
trigram of any query that a document holds. Postings are intersected by counting them
per document and alternative; only then does the regex run, on the candidates. A rule
whose regex forces no trigram is run on every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from re import _constants as op
from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key, spare
from likeness.session import cut


class Rule(NamedTuple):
    """Matches of ``regex``, leftmost and non-overlapping, whose ``group`` has at least
    ``least`` characters. The regex must mean the same to Java and to Python."""

    kind: str
    regex: str
    group: int
    least: int


# The three base rules come first, in this order.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    # The run of letters is taken to its end, so a shorter match can be left out here.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
RULES = BASE + MORE
# A set of strings a part of a regex may stand for is followed up to this many.
MOST_STRINGS = 64


def strings(item) -> set[str] | None:
    """The strings one parsed part of a regex stands for, or None when they are too many."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is op.SUBPATTERN:
        return joined(value[-1])
    if kind is op.BRANCH:
        sets = [joined(branch) for branch in value[1]]
        return None if None in sets else set().union(*sets)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        one = joined(inner)
        if one is None or most > 8:
            return None
        found = {"".join(p) for n in range(least, most + 1) for p in product(one, repeat=n)}
        return found if len(found) <= MOST_STRINGS else None
    return None


def joined(items) -> set[str] | None:
    whole = {""}
    for item in items:
        part = strings(item)
        if part is None or len(whole) * len(part) > MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> frozenset[frozenset[str]]:
    """Alternatives, one of which has all its trigrams in the lowercased text of any match;
    empty when the regex forces none."""
    runs, run = [], {""}
    for item in [*regex_parser.parse(regex), None]:
        part = strings(item) if item else None
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        runs.append(run)
        run = part or {""}
    runs.append(run)
    best = max(runs, key=lambda run: min(map(len, run)))
    found = frozenset(map(trigrams, best))
    return frozenset() if frozenset() in found else found


def postings(docs: DataFrame, id: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """The index: (trigram, id) for the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for alt in trigram_query(r.regex) for g in alt})
    held = docs.select(F.col(id).alias("id"), F.lower(F.col(text)).alias("low"))
    each = F.array_compact(
        F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    )
    return held.select("id", F.explode(each).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, rules): bits of the rules of which a document has all trigrams of some alternative."""
    asked = [
        (n, a, gram, len(alt))
        for n, rule in enumerate(rules)
        for a, alt in enumerate(sorted(map(sorted, trigram_query(rule.regex))))
        for gram in alt
    ]
    # The alternatives in which a trigram occurs, as a constant looked up in place.
    by_gram: dict[str, list] = {}
    for n, a, gram, size in asked:
        by_gram.setdefault(gram, []).append(
            F.struct(F.lit(n).alias("rule"), F.lit(a).alias("alt"), F.lit(size).alias("size"))
        )
    uses = F.create_map(*[x for g, u in by_gram.items() for x in (F.lit(g), F.array(*u))])
    hits = index.select("id", F.explode(uses[F.col("trigram")]).alias("use"))
    whole = hits.groupBy("id", "use").agg(F.count("*").alias("n")).filter(F.expr("n >= use.size"))
    bit = F.expr("shiftleft(1L, use.rule)")
    return whole.groupBy("id").agg(F.bit_or(bit).alias("rules"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as structs (start, order, end), in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    between = F.split(text, rule.regex, -1)
    lengths = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"),
            F.length(match).alias("all"),
            (
                F.length(F.regexp_extract(match, rule.regex, rule.group))
                if rule.group
                else F.length(match)
            ).alias("part"),
        ),
    )
    empty = F.expr("CAST(array() AS array<struct<start:int,order:int,end:int>>)")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state, one):
        start = state["at"] + one["gap"]
        end = start + one["all"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        more = F.when(one["part"] >= rule.least, F.array(span)).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(state["found"], more).alias("found"))

    return F.aggregate(lengths, zero, step, lambda state: state["found"])


def with_secrets(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    name: str = "secrets",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """``docs`` with an array of structs (kind, start, end): code points, end exclusive,
    sorted by start and then by the order of the rules.

    Null and empty texts have no secrets. Rows with the same id are scanned each on its
    own, rows without id too. Other columns are passed on. ``name`` must be new.
    """
    if spare(docs, name) != name:
        raise ValueError(f"documents have a column {name!r} already")
    if len(rules) > 62:
        raise ValueError("at most 62 rules in one scan")
    index = cut(postings(docs, key(id), key(text), rules))
    near = candidates(index, rules)
    given, bits = spare(docs, "candidate_id"), spare(docs, "candidate_rules")
    # Written, so that its size is known: few candidates go to where the texts are.
    near = cut(near.select(F.col("id").alias(given), F.col("rules").alias(bits)))
    joined = docs.join(near, docs[key(id)].eqNullSafe(near[given]), "left")
    body, none = F.coalesce(F.col(key(text)), F.lit("")), F.expr(
        "CAST(array() AS array<struct<start:int,order:int,end:int>>)"
    )
    found = []
    for order, rule in enumerate(rules):
        if trigram_query(rule.regex):
            near_it = F.col(bits).bitwiseAND(F.lit(1 << order).cast("long")) != 0
        else:
            near_it = body.rlike(rule.regex)
        found.append(F.when(near_it, spans(body, rule, order)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    sorted_spans = F.sort_array(F.concat(*found))
    named = F.transform(
        sorted_spans,
        lambda s: F.struct(
            F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )
    return joined.select(*[docs[key(c)] for c in docs.columns], named.alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        at, out = state["at"], state["out"]
        fresh = F.concat(
            out, F.substring(text, at + 1, s["start"] - at), F.lit("["), s["kind"], F.lit("]")
        )
        return F.struct(
            F.greatest(at, s["end"]).alias("at"),
            F.when(s["start"] >= at, fresh).otherwise(out).alias("out"),
        )

    whole = F.aggregate(
        spans, zero, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def hide_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; ``n_chars``, if there, follows the text."""
    name = spare(docs, "secrets")
    found = with_secrets(docs, id, text, name).withColumn(text, redacted(F.col(key(text)), F.col(name)))
    if "n_chars" in docs.columns:
        length = F.length(F.col(key(text))).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size(name) > 0, length).otherwise(F.col("n_chars")))
    return found.select(*[key(c) for c in docs.columns])
