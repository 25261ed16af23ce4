"""Column functions of the graph operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.sources.graph import FREQUENCIES


def edge_value(score: Column, value: Column) -> Column:
    """value / 10 * log2(max(score + 1, 1))."""
    return value / 10 * F.log2(F.greatest(score + 1, F.lit(1)).cast("double"))


def branching_discount(degree: Column, mu: float = 2.5, sigma: float = 1.0) -> Column:
    """Log-normal discount of a node's out-degree."""
    x = F.log(degree + 5) / math.log(5) - mu
    return F.exp(-x * x / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))


def fill_in(frame: Column, a: Column, b: Column) -> Column:
    """A frame's text with its first {1} and then its first {2} filled; adverb slots go."""
    bare = F.replace(frame, F.lit("{%}"), F.lit(""))
    once = lambda text, slot, by: F.when(F.instr(text, slot) > 0, F.concat(F.substring_index(text, slot, 1), by, F.substring(text, F.instr(text, slot) + len(slot), F.length(text)))).otherwise(text)
    return once(once(bare, "{1}", a), "{2}", b)


def polarity(value: Column) -> Column:
    return F.when(value >= 0, 1).otherwise(-1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Adverbs and their values; 5 where none is known.
ADVERBS = {
    "never": -10, "n't": -5, "doesn't": -5, "not": -5, "no": -5, "can't": -5, "won't": -5, "don't": -5, "couldn't": -5, "wouldn't": -5,
    "didn't": -5, "shouldn't": -5, "cannot": -5, "isn't": -5, "wasn't": -5, "aren't": -5, "weren't": -5, "rarely": -2, "infrequently": -2,
    "few": -2, "seldom": -2, "hardly": -2, "occasionally": 2, "sometimes": 4, "possibly": 4, "some": 4, "generally": 6, "typically": 6,
    "likely": 6, "probably": 6, "often": 6, "oftentimes": 6, "frequently": 6, "usually": 8, "most": 8, "mostly": 8, "almost": 9,
    "always": 10, "every": 10, "all": 10,
}


def adverb_value(text: Column) -> Column:
    """The least value among a text's words that are known adverbs; 5 without any."""
    known = F.create_map(*[F.lit(x) for pair in ADVERBS.items() for x in pair])
    values = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.try_element_at(known, w))
    return F.coalesce(F.array_min(values), F.lit(5))


def frequency_text(value: Column) -> Column:
    """The canonical text of an adverb's value."""
    return F.element_at(F.create_map(*[F.lit(x) for text, v in FREQUENCIES for x in (v, text)]), value)


def clamp_limit(limit: int | None, over: int = 100, most: int = 100, default: int = 20) -> int:
    """A request's row limit: `default` without one, `over` beyond `most`."""
    return default if limit is None else over if limit > most else limit


#: Former relation names.
RENAMED = {
    "FirstSubeventOf": "HasFirstSubevent", "DesirousEffectOf": "CausesDesire", "ThematicKLine": "ConceptuallyRelatedTo", "SubeventOf": "HasSubevent",
    "SuperThematicKLine": "ConceptuallyRelatedTo", "LastSubeventOf": "HasLastSubevent", "LocationOf": "AtLocation", "CapableOfReceivingAction": "ReceivesAction",
    "PrerequisiteEventOf": "HasPrerequisite", "MotivationOf": "MotivatedByGoal", "PropertyOf": "HasProperty", "EffectOf": "Causes", "DesireOf": "Desires",
}


def renamed_relation(name: Column) -> Column:
    """name and reverse: today's name of a relation, and whether a trailing Inverse swaps its sides."""
    reverse = name.endswith("Inverse")
    base = F.regexp_replace(name, "Inverse$", "")
    known = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    return F.struct(F.coalesce(F.try_element_at(known, base), base).alias("name"), reverse.alias("reverse"))


def dependency(text: Column) -> Column:
    """linktype, word1, index1, word2, index2 of `link(word-1, word-2)`; null if it isn't one."""
    # fixed format
    p = r"^(.+)\((.*)-(\d+)'*, (.*)-(\d+)'*\)$"
    get = lambda i: F.regexp_extract(text, p, i)
    parts = F.struct(get(1).alias("linktype"), get(2).alias("word1"), get(3).cast("int").alias("index1"), get(4).alias("word2"), get(5).cast("int").alias("index2"))
    return F.when(text.rlike(p), parts)


def quoted(text: Column) -> Column:
    """Percent-encoding with + for spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def generalised_links(rows: DataFrame) -> DataFrame:
    """The rows, and once more with the general link type those of prep_x, prepc_x and conj_x."""
    general = F.when(F.col("linktype").rlike("^prepc?_"), "prep").when(F.col("linktype").startswith("conj_"), "conj")
    return rows.unionByName(rows.withColumn("linktype", general).where("linktype is not null"))


def tagged_words(rows: DataFrame) -> DataFrame:
    """place, word, tag of a `text` of word/TAG tokens; the last slash divides."""
    p = "^(.*)/([^/]*)$"
    return rows.select(F.posexplode(F.split("text", " ")).alias("place", "t")).select("place", F.regexp_extract("t", p, 1).alias("word"), F.regexp_extract("t", p, 2).alias("tag"))


def term_list(text: str) -> dict[str, float]:
    """`dog,mouse@0.5,guinea_pig` as terms with weights; a second @ or a bad weight is a ValueError."""
    out: dict[str, float] = {}
    for part in text.split(","):
        term, *weight = part.split("@")
        if len(weight) > 1:
            raise ValueError(f"more than one weight: {part}")
        term = term.strip().replace("_", " ")
        out[term] = out.get(term, 0.0) + (float(weight[0]) if weight else 1.0)
    return out


def bare_sentence(text: Column) -> Column:
    """A sentence for comparison: double spaces single, without points and spaces at its ends."""
    return F.regexp_replace(F.replace(text, F.lit("  "), F.lit(" ")), "^[. ]+|[. ]+$", "")


def stripped(text: Column) -> Column:
    """Surfaces without stray spaces at their ends."""
    return F.trim(text)


def begins_with_family(text: Column, family: list[str]) -> Column:
    """The first word is one of a family of function words."""
    return F.lower(F.substring_index(text, " ", 1)).isin(family)


def second_order(text: Column, rules: list[tuple[str, int, bool]]) -> Column:
    """The text after (pattern, group, abort) rules in order: a hit leaves the group, or nothing if it aborts."""
    for pattern, group, abort in rules:
        hit = F.lit("") if abort else F.regexp_extract(text, pattern, group)
        text = F.when(text.rlike(pattern), hit).otherwise(text)
    return text


def colour_mix(similarities: Column, rgb: list[tuple[str, int, int, int]]) -> Column:
    """r, g, b of a word by its similarities to colours, weighed by their cubes; grey without any."""
    weight = [F.coalesce(F.try_element_at(similarities, F.lit(name)), F.lit(0.0)) for name, *_ in rgb]
    cubes = [F.greatest(w, F.lit(0.0)) ** 3 for w in weight]
    total = sum(cubes[1:], cubes[0])
    channel = lambda i: F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(255), F.round(sum((c * row[i] for c, row in zip(cubes, rgb)), F.lit(0.0)) / total).cast("int")))).otherwise(128)
    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def recoded_prefix(text: Column, relation: str, prefixes: dict[str, str]) -> Column:
    """relation and rest: a text that begins with a prefix moves to the prefix's relation without it."""
    name, rest = F.lit(relation), text
    for prefix, to in prefixes.items():
        name = F.when(text.startswith(prefix), to).otherwise(name)
        rest = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(rest)
    return F.struct(name.alias("relation"), rest.alias("rest"))


def wrapped(text: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), text, F.lit(after))
