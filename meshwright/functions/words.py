"""Normal forms of texts: tokens without function words, each as its lemma. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = "a an the this that these those my your his her its our their some any i you he she it we they me him us them who whom which what am is are was were be been being do does did has have had will would shall should can could may might must to of and or".split()
BLOCKED = ["something", "anything", "everything", "nothing", "thing", "stuff", "someone", "person"]
IRREGULAR = {
    "went": "go", "gone": "go", "goes": "go", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "men": "man", "women": "woman",
    "children": "child", "people": "person", "ran": "run", "ate": "eat", "eaten": "eat", "took": "take", "taken": "take", "made": "make", "saw": "see",
    "seen": "see", "bought": "buy", "thought": "think", "came": "come", "gave": "give", "given": "give", "wrote": "write", "written": "write",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "sang": "sing", "sung": "sing", "knew": "know", "known": "know", "found": "find",
    "left": "leave", "felt": "feel", "kept": "keep", "slept": "sleep", "lives": "life", "knives": "knife", "wolves": "wolf", "leaves": "leaf",
}


def _one_of(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def tokens(text: Column) -> Column:
    """Lower-case words; apostrophes stay within words, and possessives and negations come apart."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), r"n't\b", " not"), r"'(s|re|m|ve|ll|d)\b", " '$1")
    return F.regexp_extract_all(apart, F.lit(r"('?[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*)"), 1)


def untokenized(words: Column) -> Column:
    """Words as a text, with what begins with an apostrophe joined on."""
    return F.regexp_replace(F.array_join(words, " "), " '", "'")


def is_stopword(word: Column) -> Column:
    return _one_of(word, STOP) | word.startswith("'") | (word == "not")


def is_blocked(text: Column) -> Column:
    """Texts that say nothing: without words of their own, or of one blocked word."""
    form = normal_form(text)
    return (form == "") | _one_of(form, BLOCKED)


def suffix(word: Column) -> Column:
    """The regular ending of a word: s, ing, ed or none."""
    return (
        F.when(_one_of(word, list(IRREGULAR)) | word.rlike("(ss|us|is)$"), "")
        .when(word.rlike("^.*[aeiouy].*ing$") & (F.length(word) > 4), "ing")
        .when(word.rlike("^.*[aeiouy].*ed$") & (F.length(word) > 3), "ed")
        .when(word.rlike("[^s]s$") & (F.length(word) > 3), "s")
        .otherwise("")
    )


def lemma(word: Column) -> Column:
    """A word without its regular ending, or its irregular lemma."""
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem = F.regexp_replace(word, "(ing|ed)$", "")
    restored = (
        F.when(stem.rlike(r"([bdgmnprt])\1$"), F.regexp_replace(stem, ".$", ""))
        .when(stem.rlike("^[^aeiou]*[aeiou][^aeiouwxy]$") | stem.rlike("(at|iv|uc|uss?|c|v)$"), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )
    plural = (
        F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|z|ss)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )
    end = suffix(word)
    return F.coalesce(F.try_element_at(known, word), F.when(end.isin("ing", "ed"), restored).when(end == "s", plural).otherwise(word))


def content_words(text: Column) -> Column:
    """The words that aren't function words; all words, if there are none else."""
    every = tokens(text)
    own = F.filter(every, lambda w: ~is_stopword(w))
    return F.when(F.size(own) > 0, own).otherwise(every)


def normal_form(text: Column) -> Column:
    """Lemmas of the content words, joined by spaces."""
    return F.array_join(F.transform(content_words(text), lemma), " ")


def lemma_residue(text: Column) -> Column:
    """What the normal form leaves out: function words, and for each content word its number and ending."""
    every = tokens(text)
    place = lambda i: F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda v: ~is_stopword(v))).cast("string")
    piece = lambda w, i: F.when(is_stopword(w), w).otherwise(F.concat(place(i), F.when(suffix(w) != "", F.concat(F.lit("+"), suffix(w))).otherwise("")))
    return F.array_join(F.transform(every, piece), " ")


def lemma_factor(text: Column) -> Column:
    return F.struct(normal_form(text).alias("form"), lemma_residue(text).alias("residue"))


def extracted_concepts(text: Column, longest: int = 3) -> Column:
    """Distinct normal forms of all runs of up to `longest` content words."""
    words = F.transform(F.filter(tokens(text), lambda w: ~is_stopword(w)), lemma)

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(*map(runs, range(1, longest + 1)))))


def all_known(text: Column, known: list[str]) -> Column:
    """Every word is a function word or in the list."""
    return F.forall(tokens(text), lambda w: is_stopword(w) | lemma(w).isin(known))
