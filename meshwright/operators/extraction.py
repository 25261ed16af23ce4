"""From sentences to assertions: weighted patterns over a probabilistic grammar.

Sentences are parsed in Arrow batches; a task compiles the grammar once. The parser is an
agenda of spans by falling probability (the first time that a span is taken is its best
derivation), with rules split into two-symbol steps. Spans that can't be part of a reading of a least
probability, by a bound on what the words and rules around them can add, are left out; if no reading
reaches it, a second search goes down to LEAST, so the best reading is the one without it. The parser sees of a word only its tags and whether
the grammar names it, so sentences that differ in other words alone have one reading, which a task
keeps (SHAPES of them). Everything around it (skip rules, recoding, adverbs, statements) is DataFrame code.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn

#: Weight, relation, pattern.
PATTERNS = """
1.0 HasFirstSubevent the first thing you do when you {VP:1} is {VP:2}
1.0 HasLastSubevent the last thing you do when you {VP:1} is {VP:2}
1.0 HasPrerequisite something you need to do before you {VP:1} is {VP:2}
1.0 MadeOf {NP:1} {BE} {ADVP:a} made of {NP:2}
1.0 IsA {NP:1} {BE} a kind of {NP:2} {POST:0}
1.0 IsA {NP:1} {BE} a sort of {NP:2} {POST:0}
1.0 IsA {NP:1} {BE} a type of {NP:2} {POST:0}
1.0 AtLocation somewhere {NP:1} can be is {P} {NP:2}
1.0 AtLocation somewhere {NP:1} can be is {NP:2}
1.0 AtLocation you are likely to find {NP:1} {P} {NP:2}
0.1 AtLocation {NP:1} can be {P} {NP:2}
1.0 UsedFor {NP:1} {BE} used for {NP:2}
1.0 UsedFor {NP:1} {BE} used to {VP:2}
1.0 CapableOf {NP:1} {BE} capable of {NP:2}
1.0 CapableOf an activity {NP:1} can do is {VP:2}
1.0 CapableOf an activity {NP:1} can do is {NP:2}
1.0 MotivatedByGoal you would {VP:1} because you want to {VP:2}
1.0 MotivatedByGoal you would {VP:1} because you want {NP:2}
1.0 MotivatedByGoal you would {VP:1} because {S:2}
1.0 Desires {NP:1} {ADVP:a} wants to {VP:2}
1.0 Desires {NP:1} {ADVP:a} wants {NP:2}
1.0 Desires {NP:1} {ADVP:a} want to {VP:2}
1.0 Desires {NP:1} {ADVP:a} want {NP:2}
1.0 Desires {NP:1} {ADVP:a} likes to {VP:2}
1.0 Desires {NP:1} {ADVP:a} like to {VP:2}
1.0 DefinedAs {NP:1} {BE} defined as {NP:2}
0.1 DefinedAs {NP:1} {BE} the {NP:2}
0.1 DefinedAs {NP:2} {BE} called {NP:1}
1.0 DefinedAs the common name for {NP:2} is {NP:1}
1.0 SymbolOf {NP:1} {BE} {DT} symbol of {NP:2}
1.0 CausesDesire {NP:1} would make you want to {VP:2}
1.0 Causes the effect of {XP:1} is that {S:2}
1.0 Causes the effect of {XP:1} is {NP:2}
1.0 Causes the consequence of {XP:1} is that {XP:2}
1.0 Causes something that might happen as a consequence of {XP:1} is that {XP:2}
1.0 Causes something that might happen as a consequence of {XP:1} is {XP:2}
1.0 Causes {ADVP:a} {NP:1} causes you to {VP:2}
1.0 Causes {ADVP:a} {NP:1} causes {NP:2}
1.0 HasSubevent one of the things you do when you {VP:1} is {XP:2}
1.0 HasSubevent something that might happen when you {VP:1} is {XP:2}
1.0 HasSubevent something that might happen while {XP:1} is {XP:2}
1.0 HasSubevent something you might do while {XP:1} is {XP:2}
1.0 HasSubevent to {VP:1} you must {VP:2}
0.8 HasSubevent when you {VP:1} you {VP:2}
1.0 HasSubevent when you {VP:1} , you {VP:2}
0.5 HasSubevent when {S:1} , {S:2}
0.1 ReceivesAction {NP:1} {BE} {PASV:2}
1.0 PartOf {NP:1} {BE} part of {NP:2}
1.0 CreatedBy you make {NP:1} by {NP:2}
1.0 CreatedBy {NP:1} {BE} created by {NP:2}
1.0 CreatedBy {NP:1} {BE} made by {NP:2}
1.0 CreatedBy {NP:1} {BE} created with {NP:2}
1.0 CreatedBy {NP:1} {BE} made with {NP:2}
1.0 CapableOf {NP:1} ca {n't:a} {VP:2}
0.01 CapableOf {NP:1} can {ADVP2:a} {VP:2}
0.001 CapableOf {NP:1} {ADVP1:a} {VP:2}
1.0 UsedFor you can use {NP:1} to {VP:2}
1.0 AtLocation something you might find {P} {NP:2} is {NP:1}
1.0 AtLocation something you find {P} {NP:2} is {NP:1}
0.1 AtLocation there are {NP:1} {P} {NP:2}
1.0 HasA {NP:1} {ADVP:a} {HAVE} {NP:2}
1.0 HasPrerequisite {NP:1} requires {NP:2}
1.0 HasPrerequisite if you want to {VP:1} then you should {VP:2}
1.0 HasPrerequisite {VP:1} requires that you {VP:2}
0.002 IsA {NP:1} {BE} {ADVP:a} {NP:2} {POST:0}
0.02 IsA to {VP:1} {BE} to {VP:2}
0.3 HasProperty {NP:1} {BE} {ADVP:a} {AP:2}
1.0 UsedFor people use {NP:1} to {VP:2}
1.0 UsedFor {NP:1} is for {XP:2}
1.0 UsedFor {VP:1} is for {XP:2}
1.0 junk picture description : {XP:1}
0.001 junk {NP:1}
1.0 junk things that are often found together are : {NP:1}
1.0 junk When you {VP:1} you do the following : 1
"""
#: The grammar's productions with their probabilities.
GRAMMAR = """
NP -> N1 [0.1] | DT N1 [0.1] | AP N1 [0.1] | DT AP N1 [0.1]
NP -> Npr [0.1] | PRP [0.05] | WP [0.05] | NP PP [0.05] | NP join NP [0.05]
NP -> VG [0.05] | VG NP [0.05] | VG ADV [0.05] | VG NP P [0.04] | VG NP VP [0.01]
NP -> QUOT NP QUOT [0.05] | NP POS NP [0.05]
N1 -> NN [0.3] | NNS [0.3] | NN N1 [0.3] | NNS N1 [0.1]
Npr -> NNP [0.5] | NNP Npr [0.5]
join -> ',' [0.4] | 'and' [0.4] | 'or' [0.2]
AP -> JJ [0.1] | VBN [0.1] | PRPp [0.1] | JJR [0.1] | JJS [0.1] | CD [0.1]
AP -> AP join AP [0.1] | AP AP [0.2]
AP -> JJ PP [0.1]
P -> IN [0.5] | TO [0.5]
PP -> P NP [0.5] | TO VP [0.5]
V -> VB [0.3] | VBZ [0.3] | VBP [0.3] | VB V [0.05] | V RP [0.05]
VG -> VBG [0.8] | VB VBG [0.1] | VBG RP [0.1]
VP -> V [0.2] | V NP [0.15] | V PP [0.15] | V NP PP [0.1]
VP -> STATEVB NP [0.1] | STATEVB AP [0.1] | VP ADV [0.1]
VP -> ADVP V [0.02] | ADVP V NP [0.02] | ADVP V PP [0.02] | ADVP V NP PP [0.02]
VP -> ADVP STATEVB NP [0.01] | ADVP STATEVB AP [0.01]
STATEVB -> BE [0.5] | CHANGE [0.5]
POST -> [0.9] | VBN PP [0.03] | WDT VP [0.04] | WDT S [0.03]
S -> NP VP [1.0]
XP -> NP [0.4] | VP [0.3] | S [0.3]
PASV -> VBN [0.4] | PASV PP [0.3] | PASV ADV [0.3]
BEWORD -> 'be' [0.1] | 'is' [0.15] | 'are' [0.15] | 'was' [0.1] | 'being' [0.1]
BEWORD -> 'were' [0.1] | 'been' [0.1] | ''re' [0.1] | ''m' [0.1]
BE -> BEWORD [0.8] | MD BEWORD [0.1] | MD RB BEWORD [0.1]
MD -> 'can' [1.0]
HAVE -> 'has' [0.25] | 'have' [0.25] | 'contain' [0.25] | 'contains' [0.25]
DO -> 'do' [0.4] | 'does' [0.3] | 'did' [0.3]
CHANGE -> 'get' [0.25] | 'gets' [0.25] | 'become' [0.25] | 'becomes' [0.25]
ADV -> RB [0.5] | RP [0.3] | RBR [0.2]
ADVP -> [0.9] | RB [0.025] | RB ADVP [0.025] | MD ADVP [0.025] | DO ADVP [0.025]
ADVP1 -> RB [0.25] | RB ADVP [0.25] | MD ADVP [0.25] | DO ADVP [0.25]
ADVP2 -> [0.9] | RB [0.075] | RB ADVP2 [0.025]
"""
LEAST = 1e-55
#: Symbols that a word of their own answers for in the parser's bounds.
CARRIERS = {"P", "PP", "join", "BE", "BEWORD", "MD", "HAVE", "DO", "CHANGE", "ADV", "V", "VG", "STATEVB", "PASV"}
#: A reading is first sought down to this share of the most that its words allow, then down to LEAST; rounding may change a bound by SLACK.
SHARE, SLACK = 1e-14, 1e-9
#: Longer sentences aren't read; a reading's parts have six words at most to be kept.
MOST_WORDS = 30
#: Readings and words that a task keeps.
SHAPES, WORDS, BOUNDS = 20_000, 100_000, 1_000

#: Closed classes, and words whose likeliest tags their endings don't tell: tag, then words.
LEXICON = """
DT a an the this these those every no any some each
PRP i you he she it we they them him me us themselves
PRP$ my your his her its our their
IN in on at of with from by for about into over under near after before because if than as like between through when while
TO to
WP who what
WDT that which who
RB not n't never always often usually sometimes rarely very more most only also again away
RP up down out off on over away
RBR more less
MD would will should could might must may
JJ good bad big small large old young famous hard easy cute hot cold new likely happy sad weird older
CD one two three four five six seven eight nine ten 60
NN toast jam jury police person house knife shirt president phone minute diamond song sky plant
NNS people police wrongs seconds
NNP lucy beatles mcdonald us
VB ask try pour bug stab get take race mine dial kill tail cake can make see eat find buy water use have do go impanel record show
VBZ resides is has does makes
VBP are have eat see resides
"""


def _productions() -> list[tuple[str, list[str], float]]:
    out = []
    for line in GRAMMAR.strip().splitlines():
        left, right = line.split("->")
        for part in right.split(" | "):
            body, weight = re.match(r"(.*)\[([\d.]+)\]", part.strip()).groups()
            out.append((left.strip(), [s[1:-1] if s.startswith("'") else s for s in body.split()], float(weight)))
    return out


def _patterns() -> list[tuple[float, str, list[str]]]:
    rows = (line.split(" ", 2) for line in PATTERNS.strip().splitlines())
    return [(float(w), relation, text.split()) for w, relation, text in rows]


def _symbol(part: str) -> str:
    return part[1:-1].rpartition(":")[0] or part[1:-1] if part.startswith("{") else part.lower()


def tags(word: str, first: bool) -> dict[str, float]:
    """Relative weights of a word's tags: the lexicon's, else by ending and capital, else noun before verb."""
    low = word.lower()
    out: dict[str, float] = dict.fromkeys(_lexicon().get(low, ()), 1.0)
    if word == '"':
        return {"QUOT": 1.0}
    if low == "'s":
        return {"POS": 1.0, "VBZ": 0.2}
    if low.isdigit():
        return {"CD": 1.0}
    if word[:1].isupper() and not first and low not in ("i",):
        out["NNP"] = 1.0
    if not out:
        for ending, found in (("ing", {"VBG": 0.7, "JJ": 0.4}), ("ed", {"VBN": 0.7, "VBD": 0.3, "JJ": 0.2}), ("en", {"VBN": 0.5}), ("ly", {"RB": 1.0}), ("s", {"NNS": 0.8, "VBZ": 0.2})):
            if low.endswith(ending) and len(low) > len(ending) + 2:
                out.update(found)
                break
        else:
            if re.search("(ous|ful|ive|able|al|ic|less|ish)$", low):
                out["JJ"] = 0.8
    out.setdefault("NN", 0.009)
    out.setdefault("VB", 0.001)
    return {t.replace("PRP$", "PRPp"): w for t, w in out.items()}


@lru_cache(1)
def _lexicon() -> dict[str, list[str]]:
    found = defaultdict(list)
    for line in LEXICON.strip().splitlines():
        tag, *words = line.split()
        for w in words:
            found[w].append(tag)
    return found


class Parser:
    """Rules as two-symbol steps: a node is a right side of which a part is done."""

    def __init__(self):
        self.begins = defaultdict(list)  # symbol: the nodes that it takes from nothing to one
        self.wants: list = []  # node: the symbol that it goes on with; None once it is done
        self.makes: list = []  # node that is done: its left side and weight
        self.at: list[int] = []  # node: how many symbols are done
        self.empty: dict[str, float] = {}
        self.patterns = _patterns()
        self.rules = _productions()
        for left, right, weight in self.rules:
            if right:
                self._add(left, right, weight)
            else:
                self.empty[left] = weight
        self.first_pattern = len(self.wants)
        for k, (weight, _, parts) in enumerate(self.patterns):
            self._add(k, [_symbol(p) for p in parts], weight)
        self.named = {*self.begins, *(w for w in self.wants if w is not None)}
        lefts = {left for left, _, _ in self.rules}
        self.words = {x for x in self.named if x not in lefts} | {t.replace("PRP$", "PRPp") for found in _lexicon().values() for t in found}
        self.kind = lru_cache(WORDS)(self._kind)
        self.read = lru_cache(SHAPES)(self._read)
        self.bounds = lru_cache(BOUNDS)(self._bounds)

    def _add(self, left: str | int, right: list[str], weight: float) -> None:
        self.begins[right[0]].append(len(self.wants))
        for i in range(1, len(right) + 1):  # a node's successor is the next one
            self.wants.append(right[i] if i < len(right) else None)
            self.makes.append((left, weight) if i == len(right) else None)
            self.at.append(i)

    def _kind(self, word: str, first: bool) -> tuple:
        """All that a reading depends on: the word itself if the grammar names it, and its tags with their shares."""
        low, found = word.lower(), tags(word, first)
        whole = sum(found.values())
        return low if low in self.named else "", tuple((tag, w / whole) for tag, w in found.items())

    def parse(self, words: list[str]) -> tuple[float, int, dict] | None:
        """Probability, pattern number and the span of each part of the best full reading."""
        return self.read(tuple(self.kind(word, i == 0) for i, word in enumerate(words)))

    def _bounds(self, words: frozenset) -> tuple[dict, dict, dict, dict]:
        """In sentences of these words and tags: the most that a word's rules keep, the most that is left above an item, by its
        head, and the nodes that a symbol at the first word and at later ones begins.

        A rule's weight is shared out among its carriers: words and tags, and the symbols of CARRIERS, each of
        which hands what it gets on to one word of its own. Outside an item these words are counted with their
        shares, so rules above it count with what isn't theirs.
        """
        made = set(words)
        while new := {left for left, right, _ in self.rules if left not in made and made.issuperset(right)}:
            made |= new
        rules = []  # left, right, weight, shares, and the place that the left side's own share goes to
        for left, right, weight in [*(r for r in self.rules if r[1]), *((k, list(map(_symbol, parts)), w) for k, (w, _, parts) in enumerate(self.patterns))]:
            carry = [x in self.words or x in CARRIERS for x in right]
            shares = [c / max(1, sum(carry)) * isinstance(left, str) for c in carry]
            rules.append((left, right, weight, shares, carry.index(True) if left in CARRIERS else -1))
        known = [rule for rule in rules if made.issuperset(rule[1])]
        used: dict = {}
        up: dict = {rule[0]: 1.0 for rule in known if isinstance(rule[0], int)}
        more = True
        while more:
            more = False
            for left, right, weight, shares, to in known:
                if not up.get(left):
                    continue
                for i, x in enumerate(right):
                    u = weight ** shares[i] * (used.get(left, 0.0) if i == to else 1.0)
                    p = weight ** (1 - sum(shares) + shares[i]) * (up[left] if to in (-1, i) else 1.0)
                    if u > used.get(x, 0.0):
                        used[x], more = u, True
                    if p > up.get(x, 0.0):
                        up[x], more = p, True
        node = 0
        for left, right, weight, shares, to in rules:
            whole = up.get(left, 0.0) if made.issuperset(right) else 0.0
            for i in range(1, len(right) + 1):
                up[-1 - node] = weight ** (1 - sum(shares[i:])) * (whole if to < i else float(whole > 0))
                node += 1
        first = {x: [-1 - node for node in nodes if up[-1 - node]] for x, nodes in self.begins.items()}
        later = {x: [node for node in nodes if -1 - node < self.first_pattern] for x, nodes in first.items()}  # patterns begin at the first word
        return used, up, first, later

    def _read(self, kinds: tuple) -> tuple[float, int, dict] | None:
        """The best reading: sought among the likely spans, and among all if no reading there is likely enough."""
        used, *known = self.bounds(frozenset(x for word, shares in kinds for x in (word, *(tag for tag, _ in shares)) if x in self.words))
        most = [max([used.get(word, 0.0), *(share * used.get(tag, 0.0) for tag, share in shares)]) for word, shares in kinds]
        before, behind = [1.0], [1.0]
        for x, y in zip(most, reversed(most)):
            before.append(before[-1] * x)
            behind.append(behind[-1] * y)
        behind.reverse()
        least = max(before[-1] * SHARE, LEAST)
        found = self._above(kinds, least, known, before, behind)
        if least > LEAST and (found is None or found[0] < least):
            # the best one has as much as any that was found
            found = self._above(kinds, found[0] if found else LEAST, known, before, behind)
        return found

    def _above(self, kinds: tuple, least: float, known: list, before: list[float], behind: list[float]) -> tuple[float, int, dict] | None:
        """The best reading, if its probability is `least` or more; else another one or none."""
        n, count = len(kinds), 0
        up, first, later = known
        least *= 1 - SLACK
        agenda: list = []
        best: dict = {}
        back: dict = {}
        waiting, found_from = defaultdict(list), defaultdict(list)
        push, pop, wants, makes = heapq.heappush, heapq.heappop, self.wants, self.makes

        # items are (symbol, from, to) and (-1 - node, from, to); whole readings of a pattern are (k, 0, n)
        begun = [((head, i, i + 1), p) for i, (word, shares) in enumerate(kinds) for head, p in [(word, 1.0), *shares]]
        begun += [((symbol, i, i), p) for symbol, p in self.empty.items() for i in range(n + 1)]
        offers = [(p, item, None) for item, p in begun]
        closed = set()
        while True:
            for p, item, how in offers:
                head, i, j = item
                if p * up.get(head, 0.0) * before[i] * behind[j] >= least and p > LEAST and p > best.get(item, 0.0):
                    best[item], back[item] = p, how
                    count += 1
                    push(agenda, (-p, count, item))
            while agenda and agenda[0][2] in closed:
                pop(agenda)
            if not agenda:
                return None
            p, _, item = pop(agenda)
            closed.add(item)
            head, i, j = item
            p = -p
            if isinstance(head, str):
                found_from[head, i].append((item, p))
                offers = [(p, (node, i, j), (None, item)) for node in (later if i else first).get(head, ())]
                offers += [(p * q, (other[0] - 1, other[1], j), (other, item)) for other, q in waiting.get((head, i), ())]
            elif head >= 0:
                if i == 0 and j == n:
                    return p, head, self._spans(item, back)
                offers = []
            elif (symbol := wants[-1 - head]) is None:
                left, w = makes[-1 - head]
                offers = [(p * w, (left, i, j), item)] if isinstance(left, str) or (i == 0 and j == n) else []
            else:
                waiting[symbol, j].append((item, p))
                offers = [(p * q, (head - 1, i, other[2]), (item, other)) for other, q in found_from.get((symbol, j), ())]

    def _spans(self, item: tuple, back: dict) -> dict[int, tuple[int, int]]:
        """Part of the pattern: the words it covers."""
        spans, step = {}, back[item]
        while step is not None:
            before, part = back[step]
            spans[self.at[-1 - step[0]] - 1] = (part[1], part[2])
            step = before
        return spans


def tokenize(sentence: str) -> list[str]:
    """Words, marks, and what an apostrophe begins, each on its own."""
    text = sentence.split(". ")[0].strip("?!.")
    text = re.sub(r"(\w)(n't)\b", r"\1 \2", text)
    text = re.sub(r"('(?:s|re|m|ve|ll|d))\b", r" \1", text)
    return re.findall(r"n't|'\w+|[\w$#-]+(?:'\w+)?|[^\w\s]", text)


def untokenize(words: list[str]) -> str:
    text = " ".join(words)
    text = re.sub(r" (n't|'(?:s|re|m|ve|ll|d)\b|[,.;:!?])", r"\1", text)
    return re.sub(r'" (.*?) "', r'"\1"', text)


_PARSED = "sentence string, probability double, frame string, relation string, text1 string, text2 string, adverb string"


@lru_cache(1)
def parser() -> Parser:
    return Parser()


def parse_sentence(sentence: str | None) -> tuple:
    words = tokenize(sentence or "")
    found = parser().parse(words) if 0 < len(words) <= MOST_WORDS else None
    if found is None:
        return sentence, None, None, None, None, None, None
    p, k, spans = found
    _, relation, parts = parser().patterns[k]
    frame, texts = [], {}
    for i, part in enumerate(parts):
        low, high = spans[i]
        group = part[1:-1].partition(":")[2] if part.startswith("{") else ""
        if group:
            texts[group] = untokenize(words[low:high])
        frame += [] if group == "0" else [f"{{{group}}}"] if group.isdigit() else words[low:high]
    return sentence, p, untokenize(frame), relation, texts.get("1"), texts.get("2"), texts.get("a")


def parsed(sentences: DataFrame) -> DataFrame:
    """The best reading of each `sentence`; null beyond MOST_WORDS words or without one."""

    def run(batches):
        names = [c.split()[0] for c in _PARSED.split(", ")]
        for batch in batches:
            rows = [parse_sentence(s) for s in batch.column(0).to_pylist()]
            kinds = [pa.float64() if n == "probability" else pa.string() for n in names]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return sentences.select(F.col("sentence").cast("string").alias("sentence")).mapInArrow(run, _PARSED)


def parsed_once(sentences: DataFrame) -> DataFrame:
    """`parsed`, where a sentence that stands often is read once; tasks are as many as the session's shuffles have, however small the files."""
    tasks = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = sentences.select(F.col("sentence").cast("string").alias("said"))
    read = parsed(said.select(F.col("said").alias("sentence")).repartition(tasks, "sentence").distinct())
    return said.join(read, F.col("said").eqNullSafe(F.col("sentence"))).drop("said")


def skipped(sentence: Column, relation: Column, text1: Column, text2: Column, adverb: Column) -> Column:
    """Readings that aren't kept."""
    long = lambda t: F.size(F.split(F.trim(F.coalesce(t, F.lit(""))), r"\s+")) > 6
    begins = [sentence.startswith(p) for p in ("Situation:", "The statement", "To understand", "In the event")]
    out = relation.isNull() | (relation == "junk") | ((relation == "AtLocation") & (F.coalesce(adverb, F.lit("")) == "of"))
    out = out | F.coalesce(text2, F.lit("")).startswith("do the following") | long(text1) | long(text2)
    for b in begins:
        out = out | b
    return out


def recoded(relation: Column, adverb: Column) -> Column:
    """relation and adverb after the rewrites by preposition."""
    a = F.coalesce(adverb, F.lit(""))
    place = relation.isin("IsA", "CapableOf") & a.isin("in", "on", "at", "by")
    name = F.when((relation == "AtLocation") & (a == "near"), "LocatedNear").when(place, "AtLocation").otherwise(relation)
    return F.struct(name.alias("relation"), F.when(place, "").otherwise(a).alias("adverb"))


def statements(sentences: DataFrame) -> DataFrame:
    """sentence, frame, relation, text1, text2, value and freq of the readings that are kept."""
    rows = parsed(sentences).where(~skipped(*[F.col(c) for c in ("sentence", "relation", "text1", "text2", "adverb")]))
    rows = rows.withColumn("r", recoded(F.col("relation"), F.col("adverb")))
    value = fn.adverb_value(F.col("r.adverb"))
    return rows.select("sentence", "frame", "r.relation", "text1", "text2", value.alias("value"), fn.frequency_text(value).alias("freq"))


#: Copies of a frame without a word to look up; sentences are dealt over them.
SALTS = 16
#: Frames that are tried in each sentence's own row, without a join.
FEW = 64


def _bare_frame() -> Column:
    return F.btrim(F.replace("text", F.lit("{%}"), F.lit("")), F.lit(". "))


def _pattern() -> Column:
    return F.concat(F.lit("^"), F.regexp_replace(_bare_frame(), r"\{[12]\}", "(.+)"))


def _tried(sentences: DataFrame, known: list, kind) -> DataFrame:
    """sentence, frame_id and the two texts by the first of the known frames that fits."""
    frames = sorted(((-f.goodness, f.frame_id, f.pattern) for f in known if f.pattern is not None))

    def first(fits, value) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for i, (_, frame_id, pattern) in enumerate(frames):
            out = out.when(fits(i, pattern), value(i, frame_id, pattern))
        return out

    rows = sentences.select("sentence", F.btrim("sentence", F.lit(". ")).alias("bare"))
    at = first(lambda i, p: F.rlike("bare", F.lit(p)), lambda i, f, p: F.lit(i)).cast("int")
    rows = rows.select("sentence", "bare", F.explode(F.array(at)).alias("at"))  # found once, not for each column
    one = lambda value: first(lambda i, p: F.col("at") == i, value)
    text = lambda k: one(lambda i, f, p: F.regexp_extract("bare", p, k)).cast("string").alias(f"text{k}")
    return rows.select("sentence", one(lambda i, f, p: F.lit(f)).cast(kind).alias("frame_id"), text(1), text(2))


def frame_index(frames: DataFrame, sentences: DataFrame) -> DataFrame:
    """frame_id, goodness, pattern and `word`: the frame's literal word that stands in the fewest sentences.

    A literal word counts if it is a whole word wherever the pattern fits: between spaces, with more of the
    frame behind it. A frame without one, or whose text has regex signs that could undo that, has a null word.
    """
    shown = frames.where("goodness >= 2").select("frame_id", "goodness", "text", _bare_frame().alias("bare"))
    plain = ~F.regexp_replace("bare", r"\{[12]\}", "").rlike(r"[?*+|()\[\]{}\\\\^$]")
    parts = F.split("bare", " ")
    words = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: w.rlike("^[A-Za-z0-9']+$"))
    known = shown.select("frame_id", "goodness", _pattern().alias("pattern"), F.when(plain, words).otherwise(F.array().cast("array<string>")).alias("words"))
    wanted = known.select(F.explode("words").alias("word")).distinct()
    counted = _words_of(sentences).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rated = known.select("frame_id", F.explode("words").alias("word")).join(counted, "word", "left")
    rarest = rated.groupBy("frame_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    return known.drop("words").join(rarest, "frame_id", "left")


def _bare_sentences(sentences: DataFrame) -> DataFrame:
    return sentences.select("sentence", F.btrim("sentence", F.lit(". ")).alias("bare")).where("sentence is not null").distinct()


def _words_of(sentences: DataFrame) -> DataFrame:
    """word: the distinct words of each sentence."""
    return _bare_sentences(sentences).select(F.explode(F.array_distinct(F.split("bare", " "))).alias("word"))


def frame_matches(sentences: DataFrame, frames: DataFrame) -> DataFrame:
    """sentence, frame_id and the two texts: the first frame by goodness (2 or more) whose pattern fits from the start.

    A sentence meets only the frames whose rarest literal word it has, by an equi join on that word, and the
    few frames without one; then the pattern decides. Up to FEW frames are tried one after the other in the row itself:
    no sentence is then dealt, cut into words or grouped.
    """
    known = frames.where("goodness >= 2").select("frame_id", "goodness", _pattern().alias("pattern")).limit(FEW + 1).collect()
    if len(known) <= FEW and all(f.frame_id is not None for f in known):
        return _tried(sentences, known, frames.schema["frame_id"].dataType)
    index = frame_index(frames, sentences)
    bare = _bare_sentences(sentences)
    by_word = bare.select("sentence", "bare", F.explode(F.array_distinct(F.split("bare", " "))).alias("word")).join(index.where("word is not null"), "word")
    dealt = bare.withColumn("salt", F.pmod(F.xxhash64("sentence"), F.lit(SALTS)).cast("int"))
    rest = dealt.join(index.where("word is null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "salt")
    tried = by_word.select("sentence", "bare", "frame_id", "goodness", "pattern").unionByName(rest.select("sentence", "bare", "frame_id", "goodness", "pattern"))
    fits = tried.where(F.rlike("bare", F.col("pattern")))
    text = lambda i: F.call_function("regexp_extract", F.col("bare"), F.col("pattern"), F.lit(i)).alias(f"text{i}")
    best = F.min_by(F.struct("frame_id", "bare", "pattern"), F.struct(F.negate("goodness"), "frame_id"))
    found = fits.groupBy("sentence").agg(best.alias("m")).select("sentence", "m.frame_id", F.col("m.bare").alias("bare"), F.col("m.pattern").alias("pattern"))
    return sentences.select("sentence").join(found.select("sentence", "frame_id", text(1), text(2)), "sentence", "left")


def tag_probabilities(tagged: DataFrame) -> DataFrame:
    """word, tag and share of each tagged word (`word/TAG`) over all; closed-class tags don't count."""
    one = F.explode(F.split("text", " "))
    pairs = tagged.select(one.alias("t")).where("instr(t, '/') > 0").select(F.lower(F.regexp_extract("t", "^(.*)/([^/]*)$", 1)).alias("word"), F.regexp_extract("t", "^(.*)/([^/]*)$", 2).alias("tag"))
    kept = pairs.where(~F.col("tag").isin("RB", "MD", "DO"))
    total = kept.agg(F.count("*").alias("total"))
    return kept.groupBy("word", "tag").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("word", "tag", "n", (F.col("n") / F.col("total")).alias("share"))


#: Tags of closed classes, the weight of a word not seen and its split, and that of the possessive.
CLOSED = ["RB", "MD", "DO"]
SMOOTHING, UNSEEN, POSSESSIVE = 0.01, (("NN", 0.9), ("VB", 0.1)), 5000.0


def unigram_probabilities(tagged: DataFrame, lexicon: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """word, tag and share over tagged texts (`at`, their place in reading order, and `text` of word/TAG) and a lexicon (word, tag) read after them.

    Tags of closed classes count only where the lexicon has them. Every word has a little of the tags of unseen
    words. The total grows by `smoothing` with each occurrence of a word that hasn't counted before: once for a
    word that counts, and for each closed occurrence until then. The possessive has one tag of fixed weight.
    """
    each = tagged.select(F.col("at").alias("text_at"), F.posexplode(F.split("text", " ")).alias("place", "t")).where("instr(t, '/') > 0")
    seen = each.select(F.struct("text_at", "place").alias("at"), F.lower(F.regexp_extract("t", "^(.*)/([^/]*)$", 1)).alias("word"), F.regexp_extract("t", "^(.*)/([^/]*)$", 2).alias("tag"))
    closed = F.col("tag").isin(CLOSED)
    first = seen.where(~closed).groupBy("word").agg(F.min("at").alias("first"))
    waiting = seen.where(closed).join(first, "word", "left").where("first is null or at < first").groupBy("word").agg(F.count("*").alias("waited"))
    open_ = seen.where(~closed).select("word", "tag").unionByName(lexicon.select("word", "tag"))
    counted = open_.groupBy("word", "tag").agg(F.count("*").cast("double").alias("n"))
    words = counted.select("word").distinct().withColumn("once", F.lit(1)).join(waiting, "word", "full_outer")
    entered = words.agg(F.sum(F.coalesce("once", F.lit(0)) + F.coalesce("waited", F.lit(0))).alias("entered"))
    total = counted.agg(F.sum("n").alias("n")).join(entered, F.lit(True)).select((F.coalesce("n", F.lit(0.0)) + smoothing * F.coalesce("entered", F.lit(0))).alias("total"))
    unseen = words.select("word", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(smoothing * w).alias("n")) for t, w in UNSEEN])).alias("u")).select("word", "u.*")
    shares = counted.unionByName(unseen).where("word <> '\\'s'").groupBy("word", "tag").agg(F.sum("n").alias("n"))
    own = total.where("total > 0").select(F.lit("'s").alias("word"), F.lit("POS").alias("tag"), F.lit(POSSESSIVE).alias("n"))
    return shares.unionByName(own).join(F.broadcast(total), F.lit(True)).select("word", "tag", (F.col("n") / F.col("total")).alias("share"))


def loaded(sentences: DataFrame, user_id: int = 0, at: int = 0) -> DataFrame:
    """What the sentences say, as statements to write with `writes.state`; equal texts are left out."""
    rows = statements(sentences).where("text1 is not null and text2 is not null and text1 <> text2")
    return rows.select(F.lit(user_id).cast("long").alias("user_id"), "relation", "freq", "frame", "text1", "text2", F.lit(1).alias("vote"), F.lit(at).cast("long").alias("at"))
