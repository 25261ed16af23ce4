"""Fill-in-middle transformation by a parallel automaton scan.

A token is white space with the word behind it, or the white space that ends a text. One
automaton over bytes finds where tokens end and whether a sentinel (`<P>`, `<S>`, `<M>`) stands
in the text. Its states: in white space (also the start), in a word, in a word after `<`, and
after `<P`, `<S` or `<M`. As its signs are ASCII, bytes give what code points would.

A chunk of bytes doesn't know the state it is entered in, so it gives for each entry state the
exit state and the counts of ended tokens and of sentinels. These functions compose
associatively: (f, c) then (g, d) is s -> g(f(s)), c(s) + d(f(s)). The prefix composition gives
every chunk's entry state and the tokens before it, and so the chunk that holds a wanted cut; only
that one is looked at again.

Texts of up to GIANT bytes are scanned chunk by chunk in the task that holds them. The chunks of
larger ones are dealt out over the cluster (a table in the shared folder): tasks give
their functions, a group of a document's functions (at most 2 GB / CHUNK rows) is composed, and the
chunks that hold cuts are found by a join. Chunks may split a code point; lead bytes are counted.

Defined cases: a null text is empty, and an empty text is plain; a null doc_id draws as the
empty string would; repeated rows are transformed each; other columns of the documents
stay out. Any bytes that aren't white space are parts of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import text as tx

CHUNK, GIANT = 1 << 18, 8 << 20
SEED, RATE, SPM = 42, 50, 80
SPACE, WORD, OPEN, NAMED = range(4)
MARKS = (b"<P>", b"<S>", b"<M>")
_SPACE_BYTES = (0x20, *range(0x09, 0x0E))


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next states, token ends and sentinels by state and byte."""
    after, ends, marks = np.full((4, 256), WORD, np.uint8), np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    after[:, ord("<")] = OPEN
    after[OPEN, [ord(c) for c in "PSM"]] = NAMED
    after[:, _SPACE_BYTES] = SPACE
    ends[WORD:, _SPACE_BYTES] = 1
    marks[NAMED, ord(">")] = 1
    return after, ends, marks


AFTER, ENDS, SENTINELS = _automaton()
_IS_SPACE = AFTER[WORD] == SPACE
_LEADS = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Step:
    """What a chunk does, by entry state: exit state, tokens that end in it, sentinels that end in it."""

    exit: np.ndarray
    tokens: np.ndarray
    marks: np.ndarray

    def then(self, other: Step) -> Step:
        return Step(other.exit[self.exit], self.tokens + other.tokens[self.exit], self.marks + other.marks[self.exit])


NOTHING = Step(np.arange(4), np.zeros(4, np.int64), np.zeros(4, np.int64))


def scan(chunk: bytes) -> Step:
    """The chunk's function: byte by byte until all entry states have met, then as arrays."""
    step, at = NOTHING, 0
    while at < len(chunk) and (step.exit != step.exit[0]).any():
        b = chunk[at]
        step = step.then(Step(AFTER[:, b], ENDS[:, b], SENTINELS[:, b]))
        at += 1
    if at == len(chunk):
        return step
    begin = at - 2 if at >= 2 else 0  # sentinels that end behind `at`; those before are counted
    marks = sum(chunk.count(m, begin) for m in MARKS) - sum(chunk.count(m, begin, at) for m in MARKS)
    space = _IS_SPACE[np.frombuffer(chunk, np.uint8)[at:]]
    tokens = int(np.count_nonzero(space[1:] & ~space[:-1])) + int(space[0] and step.exit[0] != SPACE)
    state = SPACE
    for b in chunk[-2:]:
        state = AFTER[state, b]
    if len(chunk) - at < 2:
        state = AFTER[step.exit[0], chunk[at]]
    return Step(np.full(4, state), step.tokens + tokens, step.marks + marks)


def end_of(chunk: bytes, state: int, nth: int) -> tuple[int, int]:
    """Bytes and lead bytes of the chunk before the end of its nth token, when entered in `state`."""
    raw = np.frombuffer(chunk, np.uint8)
    space = _IS_SPACE[raw]
    ends = space & ~np.concatenate(([state == SPACE], space[:-1]))
    at = int(np.flatnonzero(ends)[nth - 1])
    return at, int(np.count_nonzero(_LEADS[raw[:at]]))


def chunks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def plan(doc_id: object, tokens: int, marks: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form and the two cuts in tokens, the smaller first."""
    h1, h2, h3, h4 = draws(doc_id)
    a, b = sorted((h1 % (tokens + 1), h2 % (tokens + 1)))
    plain = not tokens or marks or h3 % 100 >= rate
    return "plain" if plain else "spm" if h4 % 100 < spm else "psm", a, b


def shaped(text: bytes, form: str, a: int, b: int) -> bytes:
    """The output for cuts at bytes a and b."""
    if form == "plain":
        return text
    p, m, s = text[:a], text[a:b], text[b:]
    return b"<P>%b<S>%b<M>%b" % (p, s, m) if form == "psm" else b"<S>%b<P>%b<M>%b" % (s, p, m)


def restored(output: Column, form: Column) -> Column:
    """The text again: what stands behind the three sentinels, in the text's order."""
    part = F.split(output, "<[PSM]>", 4)  # parts of a text that has sentinels aren't cut
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _composed(steps: list[Step]) -> list[Step]:
    """The function of all chunks before each, and of all."""
    out = [NOTHING]
    for s in steps:
        out.append(out[-1].then(s))
    return out


def transformed(doc_id: object, text: bytes, rate: int, spm: int, size: int) -> tuple:
    """One text in one task, chunk by chunk."""
    parts = chunks(text, size)
    before = _composed([scan(p) for p in parts])
    tokens = int(before[-1].tokens[SPACE]) + bool(text)
    form, a, b = plan(doc_id, tokens, int(before[-1].marks[SPACE]), rate, spm)
    if form == "plain":
        return doc_id, tokens, form, None, None, text
    reached = np.array([s.tokens[SPACE] for s in before])
    places = []
    for unit in (a, b):
        if unit in (0, tokens):
            places.append((0, 0) if not unit else (len(text), int(np.count_nonzero(_LEADS[np.frombuffer(text, np.uint8)]))))
            continue
        i = int(np.searchsorted(reached, unit)) - 1  # the chunk in which the unit ends
        at, leads = end_of(parts[i], int(before[i].exit[SPACE]), unit - int(reached[i]))
        places.append((i * size + at, int(np.count_nonzero(_LEADS[np.frombuffer(text[: i * size], np.uint8)])) + leads))
    (i, x), (j, y) = places
    return doc_id, tokens, form, x, y - x, shaped(text, form, i, j)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, form, prefix, middle, out = zip(*rows)
    whole = lambda x: pa.array(x, pa.int64())
    return pa.record_batch([whole(ids), whole(n), pa.array(form, pa.string()), whole(prefix), whole(middle), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _in_place(docs: DataFrame, rate: int, spm: int, size: int) -> DataFrame:
    def run(batches):
        for batch in tx.slices(batches, "text"):
            yield _table([transformed(i, t or b"", rate, spm, size) for i, t in zip(batch.column(0).to_pylist(), tx.byte_texts(batch.column(1)))])

    return docs.mapInArrow(run, _OUT)


_STEP = "key string, doc_id long, i int, leads long, exits array<int>, tokens array<long>, marks array<long>"
_CUT = "key string, n long, form string, side int, i int, state int, nth long, bytes_before long, leads_before long"


def _steps(parts: DataFrame) -> DataFrame:
    """The function of every chunk, wherever it lies."""

    def run(batches):
        for batch in batches:
            for k, d, i, c in zip(*(col.to_pylist() for col in batch.columns)):
                s = scan(c)
                lead = int(np.count_nonzero(_LEADS[np.frombuffer(c, np.uint8)]))
                yield pa.record_batch([pa.array([k]), pa.array([d], pa.int64()), pa.array([i], pa.int32()), pa.array([lead]), pa.array([s.exit.tolist()], pa.list_(pa.int32())), pa.array([s.tokens.tolist()]), pa.array([s.marks.tolist()])], names=["key", "doc_id", "i", "leads", "exits", "tokens", "marks"])

    return parts.mapInArrow(run, _STEP)


def _cuts(steps: DataFrame, rate: int, spm: int, size: int) -> DataFrame:
    """Two rows a text: the chunk that holds the cut, the state it is entered in and which token end of it is meant.

    A cut at the begin or the end has no chunk (i = -1) and its place already."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        before = _composed([Step(np.array(r["exits"]), np.array(r["tokens"]), np.array(r["marks"])) for r in rows])
        tokens = int(before[-1].tokens[SPACE]) + 1
        form, a, b = plan(rows[0]["doc_id"], tokens, int(before[-1].marks[SPACE]), rate, spm)
        reached, leads = np.array([s.tokens[SPACE] for s in before]), np.concatenate(([0], np.cumsum([r["leads"] for r in rows])))
        out = []
        for side, unit in enumerate((a, b)):
            if unit in (0, tokens):  # only the place in code points matters; bytes follow from it
                i, state, nth, at, lead = -1, 0, 0, 0 if not unit else -1, int(leads[-1]) if unit else 0
            else:
                i = int(np.searchsorted(reached, unit)) - 1
                state, nth, at, lead = int(before[i].exit[SPACE]), unit - int(reached[i]), i * size, int(leads[i])
            out.append((rows[0]["key"], tokens, form, side, i, state, nth, at, lead))
        names = [c.split()[0] for c in _CUT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return steps.groupBy("key").applyInArrow(run, _CUT)


def _places(cuts: DataFrame, parts: DataFrame) -> DataFrame:
    """key, n, form and both cuts' places in bytes (-1: the end) and code points; only chunks with cuts are read."""

    def run(batches):
        for batch in batches:
            rows = [(r, end_of(r["chunk"], r["state"], r["nth"])) for r in batch.to_pylist()]
            if rows:
                yield pa.record_batch(
                    [pa.array([r["key"] for r, _ in rows]), pa.array([r["side"] for r, _ in rows], pa.int32()), pa.array([r["bytes_before"] + x for r, (x, _) in rows]), pa.array([r["leads_before"] + y for r, (_, y) in rows])],
                    names=["key", "side", "at", "chars"],
                )

    inside = cuts.where("i >= 0").join(parts.select("key", "i", "chunk"), ["key", "i"]).select("key", "side", "state", "nth", "bytes_before", "leads_before", "chunk")
    found = inside.mapInArrow(run, "key string, side int, at long, chars long")
    found = found.unionByName(cuts.where("i < 0").select("key", "side", F.col("bytes_before").alias("at"), F.col("leads_before").alias("chars")))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}")
    both = found.groupBy("key").agg(*(pick(c, s) for c in ("at", "chars") for s in (0, 1)))
    return both.join(cuts.where("side = 0").select("key", "n", "form"), "key")


def _dealt_out(docs: DataFrame, rate: int, spm: int, size: int) -> DataFrame:
    """The same for giant texts: their chunks are dealt out over the cluster.

    A text is known by a digest of its id and itself, so equal rows share one scan."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")), 256)
    keyed = docs.withColumn("key", key)

    def split(batches):
        for batch in tx.slices(batches, "text"):
            for k, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tx.byte_texts(batch.column(2))):
                for i, c in enumerate(chunks(t, size)):
                    yield pa.record_batch([pa.array([k]), pa.array([d], pa.int64()), pa.array([i], pa.int32()), pa.array([c], pa.binary())], names=["key", "doc_id", "i", "chunk"])

    parts = keyed.select("key", "doc_id", "text").mapInArrow(split, "key string, doc_id long, i int, chunk binary").dropDuplicates(["key", "i"])
    parts = shared.written(parts, "chunks")
    cuts = shared.written(_cuts(_steps(parts), rate, spm, size), "cuts")

    def shape(batches):
        for batch in tx.slices(batches, "text"):
            rows = []
            for r, text in zip(batch.drop_columns(["text"]).to_pylist(), tx.byte_texts(batch.column(batch.schema.get_field_index("text")))):
                plain = r["form"] == "plain"
                a, b = (len(text) if x < 0 else x for x in (r["at0"], r["at1"]))
                rows.append((r["doc_id"], r["n"], r["form"], None if plain else r["chars0"], None if plain else r["chars1"] - r["chars0"], shaped(text, r["form"], a, b)))
            yield _table(rows)

    return keyed.join(_places(cuts, parts), "key").drop("key").mapInArrow(shape, _OUT)


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, size: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and the output of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > giant
    out = _in_place(rows.where(~large), rate, spm, size)
    if rows.where(large).limit(1).count():
        out = out.unionByName(_dealt_out(rows.where(large), rate, spm, size))
    return out


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the digests of every document's output and of the text rebuilt from it."""
    out = transform(tx.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
x AS (
  SELECT doc_id, text, t, len(t) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(t) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
y AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:n], '') AS s FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM y
"""
