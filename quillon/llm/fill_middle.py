"""Fill-in-middle: lines of a text become prefix, middle and suffix, cut and reordered by the hash of the document's id.

One automaton reads UTF-8 bytes: its state knows whether a line is open and how much of a control string was just read, or
that one was found whole. A piece of text gives its transition function (the state it ends in from each state it may begin
in) and how many lines begin in it from each. These compose associatively: a scan over the pieces of a text gives each
piece's entry state and the lines before it, whatever the split. The same holds for the CHUNK-sized parts of giant texts,
which are dealt over tasks; only their functions meet again, at most 2 GiB / CHUNK of them a text. A cut after k lines is
then looked for in the one piece where line k + 1 begins. Texts of up to CHUNK bytes never leave the row they were read in.

Null texts count as empty; empty texts and those with a control string stay plain, without cuts. A null id is hashed as an
empty one; repeated rows get the same result; empty tables give no rows. Every column is kept, but one named as an added
column (n_units, form, prefix_chars, middle_chars, output) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, text_slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 256  # bytes that one step function is made of
CHUNK = 1 << 16  # bytes of a giant text in one row


def automaton(controls: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """class of each byte; next state by class and state; whether a line begins by class and state.

    States: (open line?, longest suffix read that begins a control string), the last two of them after a whole one. The last
    class is of no byte and changes nothing.
    """
    words = [c.encode() for c in controls]
    heads = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda h: (len(h), h))
    letters = sorted({b for w in words for b in w} | {10})
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[letters] = np.arange(1, len(letters) + 1)
    states = [(False, b""), *((True, h) for h in heads), (False, None), (True, None)]
    number = {s: i for i, s in enumerate(states)}
    n_classes = len(letters) + 2
    follow = np.tile(np.arange(len(states), dtype=np.uint8), (n_classes, 1))
    begins = np.zeros((n_classes, len(states)), dtype=np.uint8)
    for kind in range(n_classes - 1):
        byte = bytes([letters[kind - 1]]) if kind else None
        for i, (opened, head) in enumerate(states):
            begins[kind, i] = not opened
            read = None if head is None else head + byte if byte else b""
            if read is not None:
                read = None if any(read.endswith(w) for w in words) else next(read[k:] for k in range(len(read) + 1) if read[k:] in heads)
            follow[kind, i] = number[(False, b"" if read is not None else None) if byte == b"\n" else (True, read)]
    return kinds, follow, begins


_KINDS, _FOLLOW, _BEGINS = automaton((PREFIX, SUFFIX, MIDDLE))
STATES = _FOLLOW.shape[1]
_NONE = _FOLLOW.shape[0] - 1  # the class of padding
FOUND = STATES - 2  # from this state on a control string was read


def _pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (byte of the piece by piece), the text of each piece, and the first piece of each text; a text has one at least."""
    sizes = np.diff(ends)
    each = np.maximum(-(-sizes // PIECE), 1)
    first = np.cumsum(each) - each
    owner = np.repeat(np.arange(len(sizes)), each)
    start = ends[owner] + (np.arange(len(owner)) - first[owner]) * PIECE
    at = start[:, None] + np.arange(PIECE)
    inside = at < ends[owner + 1][:, None]
    grid = np.full(at.shape, _NONE, dtype=np.uint8)
    grid[inside] = _KINDS[raw[at[inside]]]
    return np.ascontiguousarray(grid.T), owner, first


def _functions(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's transition function and its counts of lines that begin, by entry state; all pieces step together."""
    state = np.tile(np.arange(STATES, dtype=np.uint8), (grid.shape[1], 1))
    lines = np.zeros(state.shape, dtype=np.int64)
    small = np.zeros(state.shape, dtype=np.uint16)
    for column in grid:
        at = column[:, None] * np.intp(STATES) + state
        small += _BEGINS.ravel()[at]
        state = _FOLLOW.ravel()[at]
    lines += small
    return state, lines


def composed(state: np.ndarray, lines: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive scan by doubling: the function and counts from the first piece of the text (place 0) through each piece."""
    step = 1
    while step <= place.max(initial=0):
        late = np.flatnonzero(place >= step)
        before = state[late - step].astype(np.intp)
        new_state, new_lines = np.take_along_axis(state[late], before, 1), lines[late - step] + np.take_along_axis(lines[late], before, 1)
        state, lines = state.copy(), lines.copy()
        state[late], lines[late] = new_state, new_lines
        step *= 2
    return state, lines


def _begin(grid: np.ndarray, entry: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in its piece (a column of grid), entered in this state, line number rank (from 1) begins."""
    state, seen, out = entry.astype(np.uint8), np.zeros(len(entry), dtype=np.int64), np.full(len(entry), -1)
    for j, column in enumerate(grid):
        at = column * np.intp(STATES) + state
        new = _BEGINS.ravel()[at]
        seen += new
        out[(new == 1) & (seen == rank)] = j
        state = _FOLLOW.ravel()[at]
    return out


class Scan:
    """All texts of a slice, read from entry states (0 where a text begins)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, entry: np.ndarray | None = None):
        self.grid, self.owner, self.first = _pieces(raw, ends)
        self.sizes = np.diff(ends)
        self.place = np.arange(len(self.owner)) - self.first[self.owner]
        self.state, self.lines = composed(*_functions(self.grid), self.place)
        self.last = np.append(self.first[1:], len(self.owner)) - 1
        self.entry = np.zeros(len(self.sizes), dtype=np.intp) if entry is None else entry.astype(np.intp)
        self.n = self.lines[self.last, self.entry]
        self.found = self.state[self.last, self.entry] >= FOUND

    def begins(self, texts: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Bytes of these texts before their line number rank (from 1, a line that they have) begins."""
        own = self.lines[np.arange(len(self.owner)), self.entry[self.owner]]
        total = np.append(0, np.cumsum(self.n))
        piece = np.searchsorted(own + total[self.owner], total[texts] + rank)  # lines so far, rising over all pieces
        inner = self.place[piece] > 0
        start = np.where(inner, self.state[piece - 1, self.entry[texts]], self.entry[texts])
        before = np.where(inner, own[piece - 1], 0)
        return self.place[piece] * PIECE + _begin(self.grid[:, piece], start, rank - before)

    def after(self, k: np.ndarray) -> np.ndarray:
        """Bytes of each text's first k lines."""
        out = np.where(k <= 0, 0, self.sizes)
        inner = np.flatnonzero((k > 0) & (k < self.n))
        out[inner] = self.begins(inner, k[inner] + 1)
        return out


def _numbers(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _sliced(arrays: list[pa.Array]) -> Iterator[list[pa.Array]]:
    batch = pa.RecordBatch.from_arrays(arrays, ["text", *map(str, range(1, len(arrays)))])
    for part in text_slices(iter([batch]), "text"):
        yield part.columns


def _cuts():
    """n, found, and the bytes before both cuts, of whole texts."""

    @F.arrow_udf("struct<n: long, found: boolean, a: long, b: long>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in batches:
            made = []
            for text, h1, h2 in _sliced(list(arrays)):
                scan = Scan(*utf8(text))
                one, two = h1.to_numpy(zero_copy_only=False) % (scan.n + 1), h2.to_numpy(zero_copy_only=False) % (scan.n + 1)
                made.append(pa.StructArray.from_arrays([pa.array(x) for x in (scan.n, scan.found, scan.after(np.minimum(one, two)), scan.after(np.maximum(one, two)))], ["n", "found", "a", "b"]))
            yield pa.concat_arrays(made) if made else pa.array([], pa.struct([("n", pa.int64()), ("found", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())]))

    return run


def _chunk_functions(chunks: DataFrame) -> DataFrame:
    """mark, at, state, lines of chunks (mark, at, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "part"):
            scan = Scan(*utf8(batch.column("part")))
            state, lines = scan.state[scan.last], scan.lines[scan.last]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("at"), pa.array(state.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(lines.tolist(), pa.list_(pa.int64()))], ["mark", "at", "state", "lines"])

    return chunks.mapInArrow(run, "mark string, at int, state array<int>, lines array<long>")


def _resolved(functions: DataFrame) -> DataFrame:
    """mark, n, found, and by chunk its entry state (states) and the lines through it (upto)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mark, parts in zip(batch.column("mark").to_pylist(), batch.column("parts").to_pylist()):
                state, lines = composed(np.array([p["state"] for p in parts], dtype=np.uint8), np.array([p["lines"] for p in parts], dtype=np.int64), np.arange(len(parts)))
                out.append({"mark": mark, "n": int(lines[-1, 0]), "found": bool(state[-1, 0] >= FOUND), "states": [0, *state[:-1, 0].tolist()], "upto": lines[:, 0].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("mark", pa.string()), ("n", pa.int64()), ("found", pa.bool_()), ("states", pa.list_(pa.int32())), ("upto", pa.list_(pa.int64()))]))

    once = functions.groupBy("mark", "at").agg(F.first("state").alias("state"), F.first("lines").alias("lines"))  # copies of a text agree
    parts = once.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("at", "state", "lines"))).alias("parts"))
    return parts.mapInArrow(run, "mark string, n long, found boolean, states array<int>, upto array<long>")


def _giant(rows: DataFrame, chunk: int) -> DataFrame:
    """rows with _cut, as `_cuts` makes it, from _text of more than one chunk, _h1, _h2 and _key."""
    rows = rows.withColumn("_mark", F.sha2(F.col("_text").cast("binary"), 256))
    size = F.octet_length("_text")
    part = lambda i: F.substring(F.col("_text").cast("binary"), i * chunk + 1, F.lit(chunk))
    chunks = rows.select(F.col("_mark").alias("mark"), F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((octet_length(_text) - 1) div {chunk} as int)")), part)).alias("at", "part"))
    table = cut(_resolved(_chunk_functions(chunks.repartition("mark", "at"))))
    asks = cut(rows.groupBy("_name", F.col("_mark").alias("mark")).agg(F.count(F.lit(1)).alias("_m"), F.first("_h1").alias("_h1"), F.first("_h2").alias("_h2")))
    counts = asks.groupBy("mark").agg(F.count(F.lit(1)).alias("_n"))
    asks = join_counted(asks, table.join(counts, "mark"), "mark", "_n")
    first, second = [F.pmod(h, F.col("n") + 1) for h in (F.col("_h1"), F.col("_h2"))]
    found = []
    for name, k in (("a", F.least(first, second)), ("b", F.greatest(first, second))):
        at = F.size(F.filter("upto", lambda x: x <= k))  # noqa: B023  chunks before the one in which line k + 1 begins
        before = F.when(at > 0, F.element_at("upto", F.greatest(at, F.lit(1)))).otherwise(0)
        inner = (k > 0) & (k < F.col("n"))
        found.append(F.struct(inner.alias("inner"), k.alias("k"), at.cast("long").alias("at"), F.try_element_at("states", at + 1).alias("entry"), (k - before).alias("rest")).alias(name))
    asks = asks.select(F.concat("_name", F.lit("/"), "mark").alias("_row"), F.col("_m").alias("_n"), F.struct("n", "found", *found).alias("_ask"))
    rows = join_counted(rows.withColumn("_row", F.concat("_name", F.lit("/"), "_mark")).drop("_mark"), cut(asks), "_row", "_n").drop("_row")

    @F.arrow_udf("long")
    def begin(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in batches:
            made = []
            for text, entry, rest in _sliced([a.fill_null(b"" if i == 0 else 0) for i, a in enumerate(arrays)]):
                scan, out = Scan(*utf8(text), entry=entry.to_numpy(zero_copy_only=False)), np.zeros(len(text), dtype=np.int64)
                asked = np.flatnonzero(scan.sizes)
                out[asked] = scan.begins(asked, rest.to_numpy(zero_copy_only=False)[asked] + 1)
                made.append(pa.array(out))
            yield pa.concat_arrays(made) if made else pa.array([], pa.int64())

    places = []
    for name in ("a", "b"):
        ask = F.col(f"_ask.{name}")
        here = F.when(ask["inner"], F.substring(F.col("_text").cast("binary"), (ask["at"] * chunk + 1).cast("int"), F.lit(chunk))).otherwise(F.lit(b""))
        inside = ask["at"] * chunk + begin(here, F.coalesce(ask["entry"], F.lit(0)), ask["rest"])
        places.append(F.when(ask["inner"], inside).when(ask["k"] <= 0, F.lit(0).cast("long")).otherwise(size.cast("long")).alias(name))
    return rows.withColumn("_cut", F.struct(F.col("_ask.n").alias("n"), F.col("_ask.found").alias("found"), *places)).drop("_ask")


def fill_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_chars, middle_chars and output; rate and spm are per cents."""
    names = [c for c in docs.columns if c not in ("n_units", "form", "prefix_chars", "middle_chars", "output")]
    h = _numbers(F.col(key), seed)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), *[v.alias(f"_h{i}") for i, v in enumerate(h, 1)]
    )
    giant = F.octet_length("_text") > chunk
    short = rows.where(~giant).withColumn("_cut", _cuts()("_text", "_h1", "_h2"))
    rows = rows.where(giant)
    out = short if rows.isEmpty() else short.unionByName(_giant(rows, chunk))
    plain = (F.col("_text") == "") | F.col("_cut.found") | (F.pmod("_h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("_h4", F.lit(100)) < spm, "spm").otherwise("psm")
    part = lambda a, b: F.substring(F.col("_text").cast("binary"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    a, b, end = F.col("_cut.a"), F.col("_cut.b"), F.octet_length("_text").cast("long")
    out = out.withColumn("_form", form).withColumns({"_p": part(F.lit(0).cast("long"), a), "_m": part(a, b), "_s": part(b, end)})
    psm, spm_ = F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m"), F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")
    made = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm_)
    chars = [F.when(F.col("_form") != "plain", F.char_length(c).cast("long")) for c in ("_p", "_m")]
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("_cut.n").alias("n_units"), F.col("_form").alias("form"), chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"), made.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: none of its three parts holds a control string, nor do they make one together."""
    first, second = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.substring_index(rest, SUFFIX, 1), F.substring_index(rest, PREFIX, 1)
    one = F.when(form == "psm", head[0]).otherwise(head[1])
    more = F.substr(rest, F.char_length(one) + len(PREFIX) + 1)
    two = F.substring_index(more, MIDDLE, 1)
    middle = F.substr(more, F.char_length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fim_report(docs: DataFrame) -> DataFrame:
    out = fill_middle(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


FIM_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
n AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o ELSE p || m || s END) AS restored_sha256 FROM o
"""
