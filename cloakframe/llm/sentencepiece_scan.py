"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks.

A byte-pair SentencePiece model segments a text into pieces such that any two
neighbours, merged alone, stay the two pieces they are; one chain of pieces through
the text has that property throughout, and it is the model's own result. So encoding
is a best-path problem: a path takes pieces as steps, a step weighs 0 if it agrees
with the step before and minus infinity if not.

A text is cut into chunks of CHUNK characters, wherever that falls. The state at a cut
is the piece that covers the character before it. Each chunk yields the max-plus matrix
from its entry states to its exit states; matrices are combined associatively, a pass
forward and one backward fix the state at every cut, and each chunk then traces its
pieces back by itself. Inside a chunk, places that no piece crosses (before a space or
a line break) forget the state: what lies before the first and after the last such
place depends on it, and the words between are encoded once each and remembered.

Chunks form parts of PART characters. A text of one part is scanned where it is read.
A giant text is cut into parts in one pass, its parts are spread over tasks, and each
hands on the product of its chunks' matrices. Only these products meet by document;
the states they fix are joined back to the parts, and each part traces in a task of its own.

Defined results: null text is empty and encodes to no pieces; rows repeat as given;
null ids stay null; an empty table gives no rows; extra columns are ignored; very long
texts take time in proportion to their length. A text that holds the model's space mark
U+2581 decodes to a space there, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, map_texts, text_or_empty

MARK = "▁"
#: Characters to a chunk, and to a part; a text of one part is scanned in its own task.
CHUNK, PART = 1024, 65536
#: Texts around a cut are remembered up to this length.
AROUND = 64
UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
NEVER = -np.inf
#: Texts that a model without normalisation leaves as they are, but for space marks.
PROBES = ("ﬁ Ａ  b\t", "é é  x", "  two  ", "Ⅳ½ ①​")


class Pieces:
    """The model's vocabulary as steps of paths."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        normal = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.id = {self.model.id_to_piece(i): i for i in normal}
        self.rank = {p: self.model.get_score(i) for p, i in self.id.items()}
        self.reach = max(map(len, self.id))
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.raw = [of_byte.get(i, self.model.id_to_piece(i).replace(MARK, " ").encode("utf-8")) for i in range(size)]
        self.words, self.alone, self.agree, self.cuts = Remembered(24 << 20), Remembered(4 << 20), Remembered(8 << 20), Remembered(8 << 20)
        # the last chunk without a free place: runs of one character repeat theirs
        self.unbroken: tuple = (None, None)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string by the model's merges: the best neighbours first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_step(self, piece: str) -> bool:
        """Whether a string is a piece that merging makes of it: any single character, and vocabulary."""
        if len(piece) == 1:
            return True
        if piece not in self.id:
            return False
        known = self.alone.get(piece)
        return self.alone.keep(piece, self.merge(piece) == [piece], len(piece)) if known is None else known

    def agrees(self, a: str, b: str) -> bool:
        known = self.agree.get((a, b))
        return self.agree.keep((a, b), self.merge(a + b) == [a, b], len(a) + len(b) + 100) if known is None else known

    def ids(self, piece: str) -> list[int]:
        """A piece's id; a character outside the vocabulary becomes its bytes."""
        known = self.id.get(piece)
        return [known] if known is not None else [self.bytes[b] for b in piece.encode("utf-8")]

    def encode_units(self, texts: list[str]) -> list[bytes]:
        """Ids (int32) of texts that start with a space or a line break and end before one (or at the end)."""
        units = [UNIT.findall(t) for t in texts]
        known = self.words
        found = [list(map(known.get, each)) for each in units]
        new = {u: b"" for each, ids in zip(units, found, strict=True) if None in ids for u, i in zip(each, ids, strict=True) if i is None}
        if new:
            # the library puts a space mark in front, which stands for a unit's own space
            said = [u[1:] if u[0] == " " else u for u in new]
            for u, ids in zip(new, self.model.encode(said, num_threads=1), strict=True):
                if u == " ":
                    ids = [i for p in self.merge(MARK) for i in self.ids(p)]
                new[u] = pack(f"<{len(ids)}i", *ids)[0 if u[0] == " " else 4 :]
            for each, ids in zip(units, found, strict=True):
                if None in ids:
                    ids[:] = [new[u] if i is None else i for u, i in zip(each, ids, strict=True)]
            for u, ids in new.items():
                known.keep(u, ids, len(u) + len(ids))
        return [b"".join(ids) for ids in found]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of ids (int32), space marks as spaces; parts decoded apart can be joined."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    """The vocabulary, kept by a Python worker for the tasks that follow."""
    return Pieces(path)


@lru_cache(maxsize=8)
def checked(path: str) -> int:
    """The reach of a model that this scan can encode with; looked at once, on the driver.

    Refused are models whose pieces cross word starts or line breaks, that normalise
    text, or whose pieces do not come from their merges (user-defined ones among them).
    """
    pieces = Pieces(path)
    crossed = {p[i : i + 2] for p in pieces.id for i in range(len(p) - 1)}
    if any(c[1] == MARK and c[0] != MARK or "\n" in c for c in crossed):
        raise ValueError("pieces of this model cross word starts or line breaks")
    if any(pieces.model.normalize(t) != (" " + t).replace(" ", MARK) for t in PROBES):
        raise ValueError("this model normalises text")
    # after a line break, which no piece crosses, each piece's text is encoded by itself
    inner = [p for p in pieces.id if MARK not in p]
    before = len(pieces.model.encode("\n"))
    alone = [x[before:] for x in pieces.model.encode(["\n" + p for p in inner], num_threads=1)]
    heads = [p for p in pieces.id if p[0] == MARK and p.count(MARK) == 1 and len(p) > 1]
    alone += pieces.model.encode([p[1:] for p in heads], num_threads=1)
    if any([i for x in pieces.merge(p) for i in pieces.ids(x)] != ids for p, ids in zip(inner + heads, alone, strict=True)):
        raise ValueError("a piece of this model is not made by its merges")
    return pieces.reach


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product: the best weight over all middle states."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), NEVER)
    return (a[:, :, None] + b[None]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairing neighbours and scanning the pairs."""
    if len(matrices) == 1:
        return matrices
    pairs = [max_plus(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    inner = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(inner[i // 2] if i % 2 else max_plus(inner[i // 2 - 1], matrices[i]))
    return out


def states_at_cuts(matrices: list[np.ndarray], entry: int = 0, exit_: int = 0) -> list[int]:
    """The state at every cut between a known entry and exit: a pass forward and one backward."""
    if len(matrices) == 1:
        return [entry, exit_]
    forward = [m[0] for m in scan([matrices[0][entry : entry + 1], *matrices[1:]])]
    backward = [m[0] for m in scan([matrices[-1][:, exit_ : exit_ + 1].T, *(m.T for m in matrices[-2::-1])])][::-1]
    at = [entry]
    for f, b in zip(forward[:-1], backward[1:], strict=True):
        both = f + b
        if not len(both) or both.max() == NEVER:
            raise ValueError("no chain of pieces through a text")
        at.append(int(both.argmax()))
    return [*at, exit_]


Node = tuple[int, int]


class Lattice:
    """All agreeing chains from some starting pieces (or one free place) to `stop`.

    A node is a piece (start, end); its mask has a bit for each start that reaches it.
    """

    def __init__(self, pieces: Pieces, text: str, starts: list[Node], stop: int, through: bool) -> None:
        self.pieces, self.text, self.starts = pieces, text, starts
        self.nodes: dict[int, dict[Node, int]] = {}
        self.done: dict[Node, int] = {}
        for i, s in enumerate(starts):
            self.put(s, 1 << i, stop, through)
        at, most = min((s[1] for s in starts), default=stop), len(text) if through else stop
        while at < stop:
            here = [(text[a:b], m) for (a, b), m in self.nodes.get(at, {}).items()]
            for b in range(at + 1, min(at + pieces.reach, most) + 1) if here else ():
                step = text[at:b]
                if pieces.is_step(step):
                    mask = 0
                    for before, m in here:
                        if not before or pieces.agrees(before, step):
                            mask |= m
                    if mask:
                        self.put((at, b), mask, stop, through)
            at += 1

    def put(self, node: Node, mask: int, stop: int, through: bool) -> None:
        # a free place is no piece, so it covers no cut
        if node[1] > stop or node[1] == stop and not (through and node[0] == node[1]):
            if through or node[1] == stop:
                self.done[node] = self.done.get(node, 0) | mask
        if node[1] <= stop:
            at = self.nodes.setdefault(node[1], {})
            at[node] = at.get(node, 0) | mask

    def ids(self, start: int, node: Node) -> bytes:
        """The pieces after a start up to and with a node that it reaches, traced back."""
        chain: list[int] = []
        first, bit = self.starts[start], 1 << start
        while node != first:
            step = self.text[node[0] : node[1]]
            chain[:0] = self.pieces.ids(step)
            node = next(n for n, m in self.nodes[node[0]].items() if m & bit and (n[0] == n[1] or self.pieces.agrees(self.text[n[0] : n[1]], step)))
        return np.array(chain, "<i4").tobytes()


class Part:
    """One part in its surroundings: `text` with the model's leading space, `start` and `end` inside it.

    Texts that the model sees hold marks for spaces; `text` keeps spaces.
    """

    def __init__(self, pieces: Pieces, text: str, start: int, end: int, first: bool, last: bool, chunk: int = CHUNK) -> None:
        self.text, self.pieces, self.chunk = text.replace(MARK, " "), pieces, chunk
        self.start, self.end, self.first, self.last = start, end, first, last
        self.cuts = [*range(start, end, chunk), end] if end > start else [start, end]
        self.chunks = [self.solve(a, b, first and a == start, last and b == end) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def free(self, at: int) -> bool:
        """No piece crosses this place: the text's start, a line break on the right, or a space after something else."""
        t = self.text
        return at == 0 and self.first or t[at] == "\n" or at > 0 and t[at] == " " and t[at - 1] != " "

    def free_after(self, at: int, before: int) -> int | None:
        """The first free place from `at` on, below `before`."""
        t = self.text
        while at < before:
            found = [i for i in (t.find(" ", at, before), t.find("\n", at, before)) if i >= 0]
            if not found:
                return None
            at = min(found)
            if self.free(at):
                return at
            at += 1
        return None

    def free_until(self, at: int, down_to: int) -> int | None:
        """The last free place below `at`, not below `down_to`."""
        t = self.text
        while at > down_to:
            at = max(t.rfind(" ", down_to, at), t.rfind("\n", down_to, at))
            if at < 0:
                return down_to if down_to == 0 and self.first else None
            if self.free(at):
                return at
        return None

    def states(self, cut: int, low: int = 0, high: int | None = None) -> list[Node]:
        """(start, end) of every piece that covers the character before a cut, seen from any part alike.

        `low` and `high` may name free places around the cut, which no piece crosses.
        """
        reach, low = self.pieces.reach, max(low, cut - self.pieces.reach)
        marked = self.text[low : cut + reach if high is None else min(high, cut + reach)].replace(" ", MARK)
        is_step, top = self.pieces.is_step, low + len(marked)
        return [(a, b) for a in range(low, cut) for b in range(cut, min(top, a + reach) + 1) if is_step(marked[a - low : b - low])]

    def remembered(self, side: str, low: int, high: int, cut: int, make) -> tuple:
        """What depends on the text from `low` to `high` and a cut in it only."""
        key = (side, self.text[low:high], cut - low)
        if high - low > AROUND:
            return make()
        known = self.pieces.cuts.get(key)
        if known is None:
            known = make()
            known = self.pieces.cuts.keep(key, known, 8 * (high - low) + sum(len(x or b"") + 50 for x in known))
        return known

    def heads(self, cut: int, until: int) -> tuple[bytes | None, ...]:
        """For every state at a cut, the ids from there to a free place."""
        before = max(0, cut - self.pieces.reach)
        low = self.free_until(cut, before)
        low = before if low is None else low

        def make() -> tuple:
            shift = lambda s: (s[0] - low, s[1] - low)
            starts = [shift(s) for s in self.states(cut, low, until)]
            lattice = Lattice(self.pieces, self.text[low:until].replace(" ", MARK), starts, until - low, False)
            at = {i: n for n, m in lattice.done.items() for i in range(len(starts)) if m >> i & 1}
            return tuple(lattice.ids(i, at[i]) if i in at else None for i in range(len(starts)))

        return self.remembered("head", low, until, cut, make)

    def tails(self, start: int, cut: int) -> tuple[bytes | None, ...]:
        """For every state at a cut, the ids from a free place to that piece."""
        after = min(len(self.text), cut + self.pieces.reach)
        high = self.free_after(cut, after)
        high = after if high is None else high

        def make() -> tuple:
            lattice = Lattice(self.pieces, self.text[start:high].replace(" ", MARK), [(0, 0)], cut - start, True)
            return tuple(lattice.ids(0, n) if (n := (a - start, b - start)) in lattice.done else None for a, b in self.states(cut, start, high))

        return self.remembered("tail", start, high, cut, make)

    def solve(self, a: int, b: int, first: bool, last: bool) -> dict:
        """A chunk's matrix, and its heads (by entry state), body and tails (by exit state) or its lattice.

        With a free place inside, the matrix has rank one; else chains cross the whole chunk.
        """
        head_end = a if first else self.free_after(a, b)
        tail_start = b if last else self.free_until(b, a)
        if last and head_end is None:
            head_end = b
        if head_end is not None and tail_start is not None and head_end <= tail_start:
            heads = (b"",) if first else self.heads(a, head_end)
            tails = (b"",) if last else self.tails(tail_start, b)
            able = np.where([h is None for h in heads], NEVER, 0.0)[:, None] + np.where([t is None for t in tails], NEVER, 0.0)
            return {"weights": able, "heads": heads, "body": (head_end, tail_start), "tails": tails}
        low = max(0, a - self.pieces.reach)
        high = min(len(self.text), b + self.pieces.reach)
        key = (self.text[low:high], a - low, b - low)
        if self.pieces.unbroken[0] != key:
            shift = lambda s: (s[0] - low, s[1] - low)
            starts, ends = [*map(shift, self.states(a))], [*map(shift, self.states(b))]
            lattice = Lattice(self.pieces, self.text[low:high].replace(" ", MARK), starts, b - low, True)
            masks = [lattice.done.get(e, 0) for e in ends]
            able = np.array([[0.0 if m >> i & 1 else NEVER for m in masks] for i in range(len(starts))]).reshape(len(starts), len(ends))
            self.pieces.unbroken = (key, {"weights": able, "lattice": lattice, "ends": ends})
        return self.pieces.unbroken[1]

    def product(self) -> np.ndarray:
        """The matrix of the whole part."""
        return reduce(max_plus, [c["weights"] for c in self.chunks])

    def traced(self, entry: int = 0, exit_: int = 0) -> bytes:
        """The ids (int32) of the pieces after the entry's piece up to and with the exit's, chunk by chunk."""
        at, out = states_at_cuts([c["weights"] for c in self.chunks], entry, exit_), []
        bodies = iter(self.pieces.encode_units([self.text[slice(*c["body"])] for c in self.chunks if "body" in c]))
        for c, i, j in zip(self.chunks, at, at[1:], strict=False):
            out += [c["heads"][i], next(bodies), c["tails"][j]] if "body" in c else [c["lattice"].ids(i, c["ends"][j])]
        return b"".join(out)

    def said(self, entry: int = 0, exit_: int = 0) -> bytes:
        """The text that these pieces stand for, as UTF-8."""
        low = 0 if self.first else self.states(self.start)[entry][1]
        high = len(self.text) if self.last else self.states(self.end)[exit_][1]
        return self.text[low:high].encode("utf-8")


def whole(pieces: Pieces, text: str, chunk: int = CHUNK) -> Part | None:
    """A text of one part; None for the empty text, which has no pieces."""
    return Part(pieces, " " + text, 0, len(text) + 1, True, True, chunk) if text else None


def cut_parts(giant: DataFrame, part: int, reach: int) -> DataFrame:
    """doc, no, parts, lead, body: the parts of giant texts (doc, text) with `reach` characters of both neighbours.

    Each text is cut in one pass; equal texts, told apart by their SHA-256, meet part by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                said = " " + text.as_py()
                n = -(-len(said) // part)
                for no in range(n):
                    start = no * part
                    lead = min(start, reach)
                    body = said[start - lead : start + part + reach]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc": [doc.as_py()],
                            "no": pa.array([no], pa.int32()),
                            "parts": pa.array([n], pa.int32()),
                            "lead": pa.array([lead], pa.int32()),
                            "body": [body],
                        }
                    )

    return giant.mapInArrow(run, "doc string, no int, parts int, lead int, body string").dropDuplicates(["doc", "no"])


def part_of(pieces: Pieces, r, part: int, chunk: int) -> Part:
    last = r.no == r.parts - 1
    return Part(pieces, r.body, r.lead, len(r.body) if last else r.lead + part, r.no == 0, last, chunk)


def part_states(parts: DataFrame, model_path: str, part: int, chunk: int) -> DataFrame:
    """doc, no, entry, exit: the state at both ends of every part; only matrices (one byte a weight) meet by document."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model_path)
        for b in batches:
            out = []
            for r in b.itertuples():
                weights = part_of(pieces, r, part, chunk).product()
                out.append({"doc": r.doc, "no": r.no, "rows": len(weights), "able": (weights == 0).astype(np.uint8).tobytes()})
            if out:
                yield pd.DataFrame(out)

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        able = [np.frombuffer(x, np.uint8).reshape(n, -1) for x, n in zip(group["able"], group["rows"], strict=True)]
        at = states_at_cuts([np.where(x, 0.0, NEVER) for x in able])
        return pd.DataFrame({"doc": group["doc"], "no": group["no"], "entry": at[:-1], "exit": at[1:]})

    solved = parts.mapInPandas(solve, "doc string, no int, rows int, able binary")
    return solved.groupBy("doc").applyInPandas(combine, "doc string, no int, entry int, exit int")


def traced_parts(giant: DataFrame, model_path: str, part: int, chunk: int, make, fields: str) -> DataFrame:
    """doc, no, parts and what `make` derives from (pieces, part, entry, exit) for every part of giant texts (doc, text)."""
    parts = cut_parts(giant, part, checked(model_path))
    known = part_states(parts, model_path, part, chunk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model_path)
        for b in batches:
            rows = []
            for r in b.itertuples():
                rows.append((r.doc, r.no, r.parts, *make(pieces, part_of(pieces, r, part, chunk), r.entry, r.exit)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "no", "parts", *[f.split()[0] for f in fields.split(", ")]])

    return parts.join(known, ["doc", "no"]).mapInPandas(run, f"doc string, no int, parts int, {fields}")


def sides(df: DataFrame, id_col: str, text_col: str, part: int, chunk: int, model_path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one part (as they are), and giant rows (id, doc, text)."""
    if not 0 < checked(model_path) <= chunk <= part or part % chunk:
        raise ValueError(f"a chunk needs {checked(model_path)} characters at least, and a part whole chunks")
    text = text_or_empty(text_col)
    size = F.length(text) + 1
    giant = df.where(size > part).select(F.col(id_col).alias("id"), text.alias("text")).withColumn("doc", F.sha2("text", 256))
    return df.where(size <= part), giant


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """id, part, parts, ids (binary int32, little-endian): the pieces of every row, part by part in order.

    Rows of up to one part have one. Equal giant texts are encoded once, repeated rows stay.
    """
    small, giant = sides(df, id_col, text_col, part, chunk, model_path)

    def make():
        pieces = loaded(model_path)
        return lambda t: (p.traced() if (p := whole(pieces, t, chunk)) else b"",)

    few = map_texts(small, id_col, text_col, make, "ids binary").select(id_col, F.lit(0).alias("part"), F.lit(1).alias("parts"), "ids")
    found = traced_parts(
        giant.select("doc", "text"), model_path, part, chunk, lambda pieces, p, entry, exit_: (p.traced(entry, exit_),), "ids binary"
    )
    large = giant.select("id", "doc").join(found, "doc").select(F.col("id").alias(id_col), F.col("no").alias("part"), "parts", "ids")
    return few.unionByName(large)


def decode(parts: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, part, parts, raw: the UTF-8 bytes of each part, its leading space dropped in part 0."""
    rows = parts.select(F.col(id_col).alias("id"), "part", "parts", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model_path)
        for b in batches:
            raw = [pieces.decode_bytes(x) for x in b["ids"]]
            raw = [r[1:] if p == 0 else r for r, p in zip(raw, b["part"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "part": b["part"], "parts": b["parts"], "raw": raw})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, part int, parts int, raw binary").withColumnRenamed("id", id_col)


def digests(pieces: Pieces, p: Part | None, entry: int = 0, exit_: int = 0) -> tuple[int, str, str, bool]:
    """n_tokens, ids_sha256, decoded_sha256, round_trip of a part, decoded again; None is the empty text."""
    ids = p.traced(entry, exit_) if p else b""
    # the model's leading space is no part of the text
    lead = 1 if p and p.first else 0
    raw = pieces.decode_bytes(ids)[lead:]
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == (p.said(entry, exit_)[lead:] if p else b"")


def piece_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """id, parts, chunks, n_tokens, ids_sha256, decoded_sha256, round_trip for every row.

    ids_sha256 and decoded_sha256 are digests of the digests of the row's parts in order (hexadecimal,
    comma-joined), so that no task holds a giant text's pieces; a part's are over its ids as int32,
    little-endian, and over its decoded text. A row of one part has a digest of one digest.
    round_trip says whether the decoded text is the text (U+2581 read as a space).
    """
    small, giant = sides(df, id_col, text_col, part, chunk, model_path)
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def make():
        pieces = loaded(model_path)

        def one(t: str) -> tuple:
            p = whole(pieces, t, chunk)
            n, ids, decoded, same = digests(pieces, p)
            return (len(p.chunks) if p else 0, n, *(hashlib.sha256(d.encode()).hexdigest() for d in (ids, decoded)), same)

        return one

    few = map_texts(small, id_col, text_col, make, f"chunks bigint, {fields}").withColumn("parts", F.lit(1))
    found = traced_parts(giant.select("doc", "text"), model_path, part, chunk, digests, fields)
    in_order = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", F.col(c).alias("v")))), lambda x: x["v"]), ","), 256).alias(c)
    by_doc = found.groupBy("doc").agg(
        F.first("parts").alias("parts"),
        F.sum("n_tokens").alias("n_tokens"),
        in_order("ids_sha256"),
        in_order("decoded_sha256"),
        F.bool_and("round_trip").alias("round_trip"),
    )
    rows = giant.select("id", "doc", F.ceil((F.length("text") + 1) / chunk).alias("chunks"))
    columns = [id_col, "parts", "chunks", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    return few.select(*columns).unionByName(rows.join(by_doc, "doc").withColumnRenamed("id", id_col).select(*columns))
