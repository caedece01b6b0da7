"""Byte-level BPE encoding and decoding.

Encoding compiles the merges into a finite-state transducer that reads bytes
and writes token ids.  By the pair property of rank-ordered BPE a token
sequence is the encoding of its bytes exactly if every adjacent pair is the
encoding of that pair's bytes, so each prefix of a piece has one encoding, and
its last token follows from the encodings of shorter prefixes.  A state holds
the places that a longer token may still start from, each with the token that
ends there.  Tokens before the last boundary common to all of these places
can't change any more, so the lookahead is bounded by a few token lengths.
States and transitions are made on first use (lazy determinisation) and
forgotten when there are too many; all of them, and the remembered pieces, are
bounded in number and belong to one task.

A null or empty text has no ids; repeated rows and ids are encoded each by
itself; texts may have any length (a piece of many bytes is streamed).

Decoding joins token bytes and passes them through an incremental UTF-8 state
machine that holds back an unfinished character until its rest arrives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lean import lean
from ._words import with_fields


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_NEVER = 1 << 60


class Transducer:
    """The lazily determinised transducer for one rank table."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        # The tokens' trie: children by node << 8 | byte; of each node the token that it is, its depth, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token_at, self.depth, self.inner = [-1], [0], [True]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.depth)
                    self.inner[node] = True
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = to
            self.token_at[node] = i
        # A place in a state: the node of the bytes since then << wide | the token that ends there + 1.
        self.wide = (max(ranks.values(), default=0) + 2).bit_length()
        self.fits: dict[int, bool] = {}
        self.grown: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None] = {}
        self.most_states = most_states
        self.reset((0,))

    def reset(self, state: tuple[int, ...]) -> None:
        """Forgets all states but this one, which becomes number 0."""
        self.ids = {state: 0}
        self.states = [state]
        self.moves: dict[int, tuple[int, int]] = {}  # by state << 8 | byte

    def merge(self, piece: bytes) -> list[int]:
        """Plain rank-ordered merging: what the transducer must agree with."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """What stands first and last while the token is merged, each with the rank of the merge that ends it; None if merging doesn't give the token."""
        hit = self.grown.get(token, self)
        if hit is not self:
            return hit
        parts = [self.tokens[token][i : i + 1] for i in range(self.size[token])]
        first, last = [], []
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)))
            if rank == _NEVER:
                break
            if at == 0:
                first.append((parts[0], rank))
            if at == len(parts) - 2:
                last.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        whole = parts[0], _NEVER
        hit = self.grown[token] = ([*first, whole], [*last, whole]) if len(parts) == 1 else None
        return hit

    def pair(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a is -1 at the start.

        Merging both side by side gives other tokens exactly if a merge over
        their border has its turn while both of its sides stand there.
        """
        ok = self.fits.get((a + 1) << self.wide | b)
        if ok is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            right, left = self.spines(b), self.spines(a) if a >= 0 else None
            ok = right is not None and (a < 0 or left is not None and self._apart(left[1], right[0]))
            self.fits[(a + 1) << self.wide | b] = ok
        return ok

    def _apart(self, before: list[tuple[bytes, int]], after: list[tuple[bytes, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = before[i], after[j]
            rank = self.ranks.get(x + y, _NEVER)
            # Of merges of one rank the leftmost comes first.
            if rank < x_ends and rank <= y_ends and rank != _NEVER:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def number(self, key: tuple[int, ...]) -> int:
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, the token that ends with this byte in the encoding of the piece so far)."""
        best, new, wide, child, token_at, inner, fits = -1, [], self.wide, self.child, self.token_at, self.inner, self.fits
        for place in self.states[state]:
            node = child.get(place >> wide << 8 | byte)
            if node is None:
                continue
            last = place & (1 << wide) - 1
            if best < 0 and (token := token_at[node]) >= 0:
                ok = fits.get(last << wide | token)
                if self.pair(last - 1, token) if ok is None else ok:
                    best = token
            if inner[node]:
                new.append(node << wide | last)
        if best < 0:
            raise ValueError("the rank table lacks single bytes")
        hit = self.moves[state << 8 | byte] = self.number((*new, best + 1)), best
        return hit

    def stream(self, data: bytes, every: int = 4096) -> Iterator[int]:
        """Token ids of one piece's bytes; what all open prefixes agree on is written every few thousand bytes."""
        moves, size = self.moves, self.size
        state, ends = self.number((0,)), []
        for byte in data:
            hit = moves.get(state << 8 | byte) or self.step(state, byte)
            state = hit[0]
            ends.append(hit[1])
            if len(ends) >= every or len(self.states) > self.most_states:
                open_ends = {len(ends) - self.depth[place >> self.wide] for place in self.states[state]}
                yield from self._settle(ends, open_ends)
                if len(self.states) > self.most_states:
                    self.reset(self.states[state])
                    moves, state = self.moves, 0
        n, out = len(ends), []
        while n:
            out.append(ends[n - 1])
            n -= size[ends[n - 1]]
        yield from reversed(out)

    def _settle(self, ends: list[int], open_ends: set[int]) -> list[int]:
        """Cuts the part before the last boundary that every open prefix's encoding has, and returns its tokens."""
        marks = [*open_ends]
        while len({*marks}) > 1:  # walk the longest back until all meet
            k = marks.index(max(marks))
            marks[k] -= self.size[ends[marks[k] - 1]]
        n, out = marks[0], []
        cut = n
        while n:
            out.append(ends[n - 1])
            n -= self.size[ends[n - 1]]
        del ends[:cut]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 4096 or len(self.states) > self.most_states:
            return tuple(self.stream(piece))
        get, step, state, ends = self.moves.get, self.step, self.number((0,)), []
        add = ends.append
        for byte in piece:
            state, token = get(state << 8 | byte) or step(state, byte)
            add(token)
        size, n, out = self.size, len(piece), []
        while n:
            token = ends[n - 1]
            out.append(token)
            n -= size[token]
        return tuple(out[::-1])


def compile_pattern(pattern: str):
    """The pattern with blanks as Unicode's White_Space, as the rank files' own library reads it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def ascii_pattern(pattern: str):
    """What compile_pattern(pattern) finds in texts of ASCII alone, by the standard library's faster engine; None where that can't say it."""
    import re

    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        wide = next((x for x in (r"\p{L}", r"\p{N}") if pattern.startswith(x, i)), None)
        if wide:
            some = "A-Za-z" if wide == r"\p{L}" else "0-9"
            out.append(some if inside else f"[{some}]")
            i += len(wide)
            continue
        if c == "\\":
            if pattern[i + 1 : i + 2] not in ("s", "S", "r", "n"):
                return None
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "(" and not pattern.startswith(("(?!", "(?:"), i):
            return None
        if inside and c in "[&|~-":  # the other engine may mean sets by them
            return None
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return re.compile("".join(out), re.ASCII)


class Encoder:
    """Encodes whole texts; remembers the ids of short pieces; when there are too many, those not met again since are forgotten."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 300_000):
        self.fst = Transducer(ranks)
        self.wide = compile_pattern(pattern).findall
        plain = ascii_pattern(pattern)
        self.plain = plain.findall if plain else self.wide
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.most = most_pieces * 2 // 3  # in each half

    def split(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() else self.wide(text)

    def _new(self, piece: str) -> str:
        found = self.older.get(piece) or " ".join(map(str, self.fst.encode_piece(piece.encode("utf-8"))))
        if len(piece) <= 48:
            if len(self.known) >= self.most:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def decimal(self, text: str) -> str:
        """The decimal ids of the text, joined by one blank."""
        get, new, out = self.known.get, self._new, []
        pieces = self.split(text)
        for k in range(0, len(pieces), 4096):
            out += [get(p) or new(p) for p in pieces[k : k + 4096]]
            get = self.known.get
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.decimal(text).split())]


#: For a lead byte: bytes of the character, and the allowed range of the second byte.
def _lead(b: int) -> tuple[int, int, int]:
    if 0xC2 <= b <= 0xDF:
        return 2, 0x80, 0xBF
    if 0xE0 <= b <= 0xEF:
        return 3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
    if 0xF0 <= b <= 0xF4:
        return 4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
    return 1, 0, 0


class Utf8Machine:
    """Incremental UTF-8: gives the finished part of what was fed, keeps an unfinished character."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes) -> bytes:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                size, low, high = _lead(b)
                if size > back and (back == 1 or low <= data[1 - back] <= high):
                    cut -= back
                break
        self.rest = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        rest, self.rest = self.rest, b""
        return rest


class Decoder:
    """Streaming decoder: text as ids arrive; ill-formed bytes become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.table: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.table[i] = token
        self.decimal = {str(i): token for token, i in ranks.items()}
        self.machine = Utf8Machine()

    def feed_decimal(self, ids: list[str]) -> bytes:
        """feed_bytes() of decimal ids, which needn't become numbers first."""
        return self.machine.feed(b"".join(map(self.decimal.__getitem__, ids)))

    def feed_bytes(self, ids: Iterable[int]) -> bytes:
        table = self.table
        return self.machine.feed(b"".join([table[i] for i in ids]))

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def finish(self) -> str:
        return self.machine.finish().decode("utf-8", "replace")


def _ranks(df: DataFrame, rank_file: str):
    """The rank file's bytes, sent to every executor; a vocabulary's size doesn't depend on the data."""
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the column `out`: token ids of the whole text.

    A null or empty text has no ids.  A narrow operation: rows, order and other
    columns (but one named `out`, which is replaced) stay as they are.
    """
    raw = _ranks(df, rank_file)
    df = df.drop(out)
    at = df.columns.index(text)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load_ranks(raw.value), pattern)
        for batch in rows:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = pa.array([enc.encode(t.as_py() or "") for t in part.column(at)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out])

    return df.mapInArrow(run, with_fields(df, **{out: "array<int>"}))


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the column `out`: the text of the ids (null or no ids: empty)."""
    raw = _ranks(df, rank_file)
    df = df.drop(out)
    at = df.columns.index(ids)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(load_ranks(raw.value))
        for batch in rows:
            for k in range(0, batch.num_rows, 256):
                part, texts = batch.slice(k, 256), []
                for row in part.column(at):
                    row = row.as_py() or []
                    texts.append("".join([*(dec.feed(row[i : i + 65536]) for i in range(0, len(row), 65536)), dec.finish()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return df.mapInArrow(run, with_fields(df, **{out: "string"}))


def digest(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every whole text, without moving the ids out of the task.

    ids_sha256 is of the decimal ids joined by one space; decoded_sha256 is of
    the bytes that the streaming decoder gives for these ids.  A null or empty
    text has no tokens.  A narrow operation without any shuffle.
    """
    raw = _ranks(df, rank_file)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(raw.value)
        enc, dec = Encoder(ranks, pattern), Decoder(ranks)
        for batch in rows:
            n, of_ids, of_text = [], [], []
            for value in batch.column(1):
                decimal = enc.decimal(value.as_py() or "")
                ids = decimal.split()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(decimal.encode()).hexdigest())
                sha = hashlib.sha256()
                for i in range(0, len(ids), 65536):
                    sha.update(dec.feed_decimal(ids[i : i + 65536]))
                sha.update(dec.machine.finish())
                of_text.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([df.schema[key]]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return df.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
