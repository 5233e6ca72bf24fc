"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when every two
neighbours are compatible, that is when no merge across their border would have
come before the merges that built them. So encoding is a walk through a
nondeterministic transducer: its configurations are the token written last and a
place in the trie of all tokens, and a token may be written where it is compatible
with the one before. Sets of configurations are made into states of a
deterministic machine only when an input reaches them. Tokens on which all
configurations agree are emitted, so output lags the input by a block and the
lengths of two longest tokens or so.

Decoding streams: an incremental UTF-8 machine, composed over whole tokens, tells
after which token the bytes end on a character.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts, only_tables_of, worker_table
from fathomline.shipping import ship

ROOT = 0
NONE = -1
PLACE = (1 << 24) - 1
#: What a worker keeps of states, steps of configurations (and tokens that stand for others), pair verdicts, pieces and chunks, and the longest of the latter; a full table is emptied and refilled.
MOST_STATES, MOST_STEPS, MOST_VERDICTS, MOST_PIECES, LONGEST_KEPT = 150_000, 300_000, 50_000, 200_000, 40
#: At places of the trie with at most so many tokens below, configurations are told apart only by which of these fit.
FEW = 16
#: Bytes read between two looks at what can be emitted.
BLOCK = 256
#: A step is one integer: the next configuration above, the token written plus one in so many bits below.
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class Transducer:
    """Compiled merges; ``encode`` maps the bytes of one piece to token ids.

    A configuration is the token before the one that is being read and a place in
    the trie, packed into one integer (token + 1, then 24 bits of place). Tokens
    before that allow the same few tokens below a place are alike there: the first
    one met stands for all, and a place that none of the tokens below fits is dropped.
    A state is a dictionary: of each byte read so far the token written and the next
    state, and at NONE the tuple of configurations, newest last. Reading a byte writes
    the one token that ends there in the encoding of the bytes so far.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(x) for x in self.bytes_of]
        self.longest = max(self.length, default=0)
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [NONE]
        below: list[list[int]] = [[]]
        for token, rank in ranks.items():
            at, path = ROOT, []
            for b in token:
                to = self.children[at].get(b)
                if to is None:
                    to = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(NONE)
                    below.append([])
                path.append(at)
                at = to
            self.token_at[at] = rank
            for at in path:
                if len(below[at]) <= FEW:
                    below[at].append(rank)
        #: Tokens that go on below a place of the trie; None where there are more than FEW.
        self.below = [tuple(x) if len(x) <= FEW else None for x in below]
        #: The token, plus one, that stands for all that fit the same few tokens below a place.
        self.alike: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.verdicts: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.states: dict[tuple, dict] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # they refer to each other
            state.clear()
        self.states.clear()
        self.start = self._state((ROOT,))

    def _state(self, configs: tuple) -> dict:
        state = self.states.get(configs)
        if state is None:
            state = self.states[configs] = {NONE: configs}
        return state

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None for a byte."""
        if token not in self.halves:
            raw = self.bytes_of[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=(NONE, NONE))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes gives just these two tokens.

        Undo the merges of both sides from the latest back; a pair that touches the
        border at some moment and has a merge before the next merge of either side
        would have been joined.
        """
        key = left << 32 | right
        known = self.verdicts.get(key)
        if known is None:
            if len(self.verdicts) > MOST_VERDICTS:
                self.verdicts.clear()
            known = self.verdicts[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        before = 1 << 62  # merges of this rank or above come later than the moment looked at; of equal ranks the left goes first
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def _step(self, config: int, byte: int) -> int:
        """One configuration's part of a move: the configuration after it (0: none) above, the token written plus one (0: none) below."""
        to = self.children[config & PLACE].get(byte)
        if to is None:
            return 0
        last, token, after = (config >> 24) - 1, self.token_at[to], 0
        if token >= 0 and last >= 0 and not self.compatible(last, token):
            token = NONE
        if self.children[to]:
            few = self.below[to]
            if last < 0 or few is None:
                after = last + 1 << 24 | to
            else:
                fit = 0
                for x in few:
                    fit = fit << 1 | self.compatible(last, x)
                if fit:
                    if len(self.alike) > MOST_STEPS:
                        self.alike.clear()
                    after = self.alike.setdefault(fit << 24 | to, last + 1) << 24 | to
        return after << TOKEN_BITS | token + 1

    def _move(self, state: dict, byte: int) -> tuple[int, dict]:
        """Make the missing move of a state: the token written and the state after it."""
        configs, after, written, steps = state[NONE], [], 0, self.steps
        for config in configs:
            step = steps.get(config << 8 | byte)
            if step is None:
                if len(steps) > MOST_STEPS:
                    steps.clear()
                step = steps[config << 8 | byte] = self._step(config, byte)
            if step:
                if not written:
                    written = step & TOKEN
                if step > TOKEN:
                    after.append(step >> TOKEN_BITS)
        if not written:
            raise ValueError("the vocabulary lacks a byte")
        after.append(written << 24 | ROOT)
        if len(self.states) > MOST_STATES:
            self._reset()
            state = self._state(configs)
        move = state[byte] = written - 1, self._state(tuple(after))
        return move

    def _read(self, state: dict, part: bytes, written: list[int]) -> dict:
        """Follow the moves of ``part``, making those that are missing; the state after it."""
        append = written.append
        for b in part:
            try:
                token, state = state[b]
            except KeyError:
                token, state = self._move(state, b)
            append(token)
        return state

    def _path(self, written: list[int], end: int) -> list[int]:
        """Tokens of the first ``end`` bytes, from the token that ends at each of them."""
        out, length = [], self.length
        while end > 0:
            token = written[end - 1]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; what no further byte can change is emitted after each block."""
        out: list[int] = []
        written: list[int] = []
        state = self._read(self.start, piece[:BLOCK], written)
        if len(piece) <= BLOCK:
            return self._path(written, len(written))
        for at in range(BLOCK, len(piece), BLOCK):
            out += self._emit(written)
            state = self._read(state, piece[at : at + BLOCK], written)
        return out + self._path(written, len(written))

    def _emit(self, written: list[int]) -> list[int]:
        """Take out the tokens up to the last place where all encodings that can still go on meet.

        The next token begins less than one longest token before the end, at any of
        the places there. The latest place is replaced by the one before its token
        until one place is left.
        """
        at = len(written)
        open_places = {*range(max(0, at - self.longest + 1), at + 1)}
        while len(open_places) > 1:
            if at in open_places:
                open_places.remove(at)
                open_places.add(at - self.length[written[at - 1]])
            at -= 1
        end = open_places.pop()
        out = self._path(written, end)
        del written[:end]
        return out


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Kept(dict):
    """A table of results that keeps what is in use: when it is full, it becomes the
    old generation, from which entries come back when they are asked for again."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class _Unsafe(Exception):
    """White space at the end of a chunk: the cut at single spaces would not be that of the pattern."""


class Encoder:
    """Texts to ids. A single space between two chunks starts a piece under the usual
    pattern (an optional space before letters, digits or signs), so chunks can be
    kept; texts with other runs of white space go through the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.machine = machine = Transducer(ranks)
        #: Ids of pieces, and of what stands between single spaces with the space before it or without.
        self.pieces = Kept(lambda piece: _packed(machine.encode(piece.encode())), MOST_PIECES)
        self.first, self.later = Kept(lambda chunk: self._chunk("", chunk), MOST_PIECES // 16), Kept(lambda chunk: self._chunk(" ", chunk), 2 * MOST_PIECES)
        #: Whether the pattern cuts at single spaces, as probes of each kind show.
        self.cuts = all(self.find(f"{a} {b}") == [*self.find(a), *self.find(f" {b}")] for a in ("a", "1", "!", "'", "_", "é", "'s", "a!") for b in ("a", "1", "!", "'s", "_", "é"))
        #: Whether letters alone, with a space before them or without, are one piece.
        self.letters = self.find("Ab") == ["Ab"] and self.find(" Ab") == [" Ab"] and self.find(" éß") == [" éß"]

    def _chunk(self, before: str, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        if self.letters and chunk.isalpha():  # one piece, kept as a chunk
            return _packed(self.machine.encode((before + chunk).encode()))
        pieces = self.find(before + chunk)
        if self.letters and pieces and pieces[0][0] == " " and pieces[0][1:].isalpha():  # kept as a chunk too
            return self.later[pieces[0][1:]] + b"".join(map(self.pieces.__getitem__, pieces[1:]))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if self.cuts and text:
            head, *tail = text.split(" ")
            try:
                return self.first[head] + b"".join(map(self.later.__getitem__, tail))
            except _Unsafe:
                pass
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


# --- UTF-8 ---------------------------------------------------------------

#: States: 0 a character has ended; 1, 2, 3 so many bytes are due; 4 to 7 the next
#: byte is limited (after E0, ED, F0, F4); 8 not UTF-8.
DONE, BAD = 0, 8


def utf8_step(state: int, byte: int) -> int:
    """The state after one more byte."""
    if state == DONE:
        if byte < 0x80:
            return DONE
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return BAD
    low, high, to = {1: (0x80, 0xBF, DONE), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, BAD))
    return to if low <= byte <= high else BAD


class StreamDecoder:
    """Texts from a stream of ids: each call returns the characters that are complete."""

    def __init__(self, ranks: dict[bytes, int], block: int = 4096):
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.bytes_of, self.block = bytes_of, block
        self.ends = np.fromiter((self._run(DONE, token) for token in bytes_of), np.int8, len(bytes_of))
        self._steps: dict[tuple[int, int], int] = {}

    @staticmethod
    def _run(state: int, token: bytes) -> int:
        for b in token:
            state = utf8_step(state, b)
        return state

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Pieces of text whose bytes are those of the ids; bytes that are not UTF-8 become U+FFFD."""
        held, state = b"", DONE
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            tokens = list(map(self.bytes_of.__getitem__, part.tolist()))
            cut = len(tokens)
            if state != DONE or self.ends[part].any():
                cut = 0
                for k, token in enumerate(part.tolist()):
                    if state == DONE:
                        state = int(self.ends[token])
                    else:
                        key = (state, token)
                        if key not in self._steps:
                            self._steps[key] = self._run(state, self.bytes_of[token])
                        state = self._steps[key]
                    if state == BAD:  # replaced below; a new character starts
                        state = DONE
                    if state == DONE:
                        cut = k + 1
            yield (held + b"".join(tokens[:cut])).decode(errors="replace")
            held = b"".join(tokens[cut:])
        if held:
            yield held.decode(errors="replace")


# --- operators -----------------------------------------------------------

_made: dict[tuple, object] = worker_table("bpe", {})


def _once(kind: Callable, blob: bytes, *rest: object) -> object:
    """``kind(ranks, *rest)``, once per Python worker and vocabulary."""
    key = (kind.__name__, hashlib.sha256(blob).hexdigest(), *rest)
    if key not in _made:
        _made[key] = kind(read_ranks(blob), *rest)
    return _made[key]


def encoder(blob: bytes, pattern: str) -> Encoder:
    return _once(Encoder, blob, pattern)


def decoder(blob: bytes) -> StreamDecoder:
    return _once(StreamDecoder, blob)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids as little-endian unsigned 32-bit integers, one row per input row.

    ``vocabulary`` names a file of base64 tokens and ranks (a fixed size, so it is
    broadcast); ``pattern`` cuts a text into pieces, each encoded by itself and
    without special tokens. Null and empty texts give no ids; very long texts are
    handled whole; repeated rows, null ids and empty tables pass through; other
    columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def setup():
        encode = encoder(shared.value, pattern).encode
        return lambda texts: {"ids": pa.array(map(encode, texts), pa.binary())}

    return map_texts(docs, [doc_id], text, "ids binary", None, setup, "bpe")


def _arrays(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        step = 512
        at = batch.schema.get_field_index(column)
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, [np.frombuffer(x or b"", "<u4") for x in part.column(at).to_pylist()]


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The frame with ``ids`` replaced by ``decoded``, the text of the ids.

    Null ids give an empty text; an id outside the vocabulary is an error; broken
    UTF-8 becomes U+FFFD. All other columns are kept as they are; one named
    ``decoded`` is replaced.
    """
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    ship(encoded.sparkSession)
    rest = [c for c in encoded.columns if c not in (ids, "decoded")]
    source = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`").alias("_ids"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in rest), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_tables_of("bpe")
        decode = decoder(shared.value).decode
        for part, arrays in _arrays(batches, "_ids"):
            texts = pa.array(["".join(decode(a)) for a in arrays], pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(rest))], texts], names=[*rest, "decoded"])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and, if kept, ``ids``: encoded, then decoded again.

    Both happen in one Python worker, so that the ids are not sent out and back and
    no worker holds a second encoder. Cases are those of ``encode_documents``.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def setup():
        encode, decode = encoder(shared.value, pattern).encode, decoder(shared.value).decode

        def decoded(ids: bytes) -> str:
            digest = hashlib.sha256()
            for piece in decode(np.frombuffer(ids, "<u4")):
                digest.update(piece.encode())
            return digest.hexdigest()

        def work(texts: list[str]) -> dict[str, object]:
            made = [encode(t) for t in texts]
            out = {"n_tokens": pa.array([len(x) // 4 for x in made], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in made], "decoded_sha256": [decoded(x) for x in made]}
            return out | ({"ids": pa.array(made, pa.binary())} if keep_ids else {})

        return work

    return map_texts(docs, [doc_id], text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids, None, setup, "bpe")
