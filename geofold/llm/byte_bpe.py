"""Byte-level BPE: encoding by a transducer that is determinised while it reads, decoding by a UTF-8 state machine.

A row of tokens is the BPE of its bytes exactly if each token is the BPE of its own bytes and each two neighbours are
the BPE of theirs (a merge across a border would be the same merge with only these two around it).  So the merges are
a nondeterministic transducer: walk down the trie of tokens, and at a token that goes with the one before it start at the
root again.  Every start of a text is read to its end by exactly one path of whole tokens, so a set of live paths, each
the token before it and its node of the trie, is a state of the deterministic transducer, whose move by a byte tells
the token that ends there.  A token is written once all live paths have it behind them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, free_name, remembered

RANKS = "byte_bpe_multi_50k.tiktoken"
#: What a worker keeps: deterministic states, moves, tested pairs of tokens, and split pieces with their ids.  Past it, it starts anew.
STATES, MOVES, PAIRS, PIECES = 350_000, 800_000, 400_000, 150_000
#: Ids of one batch of results, in bytes.
BATCH = 8 << 20
#: Bytes of a piece after which tokens that are settled are written.
STRIDE = 4096
NEVER = 1 << 62


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Its states are made when first met; a state is the set of live paths (node of the trie, token before it)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.edges: dict[int, int] = {}
        self.tokens, self.inner, self.depth = [-1], [True], [0]
        for token, rank in ranks.items():
            node = 0
            for n, b in enumerate(token):
                self.inner[node] = True
                key = node << 8 | b
                node = self.edges.get(key, 0)
                if not node:
                    node = self.edges[key] = len(self.tokens)
                    self.tokens.append(-1)
                    self.inner.append(False)
                    self.depth.append(n + 1)
            self.tokens[node] = rank
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[int, ...]] = []  # of paths as node << 32 | token + 1
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self._number((0,))

    def _number(self, live: tuple[int, ...]) -> int:
        at = self.numbers.setdefault(live, len(self.states))
        if at == len(self.states):
            self.states.append(live)
        return at

    def _stands(self, data: bytes, cut: int) -> bool:
        """Do the merges of ``data`` end in the two tokens on both sides of ``cut`` (one token if ``cut`` is 0)?"""
        get, ends = self.ranks.get, list(range(len(data) + 1))
        rank = [get(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
        while rank:
            best = min(rank)
            if best == NEVER:
                break
            i = rank.index(best)
            if ends[i + 1] == cut:
                return False
            del ends[i + 1], rank[i]
            if i:
                rank[i - 1] = get(data[ends[i - 1]:ends[i + 1]], NEVER)
            if i < len(rank):
                rank[i] = get(data[ends[i]:ends[i + 2]], NEVER)
        return ends[1:-1] == ([cut] if cut else [])

    def follows(self, last: int, token: int) -> bool:
        """May ``token`` stand after ``last`` (-1: at the start)?"""
        key = (last + 1) << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            head = self.bytes_of[last] if last >= 0 else b""
            found = self.pairs[key] = self._stands(head + self.bytes_of[token], len(head))
        return found

    def _move(self, number: int, byte: int) -> tuple[int, int]:
        live = self.states[number]
        if len(self.states) >= STATES or len(self.moves) >= MOVES:
            self._clear()
            number = self._number(live)
        found, ended = [], -1
        for path in live:
            node = self.edges.get(path >> 32 << 8 | byte, 0)
            if node:
                last = path & 0xFFFFFFFF
                if self.inner[node]:
                    found.append(node << 32 | last)
                token = self.tokens[node]
                if token >= 0 and ended < 0 and self.follows(last - 1, token):
                    ended = token
        found.append(ended + 1)
        move = self.moves[number << 8 | byte] = (self._number(tuple(found)), ended)
        return move

    def _settled(self, state: int, ended: list[int]) -> int:
        """The last place that all live paths have behind them, by following the oldest of them back until they meet."""
        at = {len(ended) - self.depth[path >> 32] for path in self.states[state]}
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.sizes[ended[last - 1]])
        return at.pop()

    def _write(self, ended: list[int], upto: int) -> list[int]:
        out = []
        while upto:
            out.append(ended[upto - 1])
            upto -= self.sizes[out[-1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece.  A piece that is a token is that token, even if merges do not lead to it."""
        whole = self.ranks.get(piece)
        if whole is not None and not self.follows(-1, whole):
            return [whole]
        out: list[int] = []
        ended: list[int] = []  # by place since the last one written, the token that ends there
        state, moves = 0, self.moves
        for lo in range(0, len(piece), STRIDE):
            if lo:
                upto = self._settled(state, ended)
                out += self._write(ended, upto)
                del ended[:upto]
            for b in piece[lo:lo + STRIDE]:
                move = moves.get(state << 8 | b)
                if move is None:
                    move = self._move(state, b)
                    moves = self.moves
                state, token = move
                ended.append(token)
        return out + self._write(ended, len(ended))


class Encoder(dict):
    """Ids of pieces as bytes; remembers the pieces met of late, a bounded number."""

    def __init__(self, path: str | None):
        super().__init__()
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.transducer = Transducer(load_ranks(path))
        self.code = {rank: rank.to_bytes(4, "little") for rank in self.transducer.bytes_of}
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join([self.code[i] for i in self.transducer.encode(piece.encode())])
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


#: Fixed by UTF-8: bytes that may come next in each state, and the state they lead to; "" is between characters.
UTF8 = {
    "": [(0x00, 0x7F, ""), (0xC2, 0xDF, "1"), (0xE0, 0xE0, "E0"), (0xE1, 0xEC, "2"), (0xED, 0xED, "ED"), (0xEE, 0xEF, "2"), (0xF0, 0xF0, "F0"), (0xF1, 0xF3, "3"), (0xF4, 0xF4, "F4")],
    "1": [(0x80, 0xBF, "")], "2": [(0x80, 0xBF, "1")], "3": [(0x80, 0xBF, "2")],
    "E0": [(0xA0, 0xBF, "1")], "ED": [(0x80, 0x9F, "1")], "F0": [(0x90, 0xBF, "2")], "F4": [(0x80, 0x8F, "2")],
}
UTF8_MOVES = {(state, b): to for state, ways in UTF8.items() for low, high, to in ways for b in range(low, high + 1)}


def advance(held: bytes, data: bytes) -> tuple[str, bytes]:
    """(text that is complete, bytes of a character begun) after ``data``; a wrong byte ends a character as U+FFFD."""
    out, state, start = [], "", 0
    data = held + data
    for i, b in enumerate(data):
        to = UTF8_MOVES.get((state, b))
        if to is None and state:
            out.append("�")
            state, start = "", i
            to = UTF8_MOVES.get((state, b))
        if to is None:
            out.append("�")
            start = i + 1
        elif not to:
            out.append(data[start:i + 1].decode())
            start = i + 1
        state = to or ""
    return "".join(out), data[start:]


class Decoder(dict):
    """Steps of the state machine by whole tokens: (bytes held, id) -> (text, bytes held)."""

    def __init__(self, path: str | None):
        super().__init__()
        self.bytes_of = {rank: token for token, rank in load_ranks(path).items()}

    def __missing__(self, key: tuple[bytes, int]) -> tuple[str, bytes]:
        if len(self) >= PIECES:
            self.clear()
        step = self[key] = advance(key[0], self.bytes_of[key[1]])
        return step

    def feed(self, ids: Iterable[int], held: bytes = b"") -> Iterator[tuple[str, bytes]]:
        """Text that each id completes, and the bytes held after it."""
        for i in ids:
            text, held = self[held, i]
            yield text, held

    def decode(self, ids: Iterable[int]) -> str:
        held, out = b"", []
        for text, held in self.feed(ids):
            out.append(text)
        return "".join(out) + ("�" if held else "")


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of each whole text as an array (``out``, renamed with underscores if ``docs`` has such a column).

    A null text is empty, an empty one has no ids.  Rows stay as they are, repeated ones too; an empty table gives an
    empty result.  ``path`` is the rank file, by default the public one, looked up where the task runs.  One row's
    text and ids are in memory at once, no more.
    """
    out = free_name(docs, out)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def tag(cols) -> Iterator[pa.RecordBatch]:
        coder = remembered(f"byte bpe {path}", lambda: Encoder(path))
        texts, lo, found, held = cols[text], 0, [], 0
        for i in range(len(texts)):
            found.append(coder.encode(texts[i].as_py()) if texts[i].is_valid else b"")
            held += len(found[-1])
            if held > BATCH or i + 1 == len(texts):
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype("i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*[cols[n].slice(lo, len(found)) for n in names], ids], schema.names)
                lo, found, held = i + 1, [], 0

    return batches(docs, tag, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of an array of ids; bytes that are no UTF-8 become U+FFFD, as does a character cut off at the end.

    Null and empty arrays give an empty text.  An id that the vocabulary lacks is an error.
    """
    out = free_name(rows, out)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def tag(cols) -> Iterator[pa.RecordBatch]:
        coder = remembered(f"byte bpe decoder {path}", lambda: Decoder(path))
        lists, lo, found, held = cols[ids], 0, [], 0
        for i in range(len(lists)):
            found.append(coder.decode(lists[i].values.to_numpy().tolist()) if lists[i].is_valid else "")
            held += len(found[-1])
            if held > BATCH or i + 1 == len(lists):
                yield pa.RecordBatch.from_arrays([*[cols[n].slice(lo, len(found)) for n in names], pa.array(found, pa.string())], schema.names)
                lo, found, held = i + 1, [], 0

    return batches(rows, tag, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` (of the ids decoded again).

    As :func:`encode` and :func:`decode` one after the other, in one pass that lets no ids leave the task.
    """
    df = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]])

    def tell(cols) -> Iterator[pa.RecordBatch]:
        coder, back = remembered(f"byte bpe {path}", lambda: Encoder(path)), remembered(f"byte bpe decoder {path}", lambda: Decoder(path))
        many, told, read = [], [], []
        for t in cols["_text"]:
            ids = np.frombuffer(coder.encode(t.as_py()) if t.is_valid else b"", "<i4").tolist()
            many.append(len(ids))
            told.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            read.append(hashlib.sha256(back.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([cols["_id"], pa.array(many, pa.int64()), pa.array(told), pa.array(read)], schema.names)

    return batches(df, tell, schema).withColumnRenamed("_id", key)
