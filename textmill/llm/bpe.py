"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import array
import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import batch_map, lists_of, text_bytes

#: States and remembered pieces of a worker; beyond it the tables start anew. Results do not depend on it.
MAX_STATES = 3 << 17
MAX_PIECES = 1 << 18
WINDOW = 4096


class Transducer:
    """Encodes byte strings by the merges that a table of ranks implies.

    A token sequence is the encoding of its bytes exactly if each two neighbours are the encoding of theirs. So the encoding of
    each prefix is its last token after the encoding of a shorter prefix, and reading a byte only needs, for each place where
    a token may still begin, the token that ends there and how much of a token has been read since. That is a state; reading a byte leads
    to another state and gives the last token of the prefix read so far. States and transitions are made when first met.

    Tokens are emitted after a bounded lookahead: a token may still begin at most as many bytes back as the longest token
    has, and what the encodings up to all such places have in common is final.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.names = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # Tokens as a tree of bytes, 256 * node + byte to node, with the token that ends at a node.
        self.tree: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.grows: set[int] = set()
        self.depth: dict[int, int] = {0: 0}
        # a << 32 | b to the token that the two make together.
        self.joins: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for place, byte in enumerate(token):
                self.grows.add(node)
                node = self.tree.setdefault(node << 8 | byte, len(self.tree) + 1)
                self.depth[node] = place + 1
            self.token_at[node] = rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.joins[a << 32 | b] = rank
        self._reset()

    def _reset(self) -> None:
        # A state: for each place where a token may still begin, the farthest first, the node of the tree that the bytes
        # since lead to and the token before the place plus one, 0 at the beginning. The last place is the end of what was read.
        # A place is one number, and a state's places are packed, as hundreds of thousands of states are kept.
        self.states: list[bytes] = [array.array("q", [0]).tobytes()]
        # Of each state the last token of the prefix.
        self.ends: list[int] = [-1]
        # A state to 256 * its number. The numbers in `moves` are these same objects.
        self.numbers: dict[bytes, int] = {self.states[0]: 0}
        # 256 * state + byte to 256 * next state.
        self.moves: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The encoding of a short string straight from the merges: the lowest rank first, the leftmost of equals.

        `until` stops at that many parts: two give the last merge that makes a token.
        """
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if its bytes are encoded otherwise."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts = self.merged(self.names[token], 2)
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.halves[token] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may be neighbours.

        Merges happen in the order of their ranks. Going back in time from the whole tokens, the one made last falls
        into its halves; the tokens then at the border must not have had a merge of an earlier rank.
        """
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is not None:
            return found
        joins, sizes, none = self.joins, self.sizes, 1 << 62
        a, b = left, right
        found = joins.get(key) is None
        while found:
            made_a, made_b = a if sizes[a] > 1 else -1, b if sizes[b] > 1 else -1
            if made_a > made_b:
                a = self._halves(a)[1]
                found = joins.get(a << 32 | b, none) >= made_a  # of equal ranks the left one comes first
            elif made_b >= 0:
                b = self._halves(b)[0]
                found = joins.get(a << 32 | b, none) > made_b
            else:
                break
        if len(self.pairs) >= self.max_states * 2:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def _advance(self, number: int, byte: int) -> int:
        tree, token_at, grows = self.tree, self.token_at, self.grows
        made, alive = None, array.array("q")
        for place in memoryview(self.states[number]).cast("q"):
            node = tree.get(place >> 32 << 8 | byte)
            if node is None:
                continue
            left = (place & 0xFFFFFFFF) - 1
            if made is None:
                token = token_at.get(node)
                if token is not None and (self.sizes[token] == 1 or self._halves(token)) and (left < 0 or self._fits(left, token)):
                    made = token
            if node in grows:
                alive.append(node << 32 | left + 1)
        if made is None:
            raise ValueError(f"no token for the byte {byte}")
        alive.append(made + 1)
        key = alive.tobytes()
        target = self.numbers.get(key)
        if target is None:
            full = len(self.states) >= self.max_states
            if full:  # forget all states; the run goes on from the new one
                self._reset()
            target = self.numbers[key] = len(self.states) << 8
            self.states.append(key)
            self.ends.append(made)
            if full:
                return target
        self.moves[number << 8 | byte] = target
        return target

    def _settled(self, chain: list[int], number: int) -> int:
        """How many of the bytes read have an encoding that no later byte can change."""
        places = [len(chain) - self.depth[place >> 32] for place in memoryview(self.states[number]).cast("q")]
        shared = places[0]
        for place in places[1:]:
            while place != shared:
                if place > shared:
                    place -= self.sizes[chain[place - 1]]
                else:
                    shared -= self.sizes[chain[shared - 1]]
        return shared

    def _back(self, chain: list[int], place: int) -> list[int]:
        """The encoding of the first `place` bytes, from the last tokens of all prefixes."""
        out, sizes = [], self.sizes
        while place > 0:
            token = chain[place - 1]
            out.append(token)
            place -= sizes[token]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        return [token for part in self.stream(data) for token in part] if len(data) > WINDOW else self._back(self._read(data, 0)[0], len(data))

    def _read(self, data: bytes, at: int) -> tuple[list[int], int]:
        """The last token of each prefix of `data` read from state at / 256, and the state reached."""
        chain: list[int] = []
        reached: list[int] = []
        add, moves, ends = reached.append, self.moves, self.ends
        for byte in data:
            move = moves.get(at | byte)
            if move is None:
                move = self._advance(at >> 8, byte)
                if moves is not self.moves:  # the states were forgotten
                    chain += [ends[x >> 8] for x in reached]
                    reached.clear()
                    moves, ends = self.moves, self.ends
            at = move
            add(at)
        chain += [ends[x >> 8] for x in reached]
        return chain, at

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens in parts as they become final, `WINDOW` bytes being read at a time."""
        chain: list[int] = []
        at = 0
        for start in range(0, len(data), WINDOW):
            more, at = self._read(data[start:start + WINDOW], at)
            chain += more
            final = self._settled(chain, at >> 8)
            yield self._back(chain, final)
            del chain[:final]
        yield self._back(chain, len(chain))


def _utf8_steps() -> list[dict[range, int]]:
    """UTF-8 as a state machine: 0 between characters, 1-3 that many bytes to come, 4-7 limits on the next byte."""
    tail = range(0x80, 0xC0)
    return [{range(0, 0x80): 0, range(0xC2, 0xE0): 1, range(0xE0, 0xE1): 4, range(0xE1, 0xED): 2, range(0xED, 0xEE): 5,
             range(0xEE, 0xF0): 2, range(0xF0, 0xF1): 6, range(0xF1, 0xF4): 3, range(0xF4, 0xF5): 7},
            {tail: 0}, {tail: 1}, {tail: 2}, {range(0xA0, 0xC0): 1}, {range(0x80, 0xA0): 1}, {range(0x90, 0xC0): 2},
            {range(0x80, 0x90): 2}]


BROKEN = 8
UTF8_NEXT = [[BROKEN] * 256 for _ in range(9)]
for _state, _steps in enumerate(_utf8_steps()):
    for _bytes, _target in _steps.items():
        for _byte in _bytes:
            UTF8_NEXT[_state][_byte] = _target


class StreamDecoder:
    """Turns ids into text piece by piece: bytes wait until the state machine is between characters again.

    The state after a token is looked up by (state, token) once it has been met. Bytes that are no UTF-8 become U+FFFD
    when text is asked for; `raw` returns them as they are.
    """

    def __init__(self, names: dict[int, bytes]):
        self.names = names
        self.after: list[dict[int, int]] = [{} for _ in range(9)]

    def _run(self, state: int, token: int) -> int:
        at = state
        for byte in self.names[token]:
            at = UTF8_NEXT[at][byte]
        self.after[state][token] = at
        return at

    def raw(self, ids: Iterable[int]) -> tuple[bytes, bool]:
        """The bytes of the ids, and whether they are whole characters of UTF-8."""
        state, after = 0, self.after
        for token in ids:
            reached = after[state].get(token)
            state = self._run(state, token) if reached is None else reached
        return b"".join(map(self.names.__getitem__, ids)), state == 0

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole."""
        waiting, state = b"", 0
        for token in ids:
            waiting += self.names[token]
            reached = self.after[state].get(token)
            state = self._run(state, token) if reached is None else reached
            if state in (0, BROKEN):
                if state == BROKEN and len(waiting) < 4:  # the rest may be the head of a whole character
                    continue
                yield waiting.decode("utf-8", "replace")
                waiting, state = b"", 0
        if waiting:
            yield waiting.decode("utf-8", "replace")


class Codec:
    """Splits text by a pattern, encodes each match by itself and decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.transducer = Transducer(ranks)
        self.decoder = StreamDecoder(self.transducer.names)
        self.pieces_of = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> array.array:
        known, out = self.known, array.array("I")
        for piece in self.pieces_of(text):
            ids = known.get(piece)
            if ids is None:
                ids = array.array("I", self.transducer.encode(piece.encode("utf-8"))).tobytes()
                if len(piece) <= 64:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[piece] = ids
            out.frombytes(ids)
        return out


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker, made where it is used; only the path travels.

    Its tables live as long as the worker and hold no cycles, so the cyclic collector need not walk them.
    """
    made = Codec(ranks_path, pattern)
    gc.collect()
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)
    return made


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (with `with_ids`), ids_sha256, decoded_sha256 and whole for every row, without a shuffle.

    Each match of `pattern` is encoded by itself, without special tokens. ids_sha256 is the digest of the ids as little-endian
    unsigned 32-bit integers; decoded_sha256 that of the bytes the ids decode to; whole tells whether these are whole
    characters of UTF-8. A null or empty text has no tokens. A null id stays null. Rows that repeat give a row each.
    `ranks_path` must exist on every executor, as the tokenizer's package does. Other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern)
        counts, ids_digests, byte_digests, whole, lists = [], [], [], [], []
        for text in batch.column(1):
            ids = own.encode(text.as_buffer().to_pybytes().decode("utf-8", "replace"))
            data, good = own.decoder.raw(ids)
            counts.append(len(ids))
            if ids.itemsize != 4:
                raise ValueError("unsigned int has not 32 bits here")
            ids_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            byte_digests.append(hashlib.sha256(data).hexdigest())
            whole.append(good)
            if with_ids:
                lists.append(np.frombuffer(ids, np.uint32))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(byte_digests), pa.array(whole)]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"]
        if with_ids:
            columns.append(lists_of(np.concatenate(lists).view(np.int32), np.array(counts), pa.int32()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean" + ", ids array<int>" * with_ids
    return batch_map(texts, work, schema).withColumnRenamed("id", id_col)
