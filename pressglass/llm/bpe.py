"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding.  For a prefix of a word, BPE's last token is the one vocabulary token ending there that can stand next
to the last token of the shorter prefix (two tokens can stand side by side when BPE leaves their concatenation
as these two).  Reading byte by byte, the unread future can only start its next token at a boundary from which the
bytes read so far are a proper prefix of a longer token; every such boundary is one item of a set: the token that ends
there, and the bytes since.  Such sets are the transducer's states, built when first met (determinisation).  Its
output at a byte is the token that ends there if one does; which of these count is sure after a lookahead bounded by
the longest token, when the chains of tokens to all boundaries of the state agree.

Decoding.  UTF-8's state machine over bytes, lifted to tokens: most tokens begin and end between characters,
so runs of these are copied at once, and the machine walks through the others only.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import bounded_batches
from pressglass.llm.pretokens import WordIds, split_words


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Above every rank.
NEVER = 1 << 40
#: Bytes of a word between two looks at which tokens are sure.
LOOKAHEAD = 1024


class Transducer:
    """A vocabulary's tokens must each be what BPE makes of their own bytes, as trained vocabularies are.  States
    and edges appear as words ask for them; beyond max_states the tables start afresh."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 80_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # a trie of the tokens: node << 8 | byte -> node; 0 is its root
        self.token_at, self.inner, self.depth = [-1], [True], [0]
        self.size = {rank: len(token) for token, rank in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (to := self.child.get(node << 8 | byte)) is None:
                    to = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.inner[node] = True
                node = to
            self.token_at[node] = rank
        self.beside: dict[int, bool] = {}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self._start_afresh()

    def _start_afresh(self) -> None:
        # An item: the token that ends at a boundary (-1 at the word's start), and the bytes read since as a node.
        self.states = [((-1, 0),)]
        self.number = {self.states[0]: 0}
        self.edges: dict[int, tuple[int, int]] = {}

    def merge(self, word: bytes, until: int = 1) -> list[bytes]:
        """BPE by definition: joins the adjacent pair of lowest rank until none (or so many parts) is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge_parts(self, token: bytes, last: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's last (first) byte while BPE builds it, from the whole token down
        to the byte, each with the rank at which it is joined into the part before it."""
        key = (token, last)
        if (found := self.spines.get(key)) is None:
            found, gone, part = [], NEVER, token
            while True:
                found.append((part, gone))
                if len(part) == 1:
                    break
                gone = self.ranks[part]
                part = self.merge(part, 2)[-1 if last else 0]
            self.spines[key] = found
        return found

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves left + right as these two tokens.

        Parts are joined in order of rank.  Follow the parts on both sides of the border as they grow: the tokens
        stay apart unless, at some moment, the two parts at the border have a joint rank that comes first.
        """
        a, b = self.edge_parts(left, True), self.edge_parts(right, False)
        i, j = len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            (x, x_gone), (y, y_gone) = a[i], b[j]
            joint = self.ranks.get(x + y, NEVER)
            if joint < x_gone and joint <= y_gone and joint < NEVER:  # of equal ranks, the leftmost pair goes first
                return False
            if x_gone <= y_gone:
                i -= 1
            else:
                j -= 1
        return True

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The edge for a byte: the state behind it, and the token that ends there if a token does."""
        items, done, child, token_at, inner = [], -1, self.child, self.token_at, self.inner
        for last, node in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if done < 0 <= token:
                if last < 0:
                    done = token
                else:
                    ok = self.beside.get(last << 32 | token)
                    if ok is None:
                        ok = self.beside[last << 32 | token] = self.fits(self.tokens[last], self.tokens[token])
                    if ok:
                        done = token
            if inner[node]:
                items.append((last, node))
        items.append((done, 0))
        key = tuple(items)
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        edge = self.edges[state << 8 | byte] = (to, done)
        return edge

    def _chain(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to a boundary, the last one first."""
        out, size = [], self.size
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        return out

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token; a word of the vocabulary is its own token, as in public encoders."""
        if (rank := self.ranks.get(word)) is not None:
            return (rank,)
        if len(self.states) > self.max_states:
            self._start_afresh()
        if len(self.beside) > 3 * self.max_states:
            self.beside.clear()
        if len(word) > LOOKAHEAD:
            return tuple(self.stream(word))
        edges, at, ends = self.edges, 0, []
        for byte in word:
            at, token = edges.get(at << 8 | byte) or self.step(at, byte)
            ends.append(token)
        return tuple(self._chain(ends, len(ends))[::-1])

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a word of any length, bytes by bytes: LOOKAHEAD bytes are held at most, and those of one token.

        A token is sure once the chains of tokens to all boundaries of the state go through its end.
        """
        at, ends = 0, []
        for byte in data:
            at, token = self.edges.get(at << 8 | byte) or self.step(at, byte)
            ends.append(token)
            if len(ends) >= LOOKAHEAD:
                chains = [self._chain(ends, len(ends) - self.depth[node])[::-1] for _, node in self.states[at]]
                agreed = 0
                while all(len(c) > agreed and c[agreed] == chains[0][agreed] for c in chains):
                    agreed += 1
                yield from chains[0][:agreed]
                # Boundaries inside what is left count from the last sure one.
                del ends[: sum(self.size[t] for t in chains[0][:agreed])]
        yield from self._chain(ends, len(ends))[::-1]

    def encode_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [self.encode(w) for w in words]


def utf8_step(state: int, byte: int) -> int:
    """UTF-8's state machine. States: 0 between characters, 1-3 continuation bytes to come,
    4-7 the same with a narrowed next byte (after E0, ED, F0, F4), -1 no UTF-8."""
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return -1
    low, high, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
    return to if low <= byte <= high else -1


class StreamDecoder:
    """Takes ids in pieces; gives the text as far as characters are complete, and keeps the rest.

    push() raises UnicodeDecodeError at bytes that no continuation can make UTF-8, finish() at an open character.
    """

    def __init__(self, tokens: pa.Array):
        self.tokens, self.state, self.kept = tokens, 0, b""
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.whole = np.zeros(len(tokens), bool)
        self.seen = np.zeros(len(tokens), bool)

    def _through(self, state: int, token: int) -> tuple[int, int]:
        """The state behind a token, and how many of its last bytes belong to an open character."""
        if (m := self.moves.get((state, token))) is None:
            to, data, open_at = state, self.tokens[token].as_py(), -1 if state else 0
            for i, byte in enumerate(data):
                if to == 0:
                    open_at = i
                to = utf8_step(to, byte)
                if to < 0:
                    raise UnicodeDecodeError("utf-8", data, i, i + 1, "invalid byte")
                if to == 0:
                    open_at = i + 1
            m = self.moves[state, token] = (to, -1 if open_at < 0 else len(data) - open_at)
        return m

    def push(self, ids: np.ndarray) -> bytes:
        new = np.unique(ids[~self.seen[ids]])
        for token in new:
            try:
                self.whole[token] = self._through(0, int(token))[0] == 0
            except UnicodeDecodeError:
                self.whole[token] = False
            self.seen[token] = True
        data = self.kept + _joined(self.tokens, ids)
        open_bytes, last = len(self.kept), -1
        for i in np.flatnonzero(~self.whole[ids]):  # between these, every token is whole
            if self.state and i != last + 1:
                self._through(self.state, int(ids[last + 1]))  # raises: a whole token can't go on in a character
            self.state, back = self._through(self.state, int(ids[i]))
            open_bytes = open_bytes + len(self.tokens[int(ids[i])].as_py()) if back < 0 else back
            last = i
        if self.state and last + 1 < len(ids):
            self._through(self.state, int(ids[last + 1]))
        cut = len(data) - open_bytes if self.state else len(data)
        self.kept = data[cut:]
        return data[:cut]

    def finish(self) -> None:
        state, kept = self.state, self.kept
        self.state, self.kept = 0, b""
        if state:
            raise UnicodeDecodeError("utf-8", kept, 0, len(kept), "unexpected end")


def _joined(tokens: pa.Array, ids: np.ndarray) -> bytes:
    """The ids' bytes, end to end."""
    if not len(ids):
        return b""
    taken = tokens.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
    return memoryview(taken.buffers()[2])[ends[0] : ends[-1]].tobytes()


def _tables(path: str) -> tuple[Transducer, WordIds, pa.Array, pa.Array]:
    """The transducer, its memo, each id's bytes and its decimal digits behind a space.

    Built for each task: workers outlive tasks, and what they kept would stay in memory while they do other work.
    """
    transducer = Transducer(ranks := read_ranks(path))
    tokens = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        tokens[rank] = token
    return transducer, WordIds(transducer.encode_all), pa.array(tokens, pa.binary()), pa.array([b" %d" % i for i in range(len(tokens))], pa.binary())


#: Ids decoded at a time.
PIECE = 65_536


def _decoded(decoder: StreamDecoder, ids: np.ndarray) -> Iterator[bytes]:
    for i in range(0, len(ids), PIECE):
        yield decoder.push(ids[i : i + PIECE])
    decoder.finish()


def _digest(pieces) -> str:
    h = hashlib.sha256()
    for x in pieces:
        h.update(x)
    return h.hexdigest()


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids again; one row per row: id, n_tokens, ids_sha256, decoded_sha256,
    and if wanted the ids and the decoded text.

    Null and empty texts have no ids (the digests are those of no bytes); repeated rows each give a row; other
    columns are ignored.  Every id is made and checked in the task that reads the row: nothing is shuffled.
    """
    fields = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables have no cycles; the collector would walk them again and again
        try:
            yield from coded(batches)
        finally:  # also where a task fails or a limit ends it: the worker goes on with other work
            gc.enable()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo, tokens, digits = _tables(ranks_path)
        decoder = StreamDecoder(tokens)
        for batch in batches:
            words, rows = split_words(batch.column(1).to_pylist())
            ids, ends = memo.ids(words)
            rows = ends[rows]
            n = np.diff(rows)
            own = [ids[a:b] for a, b in zip(rows, rows[1:], strict=False)]
            digests = [hashlib.sha256(_joined(digits, x)[1:]).hexdigest() for x in own]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                texts = [b"".join(_decoded(decoder, x)) for x in own]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()))
            else:
                columns.append(pa.array([_digest(_decoded(decoder, x)) for x in own], pa.string()))
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32))))
            if with_text:
                columns.append(pa.array([x.decode() for x in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(each, fields)
