"""Encoding of a corpus with a public byte-level BPE vocabulary, by a transducer.

The merge table is compiled into a finite-state transducer that is determinised lazily: states
and transitions are made when a text first needs them and kept. For each prefix of a unit (what
the vocabulary's pattern splits a text into) the last token of its encoding is unique; a state
holds the longest suffix that can still grow into a token and, for each end position inside it,
the tokens since the last settled boundary. Reading a byte finds the one token that may end
there (the pair with its predecessor must be stable under the merges) and emits all tokens that
every live continuation shares, so the lookahead is bounded by the longest token. Whole units
are kept too, as composed transitions.

Decoding is a stream: an incremental UTF-8 state machine holds back the bytes of an incomplete
character at the end of a chunk.

Defined results
* null and empty texts: an empty list; blank texts: the ids of their white space;
* the strings of special tokens in a text are ordinary text;
* very long texts are read unit by unit; a unit of any length in one left-to-right pass;
* lone surrogates can't occur in parquet strings; invalid bytes on decoding become U+FFFD;
* other columns are carried along only by ``with_token_counts``, where ``n_tokens`` is replaced.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZER_DIR = os.environ.get("TRACELOOM_TOKENIZERS", "/opt/tokenizers")
#: How the byte-level vocabularies split a text before merging (fixed value of the vocabulary).
UNIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most whole units kept at a time in one worker (they are made again when needed).
UNITS_KEPT = 500_000
STATES_KEPT = 200_000


def vocabulary_bytes(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    """The rank file of a vocabulary (bounded by its size: tens of thousands of entries)."""
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken"), "rb") as f:
        return f.read()


class State:
    __slots__ = ("suffix", "pending", "step", "final")

    def __init__(self, suffix: bytes, pending: tuple):
        self.suffix = suffix  # longest suffix of the input that some token starts with
        self.pending = pending  # for each position from len(suffix) back to 0: tokens since the base, or None
        self.step: dict[int, tuple[State, tuple]] = {}
        self.final = pending[-1]


class BpeTransducer:
    """Bytes of one unit to token ids; grows its states as it reads."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.starts = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.token = {i: t for t, i in ranks.items()}
        self._whole: dict[int, bool] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._reset()

    @classmethod
    def load(cls, data: bytes) -> BpeTransducer:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def _reset(self) -> None:
        # position 0 has no token yet: its list is empty and any valid token may follow
        self.start = State(b"", ((),))
        self.states: dict[tuple, State] = {(b"", ((),)): self.start}

    def merge(self, data: bytes) -> list[int]:
        """Reference merging of a short byte string: lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """A token that its own bytes encode to."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.token[token]) == [token]
        return known

    def stable(self, left: int, right: int) -> bool:
        """Two tokens that stay apart when their bytes are encoded together."""
        known = self._stable.get((left, right))
        if known is None:
            known = self._stable[left, right] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def advance(self, state: State, byte: int) -> tuple[State, tuple]:
        """Make the transition of a state on a byte: (next state, tokens emitted)."""
        data = state.suffix + bytes((byte,))
        pending = state.pending
        found = None
        # the longest token that ends here and is stable after its predecessor; it is the only one
        for at in range(len(data)):
            before = pending[at]
            token = self.ranks.get(data[at:])
            if token is None or before is None or not self.whole(token):
                continue
            # an empty list at a settled boundary still has a left neighbour: it is kept in front
            left = before[-1] if before else None
            if left is None or self.stable(left, token):
                found = before + (token,)
                break
        lists = pending + (found,)
        suffix = data
        while suffix and suffix not in self.starts:
            suffix = suffix[1:]
        lists = lists[len(data) - len(suffix) :]
        live = [x for x in lists if x is not None]
        # settled: what all live positions share, but for the last token, the neighbour of what comes
        shared = 0
        for column in zip(*live):
            if any(t != column[0] for t in column):
                break
            shared += 1
        shared = max(0, shared - 1)
        emitted = live[0][:shared]
        lists = tuple(x if x is None else x[shared:] for x in lists)
        key = (suffix, lists)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(suffix, lists)
        state.step[byte] = made = (target, emitted)
        return made

    def encode_unit(self, data: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in data:
            made = state.step.get(byte)
            if made is None:
                if len(self.states) > STATES_KEPT:  # begin again from here, also within a long unit
                    self._reset()
                    state = self.states.setdefault((state.suffix, state.pending), State(state.suffix, state.pending))
                made = self.advance(state, byte)
            state = made[0]
            if made[1]:
                out.extend(made[1])
        return (*out, *state.final)


class Encoder(dict):
    """Texts to ids. The mapping itself keeps whole units: unit -> ids."""

    def __init__(self, data: bytes, pattern: str = UNIT_PATTERN):
        import regex

        super().__init__()
        self.transducer = BpeTransducer.load(data)
        self.split = regex.compile(pattern).findall

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.transducer.encode_unit(unit.encode())
        if len(unit) <= 64:
            if len(self) >= UNITS_KEPT:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> Iterable[int]:
        return chain.from_iterable(map(self.__getitem__, self.split(text))) if text else ()


#: UTF-8 by lead byte: how many bytes a character has.
_WIDTH = [1] * 0xC2 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [1] * 11


class StreamDecoder:
    """Ids to text, chunk by chunk. ``state`` is the incomplete character at the end so far."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.state = token, b""

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        data = self.state + b"".join(map(self.token.__getitem__, ids))
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 != 0x80:  # the last lead byte or ASCII
                    if _WIDTH[byte] > back:
                        cut -= back
                    break
        self.state = data[cut:]
        return data[:cut].decode("utf-8", "replace")


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = (len(data), hash(data))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every document: one narrow pass over the two columns it needs."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary, folder))
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            # pieces of a batch, so that the ids of very long texts don't pile up
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                ids, offsets = array("i"), array("i", [0])
                for t in piece.column(1).to_pylist():
                    ids.extend(encoder.encode(t))
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str | None = None, chunk: int = 4096) -> DataFrame:
    """(key, text) of (key, ids), each decoded as a stream of chunks."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary, folder))
    kind = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encoder(shared.value).transducer.token
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder, parts = StreamDecoder(token), []
                for at in range(0, len(ids or ()), chunk):
                    parts.append(decoder.feed(ids[at : at + chunk]))
                parts.append(decoder.feed((), last=True))
                texts.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind.simpleString()}, text string")


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The named columns and ``n_tokens``, the length of each text in tokens; null and empty: 0."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary, folder))
    source = documents.select(*columns, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        size = _Sizes(encoder)
        for batch in batches:
            sizes = [sum(map(size.__getitem__, encoder.split(t))) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(run, schema)


class _Sizes(dict):
    """Unit -> number of its tokens."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> int:
        n = len(self.encoder[unit])
        if len(unit) <= 64:
            if len(self) >= UNITS_KEPT:
                self.clear()
            self[unit] = n
        return n
