"""Byte and byte-level BPE tokenizers as column functions.

Null text has null ids. Ids of the byte tokenizer are the UTF-8 bytes plus 4; pad, bos, eos, unk are 0 to 3. Ids
of trained BPE are the bytes plus 14, then one for each merge.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, BOS, EOS, UNK = range(4)
BYTE_OFFSET = 4
BYTE_VOCABULARY = 256 + BYTE_OFFSET
# Special tokens of a trained vocabulary, in the order of their ids.
SPECIAL_TOKENS = (
    "<pad>", "<bos>", "<eos>", "<unk>", "<fim_prefix>", "<fim_middle>", "<fim_suffix>", "<|pad|>", "<|bos|>", "<|eos|>", "<|user|>", "<|assistant|>", "<|system|>", "<|endoftext|>",
)
BPE_OFFSET = len(SPECIAL_TOKENS)


def byte_ids(text: str, bos: bool = False, eos: bool = False) -> list[int]:
    ids = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int32) + BYTE_OFFSET).tolist()
    return [BOS] * bos + ids + [EOS] * eos


def byte_text(ids: list[int]) -> str:
    """Ids back to text; special ids are left out, malformed UTF-8 is replaced."""
    return bytes(i - BYTE_OFFSET for i in ids if BYTE_OFFSET <= i < BYTE_VOCABULARY).decode("utf-8", "replace")


def byte_encode(c: Column, bos: bool = False, eos: bool = False) -> Column:
    """Byte ids of a text column. The ids are the column's own bytes, shifted: no text becomes a Python object."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        values = values.cast(pa.large_string()) if not pa.types.is_large_string(values.type) else values
        n = len(values)
        valid, offsets, data = values.buffers()
        at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
        ids = raw.astype(np.int32) + BYTE_OFFSET
        lengths = np.diff(at)
        if bos or eos:
            starts = (at[:-1] - at[0]) + np.arange(n) * (bos + eos)
            out = np.empty(len(ids) + n * (bos + eos), np.int32)
            mask = np.ones(len(out), bool)
            if bos:
                mask[starts] = False
                out[starts] = BOS
            if eos:
                ends = starts + bos + lengths
                mask[ends] = False
                out[ends] = EOS
            out[mask] = ids
            ids, lengths = out, lengths + bos + eos
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids, pa.int32()), mask=values.is_null() if values.null_count else None)
        return lists

    return run(c)


def byte_count(c: Column, bos: bool = False, eos: bool = False) -> Column:
    """How many ids `byte_encode` gives."""
    return F.octet_length(c) + int(bos) + int(eos)


def byte_decode(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else byte_text(v) for v in values.to_pylist()], pa.string())

    return run(c)


@dataclass(frozen=True)
class BpeModel:
    """A trained byte-level vocabulary: merges in the order they were learnt."""

    merges: tuple[tuple[int, int], ...] = ()
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS
    version: int = field(default=1)

    @property
    def vocab_size(self) -> int:
        return BPE_OFFSET + 256 + len(self.merges)

    def to_json(self) -> str:
        return json.dumps({"type": "byte-bpe", "version": self.version, "special_tokens": list(self.special_tokens), "merges": [list(m) for m in self.merges]})

    @classmethod
    def from_json(cls, text: str) -> BpeModel:
        data = json.loads(text)
        return cls(tuple((int(a), int(b)) for a, b in data["merges"]), tuple(data["special_tokens"]), int(data.get("version", 1)))

    def pieces(self) -> list[bytes]:
        """The bytes of every id; special ids have none."""
        out = [b""] * BPE_OFFSET + [bytes([b]) for b in range(256)]
        for a, b in self.merges:
            out.append(out[a] + out[b])
        return out

    def encoder(self) -> BpeEncoder:
        """A function from text to ids that remembers what it has encoded. The lowest-ranked pair merges first."""
        return BpeEncoder(self)

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces()
        return b"".join(pieces[i] for i in ids if 0 <= i < len(pieces)).decode("utf-8", "replace")


class BpeEncoder:
    """Encodes texts under a model; travels as the model alone, what it has learnt stays in its process."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.rank = {m: k for k, m in enumerate(model.merges)}
        # bytes on either side of a place that no merge spans never meet: the text is split there
        p = model.pieces()
        self.inside = np.zeros((256, 256), bool)
        for x, y in model.merges:
            self.inside[p[x][-1], p[y][0]] = True
        self.word = lru_cache(maxsize=1 << 16)(self._word)
        # where no merge holds a blank, texts are split at blanks first, and what stands between them is remembered as a whole
        self.blank = None if any(BPE_OFFSET + 32 in m for m in model.merges) else np.int32(BPE_OFFSET + 32).tobytes()
        self.unit = lru_cache(maxsize=1 << 16)(self._unit)

    def __reduce__(self):
        return BpeEncoder, (self.model,)

    def _word(self, raw: bytes) -> bytes:
        """Merges by rank, then from the left, with a heap over a linked list of symbols."""
        n = len(raw)
        ids, after, before = [b + BPE_OFFSET for b in raw], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = BPE_OFFSET + 256 + r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := self.rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := self.rank.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (k, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def _unit(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        b = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        return b"".join([self.word(raw[lo:hi]) for lo, hi in zip(cuts, cuts[1:])])

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers, one after the other."""
        raw = text.encode("utf-8", "replace")
        return self._unit(raw) if self.blank is None else self.blank.join(map(self.unit, raw.split(b" ")))

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


@lru_cache(maxsize=2)
def _encoder(model: BpeModel) -> BpeEncoder:
    """One for all batches of a worker."""
    return BpeEncoder(model)


def bpe_encode(c: Column, model: BpeModel) -> Column:
    """Ids of a text column under a trained vocabulary, which travels with the task."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        encode = _encoder(model).packed
        rows = [b"" if v is None else encode(v) for v in values.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]), mask=values.is_null() if values.null_count else None)

    return run(c)


def bpe_decode(c: Column, model: BpeModel) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        pieces, known = pa.array(model.pieces(), pa.large_binary()), pa.array(np.arange(model.vocab_size, dtype=np.int32))
        out = []
        for k in range(0, len(values), 256):  # the pieces of a few texts at once
            part = values.slice(k, 256)
            got = pieces.take(pc.index_in(part.flatten().cast(pa.int32()), known))  # no bytes for other ids
            at = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, 8 * got.offset) if len(got) else np.zeros(1, np.int64)
            raw = got.buffers()[2].to_pybytes() if len(got) and got.buffers()[2] is not None else b""
            ends = at[np.cumsum([0, *part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])].tolist()
            out += [raw[lo:hi].decode("utf-8", "replace") if there else None for lo, hi, there in zip(ends, ends[1:], part.is_valid().to_pylist())]
        return pa.array(out, pa.string())

    return run(c)


class WrappedTokenizer:
    """A tokenizer file of another library (WordPiece, BPE or unigram of `tokenizers`, BPE or unigram of `sentencepiece`), opened once a worker."""

    def __init__(self, kind: str, path: str):
        from corpusloom.sources import storage

        self.kind, self.path, self.data = kind, path, storage.read_bytes(path)

    def __getstate__(self):
        return {"kind": self.kind, "path": self.path, "data": self.data}

    def open(self):
        key = (self.kind, hash(self.data))
        if key not in _opened:
            if self.kind == "sentencepiece":
                import sentencepiece

                _opened[key] = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            else:
                import tokenizers

                _opened[key] = tokenizers.Tokenizer.from_str(self.data.decode("utf-8"))
        return _opened[key]

    @property
    def vocab_size(self) -> int:
        return self.open().get_piece_size() if self.kind == "sentencepiece" else self.open().get_vocab_size()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if self.kind == "sentencepiece":
            return self.open().encode(texts)
        return [e.ids for e in self.open().encode_batch(texts, add_special_tokens=False)]

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        return self.open().decode(ids) if self.kind == "sentencepiece" else self.open().decode_batch(ids, skip_special_tokens=True)

    def encoder(self):
        return lambda text: self.encode_all([text])[0]


_opened: dict[tuple, object] = {}


def wrapped_encode(c: Column, tokenizer: WrappedTokenizer) -> Column:
    """Ids of a text column, a batch at a time; null for null texts."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        got = iter(tokenizer.encode_all(values.drop_null().to_pylist()))
        return pa.array([next(got) if v else None for v in values.is_valid().to_pylist()], pa.list_(pa.int32()))

    return run(c)


def wrapped_decode(c: Column, tokenizer: WrappedTokenizer) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        got = iter(tokenizer.decode_all(values.drop_null().to_pylist()))
        return pa.array([next(got) if v else None for v in values.is_valid().to_pylist()], pa.string())

    return run(c)


# Other names of the tokenizer types.
TOKENIZER_ALIASES = {
    "byte": "byte", "native-byte": "byte", "bytes": "byte", "bpe": "bpe", "python-bpe": "bpe", "native-bpe": "bpe", "byte-bpe": "bpe",
    "hf-bpe": "tokenizers", "wordpiece": "tokenizers", "huggingface": "tokenizers", "unigram": "sentencepiece", "sentencepiece": "sentencepiece", "sentencepiece-bpe": "sentencepiece", "sentencepiece-unigram": "sentencepiece",
}


def tokenizer_type(kind: str) -> str:
    """The plain name of a tokenizer type in any spelling; an unknown one is an error."""
    name = TOKENIZER_ALIASES.get(kind.strip().lower().replace("_", "-"))
    if name is None:
        raise ValueError(f"unknown tokenizer type {kind!r}; known: {', '.join(sorted(TOKENIZER_ALIASES))}")
    return name


def load_model(kind: str, path: str) -> BpeModel | WrappedTokenizer:
    """The vocabulary in a file, for a type other than `byte`."""
    from corpusloom.sources import storage

    name = tokenizer_type(kind)
    return BpeModel.from_json(storage.read_bytes(path).decode("utf-8")) if name == "bpe" else WrappedTokenizer(name, path)


def load_tokenizer(kind: str = "byte", path: str | None = None):
    """`(encode, decode)` column functions; every type is the byte tokenizer where no path is given."""
    if tokenizer_type(kind) == "byte" or path is None:
        return byte_encode, byte_decode
    model = load_model(kind, path)
    if isinstance(model, WrappedTokenizer):
        return (lambda c: wrapped_encode(c, model)), (lambda c: wrapped_decode(c, model))
    return (lambda c: bpe_encode(c, model)), (lambda c: bpe_decode(c, model))
