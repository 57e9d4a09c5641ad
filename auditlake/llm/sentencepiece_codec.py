"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here: pieces, scores, types, and the specifications of
trainer and normaliser. From these the normaliser (character map, dummy prefix, extra white
space), the metaspace marker, the model (unigram scores, or merges ranked by score) and byte
fallback are rebuilt. Batches are encoded by several threads inside a task, and every text's
ids are compared with those of the sentencepiece library; ``parity`` tells where they differ.

Defined cases: null and empty texts have no tokens and decode to the empty text; texts are
never cut, a very long one is encoded whole; every row is encoded for itself, so repeated rows
and ties give equal results; an empty table gives an empty table. Decoding gives the text
back exactly unless it holds the marker character itself, which reads as a space, or the
normaliser changes it.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.columns import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of text encoded in one call; bounds what a batch holds in memory.
BATCH_CHARS = 1_000_000
THREADS = 2

# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} at byte {at}")


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    collapse_spaces: bool
    escape_spaces: bool


def parse_model(data: bytes) -> Model:
    """Read a serialized model; fields left out have the format's defaults."""
    pieces, scores, types = [], [], []
    kind, fallback = UNIGRAM, False
    charsmap, dummy, collapse, escape = b"", True, True, True
    for number, value in _fields(data):
        if number == 1:
            piece, score, of_type = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    of_type = v
            pieces.append(piece)
            scores.append(score)
            types.append(of_type)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    kind = v
                elif n == 35:
                    fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    charsmap = v
                elif n == 3:
                    dummy = bool(v)
                elif n == 4:
                    collapse = bool(v)
                elif n == 5:
                    escape = bool(v)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    unk = types.index(UNKNOWN) if UNKNOWN in types else 0
    return Model(tuple(pieces), tuple(scores), tuple(types), kind, unk, fallback, charsmap, dummy, collapse, escape)


def _merges(model: Model) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces, best score first: the ranks of a BPE model."""
    usable = {p: s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for order, (piece, score) in enumerate(usable.items()):
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                found.append((-score, order, cut, left, right))
    return [(left, right) for _, _, _, left, right in sorted(found)]


def build_tokenizer(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE(
            vocab={p: i for i, p in enumerate(model.pieces)}, merges=_merges(model), unk_token=model.pieces[model.unk_id],
            fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=False, cache_capacity=0,
        )
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARK if model.escape_spaces else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if model.kind == UNIGRAM and not any(mark in p.lstrip(mark) for p, t in zip(model.pieces, model.types, strict=True) if t != CONTROL):
        # No piece goes on past a marker, so words can be encoded one by one, and known words are remembered. Merges
        # take a whole text at once, as in the sentencepiece library: to cut it into words costs more than they do.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{mark}*[^{mark}]*"), "isolated")
    parts = [decoders.Replace(MARK, " ")] if model.escape_spaces else []
    if model.byte_fallback:
        parts.append(decoders.ByteFallback())
    parts.append(decoders.Fuse())
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


@lru_cache(maxsize=2)
def _loaded(data: bytes):
    """Tokenizer, byte ids and reference processor; once per worker and model."""
    import sentencepiece

    model = parse_model(data)
    byte_ids = frozenset(i for i, t in enumerate(model.types) if t == BYTE)
    return build_tokenizer(model), byte_ids, sentencepiece.SentencePieceProcessor(model_proto=data)


def _blocks(texts: Sequence[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_batch(data: bytes, texts: Sequence[str], threads: int = THREADS) -> Iterator[tuple[list[list[int]], list[bool]]]:
    """Ids of the texts, and whether the sentencepiece library gives the same, in blocks of bounded size."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    tokenizer, _, reference = _loaded(data)
    for a, b in _blocks(texts, BATCH_CHARS):
        block = list(texts[a:b])
        own = [e.ids for e in tokenizer.encode_batch_fast(block, add_special_tokens=False)]
        theirs = reference.encode(block, num_threads=threads)
        yield own, [x == y for x, y in zip(own, theirs, strict=True)]


@lru_cache(maxsize=2)
def _bytes_of(data: bytes) -> tuple[list[bytes], bool]:
    """What each id reads as: a byte piece as its byte, others with the marker as a space."""
    model = parse_model(data)
    out = []
    for piece, t in zip(model.pieces, model.types, strict=True):
        plain = piece.replace(MARK, " ") if model.escape_spaces else piece
        out.append(bytes([int(piece[3:5], 16)]) if t == BYTE else plain.encode("utf-8"))
    return out, model.dummy_prefix


def decode_batch(data: bytes, ids: Sequence[Sequence[int]]) -> list[str]:
    """Texts of id lists; ids whose bytes are no text are left to the tokenizer's decoder."""
    pieces, dummy = _bytes_of(data)
    out = []
    for x in ids:
        joined = b"".join(map(pieces.__getitem__, x))
        try:
            text = joined.decode("utf-8")
        except UnicodeDecodeError:
            out.append(_loaded(data)[0].decode(list(x), skip_special_tokens=False))
        else:
            out.append(text[1:] if dummy and text[:1] == " " else text)
    return out


def read_model(path: str = MODEL) -> bytes:
    """The model file, read where the driver runs; half a megabyte that goes to the tasks with the code."""
    with open(path, "rb") as f:
        return f.read()


OUT = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "n_bytes": T.LongType(),
    "parity": T.BooleanType(),
    "decoded": T.StringType(),
    "round_trip": T.BooleanType(),
}


def encode(
    df: DataFrame, text: str = "text", model: str = MODEL, outputs: Sequence[str] = tuple(OUT), keep_text: bool = True, threads: int = THREADS
) -> DataFrame:
    """Add what ``outputs`` names; columns of those names are replaced.

    ``ids``, ``n_tokens``, ``n_bytes`` (byte-fallback tokens), ``parity`` (both libraries gave the
    same ids), ``decoded`` (the ids as text), ``round_trip`` (the decoded text is the text).
    """
    data = read_model(model)
    rest = [c for c in df.columns if c.lower() not in outputs and (keep_text or c != text)]
    schema = T.StructType([f for f in df.schema.fields if f.name in rest] + [T.StructField(o, OUT[o]) for o in outputs])
    source = free_name(df, "_encoded_text")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, byte_ids, _ = _loaded(data)
        for frame in frames:
            texts = ["" if t is None else t for t in frame.pop(source)]
            at = 0
            for ids, agree in encode_batch(data, texts, threads):
                part, block = frame.iloc[at : at + len(ids)], texts[at : at + len(ids)]
                at += len(ids)
                made = {"ids": ids, "parity": agree, "n_tokens": [len(x) for x in ids]}
                if "n_bytes" in outputs:
                    made["n_bytes"] = [sum(map(byte_ids.__contains__, x)) for x in ids]
                if "decoded" in outputs or "round_trip" in outputs:
                    made["decoded"] = decode_batch(data, ids)
                    made["round_trip"] = [x == y for x, y in zip(made["decoded"], block, strict=True)]
                yield part.assign(**{o: made[o] for o in outputs})

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(source)).mapInPandas(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of a column of ids; null ids give a null text."""
    data = read_model(model)
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [None if x is None else list(x) for x in frame[ids]]
            texts = iter(decode_batch(data, [x for x in lists if x is not None]))
            frame = frame.drop(columns=out, errors="ignore")
            yield frame.assign(**{out: [None if x is None else next(texts) for x in lists]})

    return df.mapInPandas(run, schema)
