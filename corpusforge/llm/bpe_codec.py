"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

The rank file (base64 token, rank per line) is turned into a byte-level BPE model:
each byte stands for one printable character, every way of splitting a token into two
tokens becomes a merge, and merges are ordered by the rank of their result.  Texts are
encoded in Arrow batches; ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import in_arrow, slices

# Distinct pieces whose ids a Python worker keeps at hand.
PIECES = 200_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in kept else spare))
        spare += b not in kept
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, map(bytes.strip, f)))}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The model as the library's JSON; ``pattern`` cuts the text into the pieces that are merged."""
    chars = byte_chars()

    def shown(token: bytes) -> str:
        return "".join(chars[b] for b in token)

    merges = []
    for token, rank in ranks.items():
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(rank, ranks[a], ranks[b], shown(a), shown(b)) for a, b in cuts]
    merges.sort()
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                  "vocab": {shown(t): r for t, r in ranks.items()}, "merges": [[a, b] for *_, a, b in merges]}})


class Codec:
    """The model as text, which Python workers build once, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = tokenizer_json(ranks, pattern)
        self.pattern = pattern
        self.tokens = token_bytes(json.loads(self.model)["model"]["vocab"])

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        return cls(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _tokenizer(model: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def latin1_pattern(pattern: str) -> str | None:
    """``pattern`` for the standard library, equal to it on texts of U+0000 to U+00FF; None if it can't be said so."""
    import regex

    def ranges(name: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))

    out, in_class = [], False
    for part in regex.findall(r"\\[pP]\{\w+\}|\\.|[^\\]", pattern, flags=regex.S):
        if part in ("[", "]"):
            in_class = part == "["
        if part.startswith(("\\p", "\\P")) or part in ("\\s", "\\S"):
            part = ranges(part) if in_class else f"[{ranges(part)}]"
        elif part.startswith("\\") and part[1:].isalpha():
            return None
        out.append(part)
    return "".join(out)


class Pieces:
    """Ids of the pieces that the pattern cuts a text into, each distinct piece merged once.

    The library merges a piece; the ids of the last ``PIECES`` distinct pieces are kept, so that words
    that come back cost one look-up.
    """

    def __init__(self, model: str, pattern: str):
        import regex

        self.find_any = regex.compile(pattern).findall
        simple = latin1_pattern(pattern)
        self.find_latin1 = re.compile(simple).findall if simple else self.find_any
        self.merge = _tokenizer(model).model.tokenize
        self.shown = dict(enumerate(byte_chars()))
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            pieces = self.find_latin1(text)
        except UnicodeEncodeError:
            pieces = self.find_any(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > PIECES:
                known.clear()
        for p in pieces:
            if p not in known:
                chars = p.encode().decode("latin-1").translate(self.shown)
                known[p] = np.array([t.id for t in self.merge(chars)], dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def _pieces(model: str, pattern: str) -> Pieces:
    return Pieces(model, pattern)


def token_bytes(vocab: dict[str, int]) -> list[bytes]:
    """Bytes of each id: the byte table in reverse, character by character."""
    back = {c: b for b, c in enumerate(byte_chars())}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col, ids, n_tokens`` (and ``starts, ends``): ids as little-endian unsigned 32-bit integers.

    With ``offsets``, ``starts`` and ``ends`` give the characters of the text that each
    token lies in; a character split over several tokens is within each of them.  A null
    text counts as empty and gives no tokens; special tokens' strings are ordinary text.
    One row out per row in, whatever the ids; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((codec.model, codec.pattern))
    kind = next(f.dataType for f in docs.schema.fields if f.name == id_col)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(*model.value)
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            if offsets:
                t = _tokenizer(model.value[0])
                found = [t.encode(x, add_special_tokens=False) for x in texts]
                ids = [np.array(e.ids, dtype="<u4").tobytes() for e in found]
            else:
                ids = [pieces.ids(x) for x in texts]
            cols = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
            names = ["id", "ids", "n_tokens"]
            if offsets:
                cols += [pa.array([[o[k] for o in e.offsets] for e in found], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = in_arrow(rows, run, f"id {kind.simpleString()}, ids binary, n_tokens bigint{extra}")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes that the ids stand for.

    Null ids give null, no ids give no bytes.  An id outside the vocabulary is an error.
    Characters split over tokens come together again as their bytes are joined before
    anything is read as text; see ``decoded_text`` for ids that end inside a character.
    """
    table_of = tokens.sparkSession.sparkContext.broadcast(codec.tokens)
    rest = [F.col(c) for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*rest).schema.add("decoded", "binary")
    at = [c for c in tokens.columns if c != "decoded"].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of.value
        for b in slices(batches, at):
            out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, dtype="<u4").tolist()))
                   for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return in_arrow(tokens.select(*rest), run, schema)


def decoded_text(data: bytes) -> str:
    """Bytes as text; bytes of a character that is not whole become U+FFFD."""
    return data.decode("utf-8", errors="replace")
