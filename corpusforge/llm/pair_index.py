"""Byte-level BPE by a pair occurrence index over the pieces of an Arrow slice.

A vocabulary file of the ``tokenizers`` library is read once on the driver.  A task cuts
the texts of a slice into pieces (the byte-level pattern; added tokens are cut out first)
and lays the bytes of all pieces that its worker has not met yet into one line of symbols.
Each mergeable pair is listed with all the places where it stands.  The ranks that
are active are taken in ascending order; a rank is applied to all its places in the slice, left to
right, and the places where a merge makes a new pair are added to that pair's list, which
makes its rank active.  A pair with the product of a merge never has a smaller rank than
the merge (checked when the file is read), so this is the order in which each piece
alone would be merged.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusforge.llm.bpe_codec import byte_chars, latin1_pattern
from corpusforge.llm.common import in_arrow, slices

# Distinct pieces whose ids a Python worker keeps at hand.
PIECES = 300_000
# What the byte-level pre-tokenizer calls white space, and its pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+")
# End of a piece in the line of symbols, and a symbol that was merged into the one before it.
_END, _GONE = -1, -2


class Vocabulary:
    """Merges and tokens of a byte-level BPE file; other kinds of tokenizers raise ``ValueError``."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if (model["type"] != "BPE" or spec["normalizer"] or spec["post_processor"] or model["dropout"] or model["continuing_subword_prefix"]
                or model["end_of_word_suffix"] or model.get("ignore_merges") or cut["type"] != "ByteLevel" or cut["add_prefix_space"]
                or not cut["use_regex"] or spec["decoder"]["type"] != "ByteLevel" or not plain):
            raise ValueError("not a plain byte-level BPE vocabulary")
        back = {c: b for b, c in enumerate(byte_chars())}
        ids = model["vocab"]
        self.text = text
        self.byte_ids = [ids[c] for c in byte_chars()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, product)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        made: dict[int, int] = {}
        for rank, product in self.ranks.values():
            made[product] = max(rank, made.get(product, rank))
        if any(made.get(x, -1) > rank for pair, (rank, _) in self.ranks.items() for x in pair):
            raise ValueError("a merge comes before the merge that makes one of its parts")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.added.values()], default=-1) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())


class PairIndex:
    """The places of every mergeable pair in a line of symbols, and the ranks that are active.

    ``symbols``: ids of bytes, each piece closed by ``_END``.
    """

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]], pairs: dict[int, tuple[int, int, int]]):
        self.symbols, self.ranks, self.pairs = symbols, ranks, pairs  # pairs: rank -> (left, right, product)
        self.after = list(range(1, len(symbols) + 1))
        self.before = list(range(-1, len(symbols) - 1))
        self.places: dict[int, list[int]] = {}  # by rank, which stands for its pair
        places = self.places
        for i, found in enumerate(map(ranks.get, zip(symbols, symbols[1:]))):
            if found is not None:
                if found[0] in places:
                    places[found[0]].append(i)
                else:
                    places[found[0]] = [i]
        self.active = list(places)
        heapq.heapify(self.active)

    def add(self, place: int, rank: int) -> None:
        """A pair that a merge has made, at the place of its left symbol."""
        if rank in self.places:
            self.places[rank].append(place)
        else:
            self.places[rank] = [place]
            heapq.heappush(self.active, rank)

    def apply(self, rank: int) -> None:
        """Merge the pair of ``rank`` wherever it still stands, left to right; its list is used up."""
        a, b, product = self.pairs[rank]
        symbols, after, before, known = self.symbols, self.after, self.before, self.ranks.get
        for i in sorted(self.places.pop(rank)):
            if symbols[i] != a:
                continue
            j = after[i]
            if symbols[j] != b:
                continue
            symbols[i], symbols[j] = product, _GONE
            k = after[j]
            after[i] = k
            before[k] = i
            found = known((product, symbols[k]))
            if found is not None:
                self.add(i, found[0])
            h = before[i]
            if h >= 0:
                found = known((symbols[h], product))
                if found is not None:
                    self.add(h, found[0])

    def merge(self) -> list[list[int]]:
        """Every active rank in ascending order; the ids of each piece."""
        while self.active:
            self.apply(heapq.heappop(self.active))
        out, piece = [], []
        for s in self.symbols:
            if s == _END:
                out.append(piece)
                piece = []
            elif s != _GONE:
                piece.append(s)
        return out


class Encoder:
    """Texts to ids in one Python worker; the ids of the last ``PIECES`` distinct pieces, or up to twice as many, are kept."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.pairs = {rank: (*pair, product) for pair, (rank, product) in vocabulary.ranks.items()}
        self.find_any = regex.compile(PATTERN).findall
        simple = latin1_pattern(PATTERN.replace(r"  -     　", "").replace(r"\t-\r", r"\x09-\x0d"))
        self.find_latin1 = re.compile(simple).findall if simple else self.find_any
        self.cut = Tokenizer.from_str(vocabulary.text).pre_tokenizer.pre_tokenize_str
        by_length = sorted(vocabulary.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if by_length else None
        self.agrees: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _as_library(self, char: str) -> bool:
        """Whether the pattern puts a character into the class that the library puts it in."""
        probe = f"a{char}1{char}!{char} {char}{char} b"
        return self.find_any(probe) == [probe[i:j] for _, (i, j) in self.cut(probe)]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without added tokens."""
        try:
            text.encode("latin-1")
            return self.find_latin1(text)
        except UnicodeEncodeError:
            pass
        agrees = self.agrees
        for c in set(text):
            if c not in agrees:
                agrees[c] = self._as_library(c)
            if not agrees[c]:  # the Unicode versions differ: the library cuts this text
                return [text[i:j] for _, (i, j) in self.cut(text)]
        return self.find_any(text)

    def learn(self, pieces: set[str]) -> None:
        """Merge pieces that are not known yet, all in one index."""
        new = list(pieces)
        byte_ids = self.vocabulary.byte_ids
        line: list[int] = []
        for p in new:
            line.extend(map(byte_ids.__getitem__, p.encode()))
            line.append(_END)
        for p, ids in zip(new, PairIndex(line, self.vocabulary.ranks, self.pairs).merge(), strict=True):
            self.known[p] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        added = self.vocabulary.added
        parts = []
        for t in texts:
            if self.split_added and any(a in t for a in added):
                found = self.split_added(t)
                parts.append([x for i, s in enumerate(found) for x in ([added[s]] if i % 2 else self.pieces(s))])
            else:
                parts.append(self.pieces(t))
        if len(self.known) > PIECES:
            self.known, self.before = {}, self.known
        wanted = set().union(*parts).difference(self.known)
        for x in wanted & self.before.keys():
            self.known[x] = self.before[x]
            wanted.discard(x)
        for i in [x for x in wanted if isinstance(x, int)]:
            self.known[i] = np.array([i], dtype="<u4").tobytes()
            wanted.discard(i)
        if wanted:
            self.learn(wanted)
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(maxsize=2)
def _encoder(text: str) -> Encoder:
    return Encoder(_vocabulary(text))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, n_tokens``: ids as little-endian unsigned 32-bit integers, as the library encodes without special tokens.

    A null or empty text has no tokens; an added token's string in a text is that
    token, as in the library.  One row out per row in, repeated and null ids included; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(vocabulary.text)
    kind = next(f.dataType for f in docs.schema.fields if f.name == id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for b in slices(batches, 1):
            ids = encoder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                                             ["id", "ids", "n_tokens"])

    return in_arrow(rows, run, f"id {kind.simpleString()}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids, added tokens included.

    Bytes of all ids are joined before they are read as UTF-8; bytes that are no whole character
    become U+FFFD.  Null ids give null, no ids an empty text, an id outside the vocabulary is an error.
    """
    model = tokens.sparkSession.sparkContext.broadcast(vocabulary.text)
    names = [c for c in tokens.columns if c != "decoded"]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _vocabulary(model.value).tokens
        for b in slices(batches, at):
            out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, dtype="<u4").tolist())).decode("utf-8", "replace")
                   for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    rows = tokens.select(*names)
    return in_arrow(rows, run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def decimal_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: digests of the comma-joined decimal ids and of the decoded text."""
    both = decode(encode(docs, vocabulary, id_col, text_col), vocabulary)
    rows = both.select(F.col(id_col).alias("id"), "n_tokens", "ids", "decoded")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for b in batches:
            joined = [",".join(map(str, np.frombuffer(x, dtype="<u4").tolist())).encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in b.column(3).to_pylist()])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(rows, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
