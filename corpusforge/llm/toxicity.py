"""Toxicity scores behind a noisy-channel deobfuscation.

A character language model (4-grams, counted by Spark over *all* documents) and a small
channel model (look-alike characters, masked letters, spaced-out and repeated letters)
restore obfuscated words: each suspicious span becomes a lattice of readings, and a
Viterbi search takes the likeliest.  The restored text is scored by a logistic model on
words and word beginnings, learnt from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import words
from corpusforge.llm.common import in_arrow, slices, stored, text_buffer
from corpusforge.llm.quality import learnable

CODES = 28  # 0: no letter, 1 to 26: a to z, 27: any other letter
ORDER = 4
MAX_TRAIN = 20_000
# Candidate features are those of at least MIN_DOCS toxic training rows, at most so many.
MIN_DOCS = 5
MAX_CANDIDATES = 1 << 16
MAX_FEATURES = 4096
PREFIXES = (4, 5, 6, 7, 8)

# Which letters a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c"}
MASKS = "*#%&?"
# Symbols that may stand for letters at a word's end, where they may also be punctuation.
TAIL = "".join(c for c in LOOKALIKES if not c.isdigit()) + MASKS
# Longer runs of masks are lines and rules, not words.
MAX_MASKED = 24
GAPS = " \t.-_~"
# Costs of the channel, as natural logarithms.
SWAPPED, MASKED, UNMASKED, REPEATED, SPACED, WORD_END = -0.7, -1.0 - math.log(26), -2.0, -0.5, -0.2, -1.5
_LETTERS = words.text_classes()
_CODE = np.zeros(256, dtype=np.int64)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0x80:] = 27
_SWAP = np.zeros(256, dtype=bool)
_SWAP[[ord(c) for c in [*LOOKALIKES, *MASKS]]] = True
_MASK = np.zeros(256, dtype=bool)
_MASK[[ord(c) for c in MASKS]] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in GAPS]] = True
_WORDS = np.where(_LETTERS == words.LETTER, 1, 0).astype(np.uint8)


def gram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all 4-grams of character codes, over all documents; words are padded with code 0."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES ** ORDER, dtype=np.int64)
        for b in slices(batches, 0):
            data, offsets = text_buffer(b.column(0))
            w = words.split(data, offsets, _WORDS)
            # each word with three zeros in front and one behind
            size = w.length + ORDER
            begin = np.concatenate([[0], np.cumsum(size)])
            codes = np.zeros(begin[-1], dtype=np.int64)
            inside = np.arange(w.length.sum()) - np.repeat(np.cumsum(w.length) - w.length, w.length)
            codes[np.repeat(begin[:-1] + ORDER - 1, w.length) + inside] = _CODE[data[np.repeat(w.start, w.length) + inside]]
            if len(codes) >= ORDER:
                gram = ((codes[:-3] * CODES + codes[1:-2]) * CODES + codes[2:-1]) * CODES + codes[3:]
                total += np.bincount(gram, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    out = np.zeros(CODES ** ORDER)
    for r in in_arrow(rows, run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n  # at most CODES ** ORDER rows
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of each code after three others; lower orders fill in where there is little evidence."""
    four = counts.reshape((CODES,) * ORDER).astype(float)
    p = np.full(CODES, 1 / CODES)
    for order in range(1, ORDER + 1):
        c = four.sum(axis=tuple(range(ORDER - order))) if order < ORDER else four
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        total = c.sum(axis=-1, keepdims=True)
        weight = np.where(total > 0, total / np.maximum(total + kinds, 1), 0)  # Witten and Bell
        p = weight * c / np.maximum(total, 1) + (1 - weight) * p
    return np.log(p).astype(np.float32)


class Decoder:
    """Viterbi search over the readings of a span."""

    def __init__(self, log_probs: np.ndarray):
        self.table = log_probs.reshape(-1, CODES).astype(float)
        self.logp = self.table.tolist()
        self.ends: list[tuple[np.ndarray, np.ndarray]] = [(self.table[:, 0], np.zeros(len(self.table), dtype=np.int64))]
        self.restore = lru_cache(maxsize=50_000)(self._restore)

    @staticmethod
    def lattice(span: str) -> list[list[tuple[tuple[int, ...], float, str]]]:
        """For each run of a character, its readings: letter codes with the channel's log probability and the text they stand for."""
        slots: list[list[tuple[tuple[int, ...], float, str]]] = []
        plain = "".join(c for c in span if c not in GAPS)
        spaced = len(span) > len(plain) and len(plain) > 1
        if spaced:
            for c in GAPS:  # one gap character in place of several
                while c + c in span:
                    span = span.replace(c + c, c)
        at, tail = 0, len(span.rstrip(TAIL))
        while at < len(span):
            c, start, end = span[at], at, at + 1
            while end < len(span) and span[end] == c:
                end += 1
            n, at = end - at, end
            if c.isalpha():  # a letter that is not ASCII has a code for each of its bytes, and stays itself
                letters, cost = [(c, (ord(c) - 96,) if c.isascii() else (27,) * len(c.encode("utf-8", errors="replace")))], 0.0
            elif c in LOOKALIKES:
                letters, cost = [(x, (ord(x) - 96,)) for x in LOOKALIKES[c]], SWAPPED
            elif c in GAPS:
                slots.append([((), SPACED, ""), ((0,), WORD_END, c * n)])
                continue
            elif c in MASKS:
                slots += [[((x,), MASKED, chr(96 + x)) for x in range(1, 27)] + [((), UNMASKED, c if start >= tail else "")]] * n
                continue
            else:
                slots += [[((27,), 0.0, c)]] if n == 1 else [[((27,), 0.0, c)], [((27,), 0.0, c * (n - 1))]]
                continue
            slot = [(x, cost * min(n, 2) + (REPEATED if n > 1 else 0.0), t) for t, x in letters]
            if n > 1:
                slot += [(x + x, cost * 2 + (0.0 if n == 2 else REPEATED), t + t) for t, x in letters]
            if start >= tail:
                slot.append(((), UNMASKED, c * n))
            slots.append(slot)
        return slots

    def _to_end(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 0 to ``n`` masks at a word's end: each state's best log probability, and the letter read first (0: none)."""
        while len(self.ends) <= n:
            after = (np.arange(CODES ** 3) % CODES ** 2 * CODES)[:, None] + np.arange(1, 27)
            value = self.ends[-1][0]
            both = np.concatenate([(UNMASKED + value)[:, None], MASKED + self.table[:, 1:27] + value[after]], axis=1)
            self.ends.append((both.max(axis=1), both.argmax(axis=1)))
        return self.ends

    def _masked(self, best: dict[int, tuple[float, tuple]], slot: list[tuple[tuple[int, ...], float, str]]) -> dict[int, tuple[float, tuple]]:
        """One step over a masked letter from many states."""
        states, paths = np.array(list(best)), [path for _, path in best.values()]
        score = np.array([x for x, _ in best.values()])
        to = np.concatenate([((states % CODES ** 2) * CODES)[:, None] + np.arange(1, 27), states[:, None]], axis=1).ravel()
        total = np.concatenate([score[:, None] + MASKED + self.table[states, 1:27], score[:, None] + UNMASKED], axis=1).ravel()
        order = np.lexsort((-total, to))
        first = order[np.concatenate([[True], np.diff(to[order]) > 0])]
        return {s: (x, (paths[i // 27], slot[i % 27][0], slot[i % 27][2], True) if slot[i % 27][0] else paths[i // 27])
                for s, x, i in zip(to[first].tolist(), total[first].tolist(), first.tolist(), strict=True)}

    def _restore(self, span: str) -> str:
        """The likeliest reading in lower case, or the span itself if no reading beats random letters."""
        logp, square = self.logp, CODES * CODES
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        masks = span[len(span.rstrip(MASKS)):]  # at the end; their best readings hang on the state alone
        slots = self.lattice(span)
        for slot in slots[:len(slots) - len(masks)]:
            if len(slot) == 27 and not slot[26][2] and len(best) > 50:
                best = self._masked(best, slot)
                continue
            after: dict[int, tuple[float, tuple]] = {}
            for state, (score, path) in best.items():
                for codes, cost, text in slot:
                    s, total = state, score + cost
                    for c in codes:
                        total += logp[s][c]
                        s = 0 if c == 0 else s % square * CODES + c
                    if s not in after or after[s][0] < total:
                        after[s] = (total, (path, codes, text, cost == MASKED) if codes or text else path)
            best = after
        ends = self._to_end(len(masks))
        score, trail, s = max(((score + ends[len(masks)][0][s], path, s) for s, (score, path) in best.items()), key=lambda x: x[0])
        for left, mask in zip(range(len(masks), 0, -1), masks, strict=True):
            c = int(ends[left][1][s])
            trail = (trail, (c,) if c else (), chr(96 + c) if c else mask, c > 0)
            s = s % square * CODES + c if c else s
        out, least = [], 0.0
        while trail:
            trail, codes, text, masked = trail
            out.append(text)
            least += masked * MASKED - len(codes) * math.log(CODES)  # random letters behind as many masks
        return "".join(reversed(out)) if score > least else span


def suspicious(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans (first byte, end) of a buffer that may be obfuscated, in order and apart from each other."""
    if not len(data):
        return []
    w = words.split(data, offsets, _LETTERS)
    end = w.start + w.length
    letter = w.kind == words.LETTER
    other, short = ~letter, w.length <= 3
    # runs whose first or last character may stand for a letter
    opens = other & (short & _SWAP[data[w.start]] | (w.length <= MAX_MASKED) & _MASK[data[w.start]])
    closes = other & (short & _SWAP[data[end - 1]] | (w.length <= MAX_MASKED) & _MASK[data[end - 1]])
    touch = np.zeros(len(end), dtype=bool)  # the next run begins where this one ends
    touch[:-1] = (w.start[1:] == end[:-1]) & (w.doc[1:] == w.doc[:-1])
    ends = ~touch  # nothing but punctuation follows in the word
    ends[:-1] |= (w.kind[1:] == words.SYMBOL) & ~touch[1:]
    hit = np.zeros(len(end), dtype=bool)
    if len(end) > 1:
        # a look-alike or mask in front of a letter, or a symbol behind one; a digit at the end
        hit[:-1] |= (opens | closes)[:-1] & letter[1:] & touch[:-1]
        hit[1:] |= opens[1:] & ((w.kind[1:] == words.SYMBOL) | ends[1:]) & letter[:-1] & touch[:-1]
    # runs of one letter three times, or three letters doubled
    twice = np.zeros(len(data), dtype=np.int64)
    twice[1:] = data[1:] == data[:-1]
    thrice = twice.copy()
    thrice[1:] &= twice[:-1]
    for marks, least, first in ((thrice, 1, 2), (twice, 3, 1)):
        sums = np.concatenate([[0], np.cumsum(marks)])
        hit |= letter & (w.length > first) & (sums[end] - sums[np.minimum(w.start + first, end)] >= least) & (data[w.start] < 0x80)
    # a hit stands for its whole word, up to the white space around it
    begins = np.concatenate([[True], ~touch[:-1]])
    word = np.cumsum(begins) - 1
    first, last = np.flatnonzero(begins), np.append(np.flatnonzero(begins)[1:], len(end)) - 1
    spans = [(int(w.start[first[i]]), int(end[last[i]])) for i in np.unique(word[hit])]
    # three or more single characters with gaps between them, not digits and symbols alone
    gap = (w.kind == words.SYMBOL) & _GAP[data[w.start]] & (w.length <= 2)
    real = np.flatnonzero(~gap)
    if len(real) > 2:
        one = (w.length[real] == 1) & ((data[w.start[real]] < 0x80) & letter[real] | other[real] & _SWAP[data[w.start[real]]])
        apart = w.start[real][1:] - end[real][:-1]
        near = one[1:] & one[:-1] & (apart >= 1) & (apart <= 3) & (w.doc[real][1:] == w.doc[real][:-1])
        near &= ~np.isin(data[end[real][:-1]], (0x0A, 0x0D))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= 3 or b - a == 2 and letter[real[a:b + 1]].any():
                spans.append((int(w.start[real[a]]), int(end[real[b]])))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_EDGE = ".,;:!?\"'()[]{}<>#*%&$-_~/\\"


def restored(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with every suspicious span replaced by its restored reading."""
    raw, parts, at, grown, moved = data.tobytes(), [], 0, 0, []
    for a, b in suspicious(data, offsets):
        span = raw[a:b].decode("utf-8", errors="replace").lower()
        core = span.rstrip(_EDGE)
        behind = span[len(core):]
        core += behind[:len(behind) - len(behind.lstrip(TAIL))]  # may be letters or punctuation
        core = core.lstrip(_EDGE.replace("$", "").replace("!", "").replace("(", ""))
        new = span if len(core) < 2 else span.replace(core, decoder.restore(core), 1)
        if new == span:
            continue
        new = new.encode("utf-8", errors="replace")
        parts += [raw[at:a], new]
        at = b
        grown += len(new) - (b - a)
        moved.append((b, grown))
    if not moved:
        return data, offsets
    parts.append(raw[at:])
    ends = np.array([m[0] for m in moved])
    shift = np.concatenate([[0], [m[1] for m in moved]])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets + shift[np.searchsorted(ends, offsets, side="right")]


def _feature_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) arrays: whole words, then their beginnings of each length."""
    w = words.split(data, offsets, _WORDS)
    yield w.doc, w.code
    for n in PREFIXES:
        long = w.length > n
        part = words.Words(w.doc[long], w.start[long], w.length[long], w.kind[long], w.code[long], w.sums)
        yield part.doc, part.prefix(n)


def _matches(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index in the sorted ``keys``) pairs of the features found."""
    found = [np.zeros(0, dtype=np.int64)]
    for doc, code in _feature_codes(data, offsets):
        maybe = np.flatnonzero(sieve[(code & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(keys):
            at = np.minimum(np.searchsorted(keys, code[maybe]), len(keys) - 1)
            same = keys[at] == code[maybe]
            found.append(np.unique(doc[maybe[same]] * len(keys) + at[same]))
    both = np.unique(np.concatenate(found))
    return both // max(1, len(keys)), both % max(1, len(keys))


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, dtype=bool)
    out[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def _fit(lists: list[np.ndarray], y: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, with a penalty on the squared weights."""
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *lists]).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    p = [np.zeros(n), np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        margin = np.bincount(row, weights=p[0][flat], minlength=len(lists)) + p[1]
        e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        grads = [np.bincount(flat, weights=e[row], minlength=n) + 2e-5 * p[0], e.sum(keepdims=True)]
        for a, g, m, v in zip(p, grads, first, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[0], float(p[1][0])


def restore(docs: DataFrame, log_probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text``: every document with its suspicious spans restored (null text: empty)."""
    model = docs.sparkSession.sparkContext.broadcast(log_probs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for b in slices(batches, 1):
            data, offsets = restored(*text_buffer(b.column(1)), decoder)
            text = pa.Array.from_buffers(pa.utf8(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), text], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          parts: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """``id_col, held_out, score``, one row per document; the score is that of label 1.

    Only labels of ids with ``crc32(id) mod parts <> held`` are learnt, at most ``max_train``
    of them (those with the smallest hash of the id).  Null and empty texts get the score
    of a text without any feature; null labels are ignored and of several labels of an id the
    largest counts; null ids are never learnt and count as held out; repeated rows are scored alike.
    Without labels the score is 0.5, with labels of one class that class's smoothed
    share.  An empty table gives an empty result; other columns are never read.
    """
    context = docs.sparkSession.sparkContext
    log_probs = log_model(gram_counts(docs, text_col))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .filter(F.col("label").isNotNull() & learnable(F.col(id_col), parts, held))
             .groupBy("id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(max_train))
    clean = restore(docs, log_probs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most max_train labels
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    sample = stored(restore(picked, log_probs, "id", "text").join(F.broadcast(known), "id"), "toxic-sample")
    kind = sample.schema["id"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            for doc, code in _feature_codes(*text_buffer(b.column(0))):
                _, first = np.unique(code + words.mix(doc), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64))], ["code"])

    candidates = (in_arrow(sample.filter("label = 1").select("text"), codes, "code bigint").groupBy("code").count()
                  .filter(F.col("count") >= MIN_DOCS).orderBy(F.desc("count"), "code").limit(MAX_CANDIDATES))
    keys = np.sort(np.array([r.code for r in candidates.collect()], dtype=np.int64).view(np.uint64))
    shared = context.broadcast(keys)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _sieve(shared.value)
        for b in slices(batches, 1):
            doc, at = _matches(*text_buffer(b.column(1)), shared.value, sieve)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), found], ["id", "label", "found"])

    found = stored(in_arrow(sample.select("id", "text", F.col("label").cast("int")), lists, f"id {kind}, label int, found array<int>"), "toxic-features")
    counts = found.select("label", F.explode("found").alias("at")).groupBy("at").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")).collect()  # one row per candidate at most
    classes = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    n_pos, n_all = classes.get(1, 0), sum(classes.values())
    if not 0 < n_pos < n_all:
        keys, weights, bias = np.zeros(0, dtype=np.uint64), np.zeros(0), math.log((n_pos + 0.5) / (n_all - n_pos + 0.5))
    else:
        def gain(pos: int, n: int) -> float:  # signed root of the likelihood ratio
            e, rest = n * n_pos / n_all, n - n * n_pos / n_all
            g = pos * math.log(max(pos, 1e-9) / e) + (n - pos) * math.log(max(n - pos, 1e-9) / rest)
            return math.copysign(math.sqrt(max(g, 0.0)), pos - e)
        chosen = sorted(counts, key=lambda r: (-gain(r.pos, r.n), r["at"]))[:MAX_FEATURES]
        chosen = sorted(r["at"] for r in chosen if gain(r.pos, r.n) > 2)
        place = np.full(len(keys), -1)
        place[chosen] = np.arange(len(chosen))

        def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found_at = [place[np.array(x, dtype=np.int64)] for x in b.column(1).to_pylist()]
                lists = [x[x >= 0].astype("<i4").tobytes() for x in found_at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary())], ["label", "at"])

        # at most max_train labels, a few features each; sorted, so that sums come out alike
        rows = sorted((bytes(r["at"]), r.label) for r in in_arrow(found.select("label", "found"), chosen_only, "label int, at binary").collect())
        weights, bias = _fit([np.frombuffer(x, dtype="<i4") for x, _ in rows], np.array([y == 1 for _, y in rows], dtype=float), max(1, len(chosen)))
        keys = keys[chosen] if chosen else keys[:0]
    model = context.broadcast((keys, _sieve(keys), weights, bias))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, sieve, w, b0 = model.value
        for b in slices(batches, 1):
            doc, at = _matches(*text_buffer(b.column(1)), k, sieve)
            margin = np.bincount(doc, weights=w[at], minlength=b.num_rows) + b0 if len(at) else np.full(b.num_rows, b0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6))], ["id", "score"])

    return in_arrow(clean, scores, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (~learnable(F.col("id"), parts, held)).alias("held_out"), "score")
