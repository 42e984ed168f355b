"""Format-preserving pseudonyms for validated numbers and dates.

A keyed Feistel network permutes the values of each kind within their own format: card
numbers keep their length and a right check digit, IBANs their country and layout,
addresses and telephone numbers their shape, dates stay dates.  A value and its
pseudonym are one to one under a key, so equal values stay equal across documents, and
the key holder can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import in_arrow, slices

ROUNDS = 8
# Characters of an IBAN, by country.
IBAN_LENGTH = {c: int(n) for n, line in (x.split(":") for x in """15:NO;16:BE;18:DK FI FO GL NL SD FK;19:MK SI;20:AT BA EE KZ LT LU MN XK
    ;21:CH HR LI LV;22:BG BH CR DE GB GE IE ME RS VA;23:AE GI IL IQ OM TL SO;24:AD CZ ES MD PK RO SA SE SK TN VG;25:LY PT ST
    ;26:IS TR;27:BI DJ FR GR IT MC MR SM;28:AL AZ BY CY DO GT HN HU LB NI PL SV;29:BR EG PS QA UA;30:JO KW MU YE;31:MT SC;32:LC
    ;33:RU""".split(";")) for c in line.split()}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class Feistel:
    """Keyed permutations of ``range(size)``, one per kind of value; results are kept for reuse."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, int, int, bool], int] = {}

    def _round(self, kind: str, size: int, i: int, half: int, mod: int) -> int:
        digest = hmac.new(self.key, f"{kind}|{size}|{i}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") % mod

    def _once(self, kind: str, size: int, a: int, b: int, value: int, back: bool) -> int:
        """One pass over ``range(a * b)``: the halves take turns in being shifted by a function of the other."""
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._round(kind, size, i, right, a)) % a
            else:
                right = (right + sign * self._round(kind, size, i, left, b)) % b
        return left * b + right

    def permute(self, kind: str, value: int, size: int, valid: Callable[[int], bool] | None = None, back: bool = False,
                context: tuple = ()) -> int:
        """The image of ``value``; walks on until the image is in range and valid (``value`` must be both).  ``context``: what ``valid`` depends on."""
        if size < 2:
            return value
        seen = (kind, size, value, back, context)
        if seen not in self.known:
            a = int(size ** 0.5) or 1
            while a * a < size:
                a += 1
            b = -(-size // a)
            out = self._once(kind, size, a, b, value, back)
            while out >= size or valid and not valid(out):
                out = self._once(kind, size, a, b, out, back)
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[seen] = out
        return self.known[seen]


def luhn_digit(payload: str) -> str:
    """The check digit that makes ``payload`` and itself a valid card number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def card(f: Feistel, text: str, back: bool = False, behind: tuple[str, ...] = ()) -> str | None:
    """13 to 19 digits with a right check digit (not all the same): all but the check digit are permuted.

    ``behind``: digits that stand behind it and do not make a longer card number with it; nor do they with the pseudonym.
    """
    d = _digits(text)
    if not _is_card(d):
        return None

    def varied(x: int) -> bool:
        p = f"{x:0{len(d) - 1}d}"
        p += luhn_digit(p)
        return len(set(p)) > 1 and not any(_is_card(p + more) for more in behind)
    p = f"{f.permute('card', int(d[:-1]), 10 ** (len(d) - 1), varied, back, behind):0{len(d) - 1}d}"
    return _fill(text, p + luhn_digit(p))


def card_in(f: Feistel, text: str, begin: int, end: int, back: bool) -> tuple[str | None, int]:
    """The pseudonym of the longest card number that begins at ``begin`` and ends at a blank or hyphen before ``end`` or there, and its
    end; else None and where the next number begins."""
    ends = [end, *(i for i in range(end - 1, begin, -1) if text[i] in " -")]
    behind: list[str] = []
    for e in ends:
        out = card(f, text[begin:e], back, tuple(_digits(text[e:x]) for x in behind))
        if out is not None:
            return out, e
        behind.append(e)
    return None, ends[-1] + 1 if len(ends) > 1 else end


def iban(f: Feistel, text: str, back: bool = False) -> str | None:
    """A valid IBAN, all in capitals or all in small letters: the account's digits and its letters are permuted, the country stays."""
    plain = text.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or plain[2:4] != iban_digits(plain[:2], plain[4:]):
        return None
    account = plain[4:]
    d, a = _digits(account), "".join(c for c in account if c.isalpha())
    shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", account))
    new_d = iter(f"{f.permute('iban' + plain[:2] + shape, int(d), 10 ** len(d), None, back):0{len(d)}d}" if d else "")
    value = 0
    for c in a:
        value = value * 26 + ord(c) - 65
    value, new_a = f.permute("iban letters" + plain[:2] + shape, value, 26 ** len(a), None, back), []
    for _ in a:
        value, r = divmod(value, 26)
        new_a.append(chr(65 + r))
    letters = iter(reversed(new_a))
    account = "".join(next(new_d) if c.isdigit() else next(letters) for c in account)
    new = iter(plain[:2] + iban_digits(plain[:2], account) + account)
    out = "".join(c if c == " " else next(new) for c in text)
    return out.lower() if text[0].islower() else out


def iban_end(text: str, at: int, end: int) -> int:
    """Where the IBAN that begins at ``at`` ends by its country's length, if words or numbers behind it were read up to ``end``."""
    left = IBAN_LENGTH.get(text[at:at + 2].upper())
    for i in range(at, end):
        if left == 0:
            return i
        if left is not None and text[i] != " ":
            left -= 1
    return end


def social(f: Feistel, text: str, back: bool = False) -> str | None:
    """A nine-digit social security number: area not 000, 666 or from 900 on, no part all zeros."""
    def valid(x: int) -> bool:
        return x // 10 ** 6 not in (0, 666) and x // 10 ** 6 < 900 and x // 10 ** 4 % 100 > 0 and x % 10 ** 4 > 0
    value = int(_digits(text))
    return _fill(text, f"{f.permute('social', value, 10 ** 9, valid, back):09d}") if valid(value) else None


def phone(f: Feistel, text: str, back: bool = False) -> str | None:
    """A ten-digit telephone number, with or without the country's 1 in front.  Area codes are not checked: numbers that no exchange
    gives out are written down as people's numbers all the same."""
    d = _digits(text)
    return _fill(text, d[:-10] + f"{f.permute('phone', int(d[-10:]), 10 ** 10, None, back):010d}")


def address(f: Feistel, text: str, back: bool = False) -> str | None:
    """An IPv4 address: four numbers up to 255, none written with a leading zero."""
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = f.permute("address", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, None, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(f: Feistel, text: str, back: bool = False) -> str | None:
    """A day from 1900 to 2099 as year-month-day, day.month.year or month/day/year; the same day in any form has one pseudonym.

    Where the first number of a slashed date can be no month it is the day; its pseudonym is a day that can be no month, too.
    """
    parts = re.split(r"[-./]", text)
    order = {"-": (0, 1, 2), "/": (2, 0, 1), ".": (2, 1, 0)}[next(c for c in text if not c.isdigit())]
    late = None
    if "/" in text and int(parts[0]) > 12:
        order = (2, 1, 0)

        def late(x: int) -> bool:
            return datetime.date.fromordinal(x + _FIRST_DAY).day > 12
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(f.permute("date", day, _DAYS, late, back, ("late",) if late else ()) + _FIRST_DAY)
    out = [""] * 3
    for i, v in zip(order, (new.year, new.month, new.day), strict=True):
        out[i] = f"{v:04d}" if i == order[0] else f"{v:02d}"
    sep = next(c for c in text if not c.isdigit())
    return sep.join(out)


KINDS = {
    "iban": (iban, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?"),
    "date": (date, r"(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]\d\.[01]\d\.(?:19|20)\d\d|[0-3]\d/[0-3]\d/(?:19|20)\d\d"),
    "address": (address, r"\d{1,3}(?:\.\d{1,3}){3}"),
    "phone": (phone, r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"),
    "social": (social, r"\d{3}-\d{2}-\d{4}"),
    "card": (card, r"\d(?:[ -]?\d){12,18}"),
}
# a value does not begin or end inside a longer word or number
_END = r"(?![\w]|[-./,]\d)"
# a date may have a time of day behind it
_DATE_END = r"(?!(?!T\d\d:?\d\d)[\w]|[-./,]\d)"
_ALL = "|".join(f"(?P<{k}>{p}){_DATE_END if k == 'date' else _END}" for k, (_, p) in KINDS.items())
_FOUND = re.compile(rf"(?<![\w+-])(?<!\d[.,/])(?=[A-Za-z0-9+(])(?:{_ALL})", re.ASCII)
_IBAN_END = re.compile(_END, re.ASCII)
_ANY = re.compile(r"\d\d")


def pseudonymise_text(f: Feistel, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _ANY.search(text):
        return text, counts

    parts, done, at = [], 0, 0
    while m := _FOUND.search(text, at):
        kind, begin, end = m.lastgroup, m.start(), m.end()
        if kind == "iban":
            end = iban_end(text, begin, end)
        after = begin + 1 if kind == "iban" else end  # words and numbers behind what only looks like an IBAN may be values themselves
        if kind == "card":
            out, after = card_in(f, text, begin, end, back)
            end = after
        elif kind == "iban" and not _IBAN_END.match(text, end):
            out = None
        else:
            out = KINDS[kind][0](f, text[begin:end], back)
        if out is not None:
            counts[kind] += 1
            parts += [text[done:begin], out]
            done = at = end
        else:
            at = after
    return "".join([*parts, text[done:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """``id_col, text`` and ``n_<kind>`` for each kind of value, one row per document.

    Values that do not pass their check stay as they are.  ``back`` turns the pseudonyms of the same
    ``key`` into the values again.  A null text stays null with counts of 0, an empty one empty;
    repeated rows get the same result, null ids pass through, an empty table gives an empty
    result; other columns are ignored.  The permutation needs no state, so a task that runs
    again after a loss gives the same text.
    """
    secret = docs.sparkSession.sparkContext.broadcast(key)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("none"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string, " + ", ".join(f"n_{k} bigint" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret.value)
        for b in slices(batches, 1):
            done = [pseudonymise_text(f, t, back) for t in b.column(1).to_pylist()]
            texts = [None if none else t for (t, _), none in zip(done, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS)],
                                             ["id", "text", *(f"n_{k}" for k in KINDS)])

    return in_arrow(rows, run, schema).withColumnRenamed("id", id_col)
