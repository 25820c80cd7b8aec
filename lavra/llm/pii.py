"""Format-preserving pseudonyms of personal data.

Values are found by pattern, validated (checksum, calendar, number range), and mapped by a keyed Feistel
permutation of the set of all valid values of their format. Equal values give equal pseudonyms in every
document, different values different ones, and layout, length and validity stay.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
# Dates outside this range are left alone.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_PATTERN = re.compile(
    # A local part starts where its run of characters starts, or behind a percent escape within the run.
    r"(?P<email>(?:(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}|(?<=%[0-9A-Fa-f]{2})[A-Za-z0-9][A-Za-z0-9._+-]{0,63})"
    r"@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9]|[./-][0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<card>(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,2}(?![0-9]|[.-][0-9]))"
)
_MAYBE = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of ``range(size)``: alternating rounds on two uneven digits, walked until inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.low = max(2, int(size**0.5)) if size < 1 << 52 else 1 << (size.bit_length() + 1) // 2
        self.high = max(1, -(-size // self.low))
        self.base = hmac.new(key, tweak.encode(), hashlib.sha256)

    def _draw(self, turn: int, half: int) -> int:
        mac = self.base.copy()
        mac.update(b"%d:%d" % (turn, half))
        return int.from_bytes(mac.digest(), "big")

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            a, b = divmod(x, self.low)
            for turn in range(0, ROUNDS, 2):
                a = (a + self._draw(turn, b)) % self.high
                b = (b + self._draw(turn + 1, a)) % self.low
            x = a * self.low + b
            if x < self.size:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(shape: str, chars: str) -> str:
    """The letters and digits of ``shape`` replaced in order; marks stay."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=100_000)(self._of)
        self.feistel = lru_cache(maxsize=1024)(lambda tweak, size: Feistel(key, tweak, size))

    def _alphabet(self, tweak: str, text: str) -> str:
        """Digits to digits and letters to letters of the same case, as one number in mixed base."""
        size, value, bases = 1, 0, []
        for c in text:
            table = next((t for t in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in t), None)
            bases.append(table)
            if table:
                value, size = value * len(table) + table.index(c), size * len(table)
        kinds = "".join("-" if t is None else t[0] for t in bases)
        value = self.feistel(f"{tweak}:{kinds}", size)(value)
        out = []
        for c, table in zip(reversed(text), reversed(bases)):
            if table:
                value, at = divmod(value, len(table))
                c = table[at]
            out.append(c)
        return "".join(reversed(out))

    def _digits(self, tweak: str, digits: str, valid) -> str:
        """A digit string mapped among the valid strings of its length."""
        permute = self.feistel(f"{tweak}:{len(digits)}", 10 ** len(digits))
        while True:
            digits = str(permute(int(digits))).zfill(len(digits))
            if valid(digits):
                return digits

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the value is not valid."""
        return getattr(self, "_" + kind)(text)

    def _email(self, text):
        local, _, domain = text.rpartition("@")
        host, dot, top = domain.rpartition(".")
        # The host is permuted on its own, so addresses of one host stay together.
        return f"{self._alphabet('local', local)}@{self._alphabet('host', host.lower())}{dot}{top}"

    def _iban(self, text):
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = self._alphabet("iban:" + plain[:2], plain[4:])
        check = 98 - _iban_rest(plain[:2] + "00" + body)
        return _refill(text, f"{plain[:2]}{check:02d}{body}")

    def _date(self, text):
        parts = re.split(r"[./-]", text)
        year_first = len(parts[0]) == 4
        for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1)):
            year, month, day = (int(parts[i]) for i in order)
            try:
                at = datetime.date(year, month, day).toordinal()
            except ValueError:
                continue
            break
        else:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        size = LAST_DAY - FIRST_DAY + 1
        # The layout fixes which days can be written in it; one permutation serves all layouts.
        widths = [len(p) for p in parts]
        while True:
            at = FIRST_DAY + self.feistel("date", size)(at - FIRST_DAY)
            new = datetime.date.fromordinal(at)
            values = {order[0]: new.year, order[1]: new.month, order[2]: new.day}
            if year_first:
                written = [str(values[i]).zfill(widths[i]) for i in range(3)]
            else:
                padded = any(p.startswith("0") for p in parts[:2])
                written = [str(values[i]).zfill(2 if padded or i == 2 else 1) for i in range(3)]
            return re.sub(r"[0-9]+", lambda m, w=iter(written): next(w), text)

    def _ip(self, text):
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        value = self.feistel("ip", 1 << 32)(int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _ssn(self, text):
        def valid(d):
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = text.replace("-", "")
        return _refill(text, self._digits("ssn", digits, valid)) if valid(digits) else None

    def _card(self, text):
        digits = re.sub(r"[^0-9]", "", text)
        if not luhn(digits) or len(set(digits)) == 1:
            return None

        def checked(d):
            return d + next(c for c in string.digits if luhn(d + c))

        # The first digit, the kind of issuer, stays.
        body = self._digits("card:" + digits[0], digits[1:-1], lambda d: len(set(checked(digits[0] + d))) > 1)
        return _refill(text, checked(digits[0] + body))

    def _phone(self, text):
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        head, rest = (code[0], text[code.end() :]) if code else ("", text)
        digits = re.sub(r"[^0-9]", "", rest)
        if not 7 <= len(digits) <= 12:
            return None
        american = len(digits) == 10 and head in ("", "+1") and digits[0] > "1" and digits[3] > "1"

        def valid(d):
            return not american or d[0] > "1" and d[3] > "1"

        return head + _refill(rest, self._digits(f"phone:{american:d}", digits, valid))

    def __call__(self, text: str):
        """The text with pseudonyms, and (kind, start, end) of what was replaced, in the given text."""
        out, spans, done, line = [], [], 0, 0
        while found := _MAYBE.search(text, line):
            # No pattern crosses a line end, so only lines with a digit or an at sign are read.
            at = text.rfind("\n", line, found.start()) + 1 or line
            stop = text.find("\n", found.end())
            line = len(text) if stop < 0 else stop
            while m := _PATTERN.search(text, at, line):
                new = self.of(m.lastgroup, m[0])
                if new is None:
                    # Not valid as this kind: look again for other kinds past its first run.
                    at = self._after(text, m)
                    continue
                out += [text[done : m.start()], new]
                spans.append((m.lastgroup, m.start(), m.end()))
                done = at = m.end()
        out.append(text[done:])
        return "".join(out), spans

    @staticmethod
    def _after(text, m):
        """Past the first run of letters and digits of a refused match."""
        run = re.compile(r"[A-Za-z0-9]+|.", re.S).match(text, m.start())
        return run.end()


_ready: dict[bytes, Pseudonyms] = {}


def _replace(key: bytes):
    @F.arrow_udf("struct<text: string, spans: array<struct<kind: string, start: long, end: long>>>")
    def run(texts: pa.Array) -> pa.Array:
        if key not in _ready:
            _ready[key] = Pseudonyms(key)
        change = _ready[key]
        found = [(None, []) if t is None else change(t) for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        spans = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[1]] for f in found], kind)
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), spans], ["text", "spans"])

    return run


def pseudonymize(docs: DataFrame, key: bytes, *, text="text", spans="pii") -> DataFrame:
    """Replace personal data in ``text`` and add ``pii``: kind and place (code points in the old text) of each.

    Kinds: e-mail and IP addresses, IBANs (modulo 97), cards (Luhn), social security numbers, telephone
    numbers, and dates between FIRST_DAY and LAST_DAY. What is not valid stays, and so do other dates,
    IPv6 addresses and e-mail addresses with more than 64 characters before the at sign, which no mail
    system takes. Null texts stay null with no spans. Other columns pass through in their order; one named ``pii`` is replaced.
    """
    kept = [c for c in docs.columns if c != spans]
    changed = docs.select(*kept, _replace(key)(F.col(text).cast("string")).alias("_changed"))
    columns = [F.col("_changed.text").alias(c) if c == text else F.col(f"`{c}`") for c in kept]
    return changed.select(*columns, F.col("_changed.spans").alias(spans))
