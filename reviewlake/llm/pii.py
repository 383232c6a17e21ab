"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-signs, digits, URL schemes and words that
announce an identifier.  Deterministic local parsers expand from an anchor to the left and to
the right and validate what they find.  Text without anchors is never looked at again.

Base kinds (leftmost, non-overlapping within a kind; a match that fails its check is dropped
and not tried again): email, ip, card, phone.  The method adds: url (a scheme and what follows
it), account (a cue such as "iban" or "account no." and an identifier with a digit) and
address (a house number, capitalised words and a street word).  Cues and schemes are found in
any casing.  An account in IBAN form ends where its check digits are right, if they are right
for any length; a wrong number after a cue stays a finding, as a mistyped account is no less
personal.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "url")
KINDS = BASE + ADDED

# Characters of the base patterns, and the cues of the added kinds.
DIGIT = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
HOST = ALNUM | frozenset("-")
PHONE = DIGIT | frozenset(" ().-")
URL_STOP = frozenset(" \t\n\r\v\f<>\"'`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("iban", "account", "acct", "a/c", "ssn", "passport", "routing", "bic", "swift", "tax id", "konto", "compte", "cuenta")
STREETS = ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Lane", "Boulevard", "Blvd.", "Drive", "Square")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+":
        a.add_word(c, (c, 1))
    for c in DIGIT:
        a.add_word(c, ("0", 1))
    for kind, words in (("url", SCHEMES), ("cue", CUES)):
        for s in words:
            a.add_word(s, (kind, len(s)))
    a.make_automaton()
    return a


def lowered(t: str) -> str:
    """Lower case, character by character: positions stay."""
    low = t.lower()
    return low if len(low) == len(t) else "".join([c.lower() if c.isascii() else c for c in t])


def iban(chars: str) -> bool:
    """Whether the check digits of an account number in IBAN form are right."""
    return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand the at-sign at ``at``; nothing before ``floor`` is free."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, i, dots = len(t), 0, at + 1, 0
    while i < n and t[i] in HOST:
        i += 1
    if i == at + 1:
        return None
    while i + 1 < n and t[i] == "." and t[i + 1] in HOST:
        i += 2
        while i < n and t[i] in HOST:
            i += 1
        end, dots = i, dots + 1
    return (start, end) if dots else None


def card_at(t: str, i: int) -> tuple[int, int, str]:
    """The chain of digits from i, joined by single spaces or hyphens: its span and digits."""
    n, digits, end = len(t), [t[i]], i + 1
    while end < n:
        if t[end] in DIGIT:
            digits.append(t[end])
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGIT:
            digits.append(t[end + 1])
            end += 2
        else:
            break
    return i, end, "".join(digits)


def phone_at(t: str, i: int) -> tuple[int, int, int] | None:
    """Expand the plus-sign at i: span and number of digits."""
    n = len(t)
    if i + 2 >= n or t[i + 1] not in DIGIT:
        return None
    j = i + 2
    while j < n and t[j] in PHONE:
        j += 1
    while j > i + 2 and t[j - 1] not in DIGIT:
        j -= 1
    if j - (i + 2) < 2:  # the pattern has at least one character between its two digits
        return None
    return i, j, sum(c in DIGIT for c in t[i:j])


def ip_at(t: str, i: int) -> tuple[int, int, list[str]] | None:
    """Four dotted runs of digits from i."""
    n, parts = len(t), []
    for k in range(4):
        start = i if k == 0 else j + 1
        if k and not (j < n and t[j] == "." and start < n and t[start] in DIGIT):
            return None
        j = start
        while j < n and t[j] in DIGIT:
            j += 1
        parts.append(t[start:j])
    return i, j, parts


def url_at(t: str, i: int, head: int) -> tuple[int, int] | None:
    if i and t[i - 1] in ALNUM:
        return None
    j, n = i + head, len(t)
    while j < n and t[j] not in URL_STOP:
        j += 1
    while j > i + head and t[j - 1] in ".,;:!?)]":
        j -= 1
    return (i, j) if j > i + head else None


def account_at(t: str, i: int, head: int) -> tuple[int, int] | None:
    """An identifier of 6 to 34 letters and digits, at least 4 of them digits, after a cue."""
    n, j = len(t), i + head
    if (i and t[i - 1] in ALNUM) or (j < n and t[j] in ALNUM):
        return None
    limit = min(n, j + 16)
    while j < limit and not (t[j] in DIGIT or (t[j] in ALNUM and t[j].isupper() and j + 2 < n and t[j + 1] in ALNUM and t[j + 2] in DIGIT)):
        if t[j] not in ALNUM and t[j] not in " .:#=-":
            return None
        j += 1
    if j >= limit:
        return None
    start, chars, ends, end = j, [], [], j
    while j < n and len(chars) < 34:
        if t[j] in ALNUM:
            chars.append(t[j])
            j += 1
            end = j
            ends.append(end)
        elif t[j] in " -" and j + 1 < n and t[j + 1] in DIGIT:
            j += 1
        else:
            break
    if len(chars) >= 15 and "".join(chars[:2]).isalpha() and "".join(chars[2:4]).isdigit():
        for k in range(len(chars), 14, -1):
            if (ends[k - 1] == n or t[ends[k - 1]] not in ALNUM) and iban("".join(chars[:k])):
                return start, ends[k - 1]
    if end < n and t[end] in ALNUM:
        return None
    digits = sum(c in DIGIT for c in chars)
    return (start, end) if 6 <= len(chars) and digits >= 4 else None


def address_at(t: str, i: int) -> tuple[int, int] | None:
    """A house number of up to 5 digits, one to four capitalised words and a street word."""
    n, j = len(t), i
    if i and t[i - 1] not in " \n\t,(":
        return None
    while j < n and t[j] in DIGIT:
        j += 1
    if j - i > 5 or j >= n or t[j] != " ":
        return None
    for k in range(5):
        start = j + 1
        if start >= n or not t[start].isupper():
            return None
        end = start
        while end < n and (t[end].isalpha() or t[end] in ".'-"):
            end += 1
        if k and t[start:end].rstrip(".") in _STREETS:
            return i, end if t[start:end] in STREETS else start + len(t[start:end].rstrip("."))
        j = end
        if j >= n or t[j] != " ":
            return None
    return None


_STREETS = frozenset(s.rstrip(".") for s in STREETS)


def spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start; ends are exclusive, positions are code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)  # a kind's next match begins here at the earliest
    for last, (kind, size) in automaton().iter(lowered(t)):
        i = last - size + 1
        if kind == "0":
            if i >= after["card"]:
                a, b, digits = card_at(t, i)
                after["card"] = b
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((a, b))
            if i >= after["ip"]:
                got = ip_at(t, i)
                if got:
                    after["ip"] = got[1]
                    if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in got[2]):
                        out["ip"].append(got[:2])
                else:  # no later digit of this run begins a match either
                    j = i
                    while j < len(t) and t[j] in DIGIT:
                        j += 1
                    after["ip"] = j
            if i >= after["address"] and (i == 0 or t[i - 1] not in DIGIT):
                got = address_at(t, i)
                if got:
                    out["address"].append(got)
                    after["address"] = got[1]
        elif kind == "@":
            if i >= after["email"]:
                got = email_at(t, i, after["email"])
                if got:
                    out["email"].append(got)
                    after["email"] = got[1]
        elif kind == "+":
            if i >= after["phone"]:
                got = phone_at(t, i)
                if got:
                    after["phone"] = got[1]
                    if 8 <= got[2] <= 15:
                        out["phone"].append(got[:2])
        else:
            name = "url" if kind == "url" else "account"
            if i >= after[name]:
                got = url_at(t, i, size) if kind == "url" else account_at(t, i, size)
                if got:
                    out[name].append(got)
                    after[name] = got[1]
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base (listed spans of base kinds) and spans (all).

    Null texts count as empty and have no spans.  Rows with equal ids each get a row.
    """

    def run(texts: list) -> list[pa.Array]:
        found = [spans(t or "") for t in texts]
        counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
        return counts + [pa.array([listed(f, ks) for f in found], pa.string()) for ks in (BASE, KINDS)]

    return per_text(df, id_col, text_col, run, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask(t: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    found = sorted((a, b, k) for k, rows in spans(t).items() for a, b in rows)
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:] if found else t


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with personal data in ``text_col`` replaced by ``[KIND]``; nulls stay null."""
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if t is None else mask(t) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    from .common import session

    session(df)
    return df.mapInArrow(run, df.schema)
