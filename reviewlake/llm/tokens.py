"""Token counts, ids and prefix tables for a byte-level BPE vocabulary (``tokenizers`` JSON).

Texts are cut at white space into units (an optional space and the run after it).  A cut
before a unit is also a cut of the vocabulary's own pre-tokeniser, so units encode alone and
a worker remembers them.  Documents with unusual characters, where the rules of two regex
engines could differ, and those that hold a special token's string go to the library's
pre-tokeniser or encoder whole.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
import tiktoken
from tokenizers import Tokenizer

from .common import per_text

#: Remembered units, prefixes and pair checks in a worker: memory bounds; results do not depend on them.
MEMO_UNITS, MEMO_PREFIXES, MEMO_PAIRS = 300_000, 1_000_000, 800_000
#: Longer units are encoded each time, not remembered.
MEMO_CHARS = 48

UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Anything but printable ASCII, tab, line ends and the letters of U+00C0-U+00FF.
ODD = re.compile(r"[^\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]")
#: White space to Python, but not to the vocabulary's own pattern.
NO_SPACE = "\x1c\x1d\x1e\x1f"
RUN = re.compile(r"[^\S\x1c-\x1f]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """One vocabulary in one worker: ids, and the prefix dynamic programme."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.vocab = self.tok.get_vocab(with_added_tokens=False)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.shown = {b: alphabet[b] for b in range(256)}
        byte = {c: b for b, c in enumerate(alphabet)}
        #: The longest vocabulary entry that ends in a symbol.
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            self.longest[t[-1]] = max(self.longest.get(t[-1], 1), len(t))
        self.count_of: dict[str, int] = {}
        self.state: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        # Where entries are numbered in the order of their merges, a rank-driven engine gives the same ids faster.
        merges = json.loads(self.tok.to_str())["model"]["merges"]
        ranks = [self.vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        self.fast = None
        if ranks == sorted(ranks) and all(t in byte or self.vocab[t] >= ranks[0] for t in self.vocab):
            table = {bytes([byte[c] for c in t]): i for t, i in self.vocab.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=GPT2_PATTERN, mergeable_ranks=table, special_tokens={})

    # --- ids -----------------------------------------------------------------------------

    def plain(self, text: str) -> bool:
        return not ODD.search(text) and not any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.fast and self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    # --- the prefix dynamic programme ----------------------------------------------------

    def fits(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is exactly [a, b] (of b alone, if a is empty)."""
        known = self.pairs[a, b] = [t.value for t in self.tok.model.tokenize(a + b)] == ([a, b] if a else [b])
        return known

    def grow(self, word: str) -> tuple[str, int]:
        """(last token, tokens) of a word in stand-in symbols; stores the same of every prefix.

        The last token of a prefix's encoding is the one vocabulary entry that ends there and
        agrees with the last token of the prefix before it, so each prefix needs only the
        entries that end at it, and words share the prefixes they have in common.
        """
        state, vocab, pairs, longest = self.state, self.vocab, self.pairs, self.longest
        n = len(word)
        if len(state) > MEMO_PREFIXES:
            state.clear()
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        at = n
        while at and word[:at] not in state:
            at -= 1
        last = state[word[:at]][0] if at else ""
        for i in range(at + 1, n + 1):
            # Most often the last token grows by a symbol; otherwise every entry that ends here is tried.
            grown = i - 1 - len(last)
            for j in (grown, *range(max(0, i - longest.get(word[i - 1], 1)), i)):
                t = word[j:i]
                if t in vocab:
                    a, c = state[word[:j]] if j else ("", 0)
                    if (ok := pairs.get((a, t))) is None:
                        ok = self.fits(a, t)
                    if ok:
                        state[word[:i]] = (t, c + 1)
                        last = t
                        break
        return state.get(word, ("", 0))

    def table(self, word: str) -> list[int]:
        """counts[i]: tokens of the first i symbols of one pre-token."""
        if len(word) > MEMO_CHARS:
            self.long_count(word)
            return self.long_table
        self.grow(word)
        return [0] + [self.state[word[:i]][1] for i in range(1, len(word) + 1)]

    def symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # only the space has a stand-in then
            return piece.replace(" ", self.shown[32])
        return piece.encode().decode("latin-1").translate(self.shown)

    def count(self, word: str) -> int:
        """Tokens of one pre-token; a very long one keeps only a window of prefixes."""
        if len(word) > MEMO_CHARS:
            return self.long_count(word)
        return (self.state.get(word) or self.grow(word))[1]

    def long_count(self, word: str) -> int:
        last, counts, pairs, vocab = [""], [0], self.pairs, self.vocab
        for i in range(1, len(word) + 1):
            for j in (i - 1 - len(last[-1]), *range(max(0, i - self.longest.get(word[i - 1], 1)), i)):
                t = word[j:i]
                if t in vocab:
                    if (ok := pairs.get((last[j], t))) is None:
                        ok = self.fits(last[j], t)
                    if ok:
                        last.append(t)
                        counts.append(counts[j] + 1)
                        break
        self.long_table = counts
        return counts[-1]

    def unit_count(self, unit: str) -> int:
        n = 0
        for p in PIECES.findall(unit):
            n += self.count(self.symbols(p))
        if len(unit) <= MEMO_CHARS:
            if len(self.count_of) > MEMO_UNITS:
                self.count_of.clear()
            self.count_of[unit] = n
        return n

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """(pre-token or special string, its tokens) in order; they join to the text."""
        if self.plain(text):
            return [(p, self.count(self.symbols(p))) for u in UNITS.findall(text) for p in PIECES.findall(u)]
        out: list[tuple[str, int]] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append((part, 1))
            elif part:
                out += [(part[a:b], self.count(word)) for word, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def unit_counts(self, text: str) -> tuple[list[str], list[int]]:
        if self.plain(text):
            units, known = UNITS.findall(text), self.count_of.get
            return units, [known(u) or self.unit_count(u) for u in units]
        pairs = self.pieces(text)
        return [p for p, _ in pairs], [n for _, n in pairs]

    def at_every_prefix(self, text: str) -> list[int]:
        """counts[i] = number of tokens of text[:i], for every i from 0 to len(text).

        A prefix that ends in white space ends with that whole run as one pre-token, so the
        prefix table of the run answers for all of them; one that cuts a contraction ends with
        two pieces; one that cuts a special token's string has plain text there, which is
        encoded from the end of the last special token.
        """
        out, base, segment = [0], 0, 0
        run_end = run_base = run_at = 0
        run_table: list[int] = []
        pieces = self.pieces(text)
        stops, at = [], 0  # where strings of special tokens begin
        for piece, _ in pieces:
            if piece in self.special:
                stops.append(at)
            at += len(piece)
        stops.append(len(text))
        for piece, n in pieces:
            if piece in self.special:
                before, start = out[segment], len(out) - 1
                out += [before + len(self.tok.encode(text[segment : start + k], add_special_tokens=False).ids) for k in range(1, len(piece))]
                base += 1
                out.append(base)
                segment, stops = len(out) - 1, stops[1:]
                continue
            table, at = self.table(self.symbols(piece)), 0
            for k, c in enumerate(piece):
                at += len(c.encode())
                if c.isspace() and c not in NO_SPACE:
                    place = len(out) - 1
                    if place >= run_end:  # a run begins
                        run = RUN.match(text, place, stops[0])
                        run_end, run_base, run_at, run_table = run.end(), out[-1], 0, self.table(self.symbols(run[0]))
                    run_at += len(c.encode())
                    out.append(run_base + run_table[run_at])
                else:
                    out.append(base + (2 if k == 1 and piece in ("'re", "'ve", "'ll") else table[at]))
            base += n
        return out

    def truncate(self, text: str, budget: int, units: list[str] | None = None, counts: list[int] | None = None) -> int:
        """The most characters of the text whose own encoding has at most ``budget`` tokens."""
        if units is None or counts is None:
            units, counts = self.unit_counts(text)
        total = k = chars = 0
        while k < len(units) and total + counts[k] <= budget:
            total, chars, k = total + counts[k], chars + len(units[k]), k + 1
        if k == len(units):
            return len(text)
        while k and not units[k - 1].strip():  # begin before a run of white space
            k -= 1
            total, chars = total - counts[k], chars - len(units[k])
        end = k + 1
        while end < len(units) and not units[end - 1].strip():
            end += 1
        local = self.at_every_prefix("".join(units[k:end]))
        return chars + max(i for i, n in enumerate(local) if total + n <= budget)


@functools.cache
def bpe(path: str) -> ByteBpe:
    """One vocabulary a worker, kept from task to task."""
    return ByteBpe(path)


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token counts, and how much of each text fits into ``limit`` tokens.

    Returns id, n_bytes, n_tokens, over_limit and fit_chars: the longest prefix, in code
    points, whose own encoding has at most ``limit`` tokens, read from the prefix table.
    Null texts count as empty (0 bytes, 0 tokens); rows with equal ids each get a row.
    """

    def run(texts: list) -> list[pa.Array]:
        b = bpe(tokenizer)
        n_bytes, n_tokens, fit = [], [], []
        for t in texts:
            t = t or ""
            units, counts = b.unit_counts(t)
            n = sum(counts)
            n_bytes.append(len(t.encode()))
            n_tokens.append(n)
            fit.append(b.truncate(t, limit, units, counts) if n > limit else len(t))
        return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())]

    return per_text(df, id_col, text_col, run, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
