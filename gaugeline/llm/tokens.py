"""Token counts and ids of whole texts, through units that tokenise alone.

A byte-level tokenizer of this kind never lets a token cross from a character that is not white space into white space
after it, so a text may be cut before any blank that follows such a character. The pieces between these cuts (units)
are few and repeat, so each is worked out once per worker and looked up afterwards.

Counts come from prefix dynamic programming: for every prefix of a unit, its token count and last token follow from a
shorter prefix. A token may end a prefix if, put after the last token of the prefix before it, the two encode to
themselves; exactly one token does. Sums over units give the count of every prefix of the text. All of them are stored,
in blocks of a base and one byte a prefix, and every question about totals, cuts and budgets is answered from the table.

Defined cases: null and empty texts have no tokens; special strings inside a text are one token each, as the library
takes them by default, and their own proper prefixes are ordinary text; repeated rows give repeated rows; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import stored

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units a worker remembers, and the longest one it does.
REMEMBERED, LONGEST = 560_000, 64
#: Prefixes in a block of stored counts.
BLOCK = 64
#: Characters of a unit up to which the second library splits it: its pattern's stack ends at about a million blanks.
WHOLE = 1 << 16
#: The pre-tokenizer's pattern, the contractions of three characters that it keeps whole though their
#: prefixes of two characters are two pieces, and control characters that Python alone takes for white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")
MARKS = frozenset(string.punctuation)
NOT_BLANK = re.compile("[\x1c-\x1f]")
#: Below this character, letters, digits and white space are the same to every version of Unicode.
SETTLED = "\u0180"


def joined_units(chunks: list[str]) -> list[str]:
    """Units out of the parts between blanks: a part that is empty or ends in white space is joined to the next."""
    units, parts = [], [chunks[0]]
    for chunk in chunks[1:]:
        if parts[-1] == "" or parts[-1][-1].isspace():
            parts.append(chunk)
        else:
            units.append(" ".join(parts))
            parts = [chunk]
    units.append(" ".join(parts))
    return units


def open_end(chunk: str) -> bool:
    return chunk == "" or chunk[-1].isspace()


def blank(text: str) -> bool:
    return text.isspace() and not NOT_BLANK.search(text)


class Memory(dict):
    """What a worker remembers. When half the room is taken, that half becomes the older one and the older one goes."""

    def __init__(self) -> None:
        self.older: dict = {}

    def turn(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()


class Vocabulary:
    """The tokenizer file, and the memory of one worker."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, added = described["model"], described["added_tokens"]
        split = described["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or described["normalizer"]:
            raise ValueError("a byte-level tokenizer without normalisation is needed")
        special = [t["content"] for t in added]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letters = self.letters()
        self.tokens = {bytes(letters[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merged = [self.tokens[bytes(letters[c] for c in a + b)] for a, b in pairs]
        if merged != sorted(merged):
            raise ValueError("token ids must follow the order of merges")
        # The merges of the file, run by a second library that takes a single piece of bytes at a time.
        self.merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.tokens, special_tokens={})._core_bpe
        self.pattern = regex.compile(PATTERN)
        # Tokens that encode to themselves, written as one character for each byte; found at all places in one pass. With
        # each: its length, and which tokens are known to follow it or not, under "" itself.
        self.endings = ahocorasick.Automaton()
        for token, number in self.tokens.items():
            if len(token) == 1 or self.merge.encode_single_piece(token) == [number]:
                written = token.decode("latin-1")
                self.endings.add_word(written, (len(token), written, {"": written}))
        self.endings.make_automaton()
        self.pairs = 0
        self.pieces, self.counts, self.ids = Memory(), Memory(), Memory()

    @staticmethod
    def letters() -> dict[str, int]:
        """The letter that a byte-level vocabulary writes for each byte: printable bytes themselves, the rest from 256 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def split(self, unit: str) -> list[str]:
        """The pieces that the pre-tokenizer makes of a unit."""
        if (unit.isascii() or max(unit) < SETTLED) and not NOT_BLANK.search(unit):
            return self.pattern.findall(unit)
        return [unit[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    # -- counts by prefix ------------------------------------------------------------------------------------------

    def follows(self, known: dict[str, str | bool], token: str) -> bool:
        if self.pairs > REMEMBERED:
            for _, _, after in self.endings.values():
                last = after[""]
                after.clear()
                after[""] = last
            self.pairs = 0
        one, two = known[""].encode("latin-1"), token.encode("latin-1")
        fit = known[token] = self.merge.encode_single_piece(one + two) == [self.tokens[one], self.tokens[two]]
        self.pairs += 1
        return fit

    def piece(self, text: str, keep: bool = True) -> array:
        """Tokens of every prefix of a piece, counted in bytes: the dynamic program. A unit of one piece is kept as a unit alone."""
        if keep:
            if (known := self.pieces.get(text)) is not None:
                return known
            if (known := self.pieces.older.get(text)) is not None:
                self.pieces[text] = known
                return known
        count, last, solved = [0], [{}], 0
        for at, (size, token, after) in self.endings.iter(text if text.isascii() else text.encode().decode("latin-1")):
            if at >= solved:
                start = at + 1 - size
                if start:
                    known = last[start]
                    fit = known.get(token)
                    if not (self.follows(known, token) if fit is None else fit):
                        continue
                    count.append(count[start] + 1)
                else:
                    count.append(1)
                last.append(after)
                solved += 1
        counted = array("i", count)
        if keep and len(text) <= LONGEST:
            self.pieces.turn()
            self.pieces[text] = counted
        return counted

    def remembered(self, word: str) -> bytes:
        """Counts of a unit of a blank and a word, which is known by the word."""
        known = self.counts
        if (counted := known.get(word)) is None:
            if (counted := known.older.get(word)) is None:
                counted = self.unit_counts(" " + word)
            if len(word) <= LONGEST:
                known[word] = counted
        return counted

    def unit_counts(self, unit: str) -> bytes:
        """Tokens of every prefix of a unit but the empty one, counted in characters, four bytes each."""
        if unit[:1] == " " and unit.isascii():
            if unit[1:].isalpha():
                return self.piece(unit, False)[1:].tobytes()
            if unit[-1] in MARKS and unit[1:-1].isalpha():  # a word and a mark, which is a piece and a token of its own
                word = self.remembered(unit[1:-1])
                return word + (int.from_bytes(word[-4:], "little") + 1).to_bytes(4, "little")
        parts = self.split(unit)
        out, before, overrun = array("i"), 0, 0
        for text in parts:
            count, start = self.piece(text), len(out)
            if text.isascii():
                out.extend([before + n for n in count[1:]] if before else count[1:])
            else:
                out.extend([before + count[at] for at in accumulate([len(c.encode()) for c in text])])
            if text in CONTRACTIONS:
                out[start + 1] = before + 2
            if overrun:  # the white space before ended one character later when the text did
                out[start] = overrun
            end, overrun = len(out), 0
            if end < len(unit) and blank(text) and blank(unit[end]):
                overrun = before + sum([self.piece(x)[-1] for x in self.split(unit[start : end + 1])])
            before += count[-1]
        return out.tobytes()

    def looked_up(self, text: str, known: Memory, work) -> tuple[list[str], list]:
        """The units of a text and what is known of each, worked out where it isn't."""
        units = text.split(" ")
        found = list(map(known.get, units))
        found[0] = work(units[0])
        if None in found or open_end(units[0]):
            missing = [k for k, x in enumerate(found) if x is None]
            if open_end(units[0]) or any(open_end(units[k]) for k in missing):
                units = joined_units(units)
                found = list(map(known.get, units))
                found[0] = work(units[0])
                missing = [k for k, x in enumerate(found) if x is None]
            for k in missing:
                u = units[k]
                if (x := known.get(u)) is None:  # unless this text had it before
                    if (x := known.older.get(u)) is None:
                        x = work(" " + u)
                    if len(u) <= LONGEST and not open_end(u):
                        known.turn()
                        known[u] = x
                found[k] = x
        return units, found

    def plain_prefixes(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(1, np.int32)
        found = self.looked_up(text, self.counts, self.unit_counts)[1]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every = np.zeros(len(text) + 1, np.int32)
        every[1:] = np.frombuffer(b"".join(found), "<i4")
        totals = every[np.cumsum(lengths)]
        every[1:] += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
        return every

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, counted in characters, from the empty one on."""
        if not self.special or not self.special.search(text):
            return self.plain_prefixes(text)
        split, parts, before = self.special.split(text), [np.zeros(1, np.int32)], 0
        for plain, mark in zip(split[::2], [*split[1::2], ""], strict=True):
            counted = self.plain_prefixes(plain + mark[:-1])  # within a special string, what has come of it is ordinary
            here = self.plain_prefixes(plain)
            counted[: len(here)] = here
            parts.append(before + counted[1:])
            before += int(here[-1])
            if mark:
                before += 1
                parts.append(np.array([before], np.int32))
        return np.concatenate(parts)

    def within(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and the length of its longest prefix of at most so many."""
        every = self.prefixes(text)
        return int(every[-1]), int(np.flatnonzero(every <= limit)[-1])

    # -- ids -------------------------------------------------------------------------------------------------------

    def encoded(self, unit: str) -> bytes:
        """Ids of a unit, four bytes each."""
        if unit.isascii() or max(unit, default="") < SETTLED:
            if len(unit) > WHOLE:
                return b"".join(array("I", self.merge.encode_single_piece(x.encode())).tobytes() for x in self.split(unit))
            return array("I", self.merge.encode_ordinary(unit)).tobytes()
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def text_ids(self, text: str) -> np.ndarray:
        """Ids of a text, without added tokens."""
        if self.special and self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(self.looked_up(text, self.ids, self.encoded)[1]), "<u4")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def blocked(counts: np.ndarray) -> tuple[np.ndarray, int, bytes]:
    """Counts as blocks: the least of each, the bytes of a step above it, and the steps."""
    blocks = np.concatenate([counts, np.full(-len(counts) % BLOCK, counts[-1], counts.dtype)]).reshape(-1, BLOCK)
    bases = blocks.min(axis=1)
    steps = (blocks - bases[:, None]).reshape(-1)[: len(counts)]
    width = 1 if steps.max() < 256 else 4
    return bases, width, steps.astype(">u4" if width == 4 else np.uint8).tobytes()


def prefix_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, and prefix_tokens: the token count of every prefix from the empty one on, for ``tokens_at``."""

    @F.pandas_udf("bases array<int>, width int, steps binary")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for texts in batches:
            yield pd.DataFrame([blocked(words.prefixes(t)) for t in texts], columns=["bases", "width", "steps"])

    return _texts(docs, doc_id, text).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("prefix_tokens"))


def tokens_at(prefix_tokens: str, length: Column | int) -> Column:
    """Tokens of the prefix of so many characters, out of a stored table; null beyond the text."""
    at, held = F.lit(length).cast("int"), F.col(prefix_tokens)
    step = F.conv(F.hex(F.substring(held["steps"], at * held["width"] + 1, held["width"])), 16, 10).cast("long")
    return F.get(held["bases"], F.floor(at / BLOCK).cast("int")) + step


def characters(prefix_tokens: str) -> Column:
    """Characters of the text behind a stored table."""
    return (F.octet_length(F.col(prefix_tokens)["steps"]) / F.col(prefix_tokens)["width"]).cast("long") - 1


def fitting(prefix_tokens: str, limit: int) -> Column:
    """Characters of the longest prefix of at most so many tokens, out of a stored table."""
    bases, width, steps = (F.col(prefix_tokens)[name] for name in ("bases", "width", "steps"))
    block = F.array_max(F.transform(bases, lambda base, k: F.when(base <= limit, k)))
    room = F.least(F.lit(limit) - F.get(bases, block), F.when(width == 1, 255).otherwise((1 << 31) - 1))
    # steps are compared as bytes, highest first
    most = F.unhex(F.lpad(F.hex(room), 2 * width, "0"))
    ends = F.sequence(block * BLOCK, F.least(block * BLOCK + (BLOCK - 1), characters(prefix_tokens).cast("int")))
    cut = F.transform(F.array(F.struct(ends.alias("ends"), most.alias("most"))), lambda x: F.array_max(
        F.filter(x["ends"], lambda at: F.substring(steps, at * width + 1, width) <= x["most"])
    ))
    whole = characters(prefix_tokens)
    return F.when(tokens_at(prefix_tokens, whole) <= limit, whole).otherwise(F.get(cut, 0).cast("long"))


def token_counts(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix of at most limit tokens, in characters.

    All of them are read from the stored table of prefix counts; no text is encoded for them.
    """
    held = stored(prefix_table(docs, path, doc_id, text), "token-prefixes", compression="zstd")
    total = tokens_at("prefix_tokens", characters("prefix_tokens"))
    return held.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"), fitting("prefix_tokens", limit).alias("fit_chars"))
