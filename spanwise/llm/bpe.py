"""Byte-pair encoding of whole texts, equal to the tokenizers library, and decoding.

Ordinary text is split into words in Python and every word is looked up in a bounded memory
of encoded words; the library encodes the words not met yet, many at a time. Long text that
the pre-tokenizer does not split is encoded by tree concatenation: leaves are encoded on
their own, then halves are joined pairwise. Texts the fast splitting does not cover
(characters beyond Latin, special tokens) go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Characters up to here are handled by the fast splitting; all are in composed form, and lower() treats them one by one.
LATIN_END, DOTTED_I = 0x250, 0x130
#: Words kept in memory per Python worker.
WORDS = 200_000
#: An unsplit piece of more characters than this is encoded as a tree of leaves of this many.
LEAF = 1024
WORD_END = "</w>"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


LETTER, NUMBER = _class("L"), _class("N")
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
WORD = re.compile(f"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
PLAIN = re.compile(f"[\\x00-{chr(DOTTED_I - 1)}{chr(DOTTED_I + 1)}-{chr(LATIN_END - 1)}]*")


class Encoder:
    """One vocabulary file, with memory of encoded words."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        spec["model"]["end_of_word_suffix"] = None
        spec["added_tokens"] = []
        self.inner = Tokenizer.from_str(json.dumps(spec)).model
        self.model = self.whole.model
        self.special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        vocab = self.whole.get_vocab()
        self.text = [""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.text[i] = word
        self.ends = [w.endswith(WORD_END) for w in self.text]
        self.leaf = leaf
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, texts: Sequence[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        out: list[tuple[bytes, str] | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if PLAIN.fullmatch(t) and not (self.marks and self.marks.search(t)):
                words = WORD.findall(t.lower())
                if max(map(len, words), default=0) <= self.leaf:
                    split.append((i, words))
                    continue
            ids = self.encode_split(t)
            out[i] = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        if len(self.known) > WORDS:
            self.known = {}
        new = list({w for _, words in split for w in words if w not in self.known})
        for lo in range(0, len(new), 5000):
            self.learn(new[lo : lo + 5000])
        for i, words in split:
            got = [self.known[w] for w in words]
            out[i] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        return out

    def learn(self, words: list[str]) -> None:
        """The library encodes the words in one text; every word ends with a word-end token."""
        ids = self.whole.encode(" ".join(words), add_special_tokens=False).ids
        lo, ends, text = 0, self.ends, self.text
        at = [k for k, i in enumerate(ids, 1) if ends[i]]
        if len(at) != len(words):
            raise RuntimeError("the splitting pattern does not agree with the vocabulary file")
        for w, hi in zip(words, at, strict=True):
            part = ids[lo:hi]
            self.known[w] = (struct.pack(f"<{len(part)}I", *part), " ".join([text[i] for i in part]))
            lo = hi

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join([self.text[i] for i in ids])

    def encode_split(self, text: str) -> list[int]:
        """Any text: special tokens, then normalisation and splitting by the library, then each piece."""
        if max(map(len, text.split()), default=0) <= self.leaf:
            return self.whole.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        lo = 0
        for m in self.marks.finditer(text) if self.marks else ():
            ids += self.pieces(text[lo : m.start()])
            ids.append(self.whole.token_to_id(m[0]))
            lo = m.end()
        return ids + self.pieces(text[lo:])

    def pieces(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text)):
            ids += self.tree(piece)
        return ids

    def bottom(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.inner).tokenize(piece)]

    def tree(self, piece: str) -> list[int]:
        """Leaves are encoded on their own, then neighbours are joined, level by level."""
        if len(piece) <= self.leaf:
            return self.bottom(piece, True)
        starts = range(0, len(piece), self.leaf)
        level = [self.bottom(piece[lo : lo + self.leaf], lo == starts[-1]) for lo in starts]
        while len(level) > 1:
            pairs = [self.join(level[k], level[k + 1], k + 2 == len(level)) for k in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def agree(self, a: int, b: int) -> bool:
        """Whether b stays apart from a before it: the two encoded together are again the two.

        A sequence whose neighbours all agree is the encoding of its text, because the first
        merge that crosses a boundary would also happen between the two alone.
        """
        if (a, b) not in self.pairs:
            if len(self.pairs) > WORDS:
                self.pairs = {}
            last = self.ends[b]
            text = self.text[a] + (self.text[b][: -len(WORD_END)] if last else self.text[b])
            self.pairs[a, b] = self.bottom(text, last) == [a, b]
        return self.pairs[a, b]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encode again a window around the join, and widen it until both its sides agree."""
        if self.agree(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = [self.text[i] for i in left[len(left) - a :] + right[:b]]
            final = last and b == len(right)
            if final:
                window[-1] = window[-1][: -len(WORD_END)]
            mid = self.bottom("".join(window), final)
            good_left = a == len(left) or self.agree(left[len(left) - a - 1], mid[0])
            good_right = b == len(right) or self.agree(mid[-1], right[b])
            if good_left and good_right:
                return left[: len(left) - a] + mid + right[b:]
            a = a if good_left else min(2 * a, len(left))
            b = b if good_right else min(2 * b, len(right))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    if (path, leaf) not in _ENCODERS:
        _ENCODERS[path, leaf] = Encoder(path, leaf)
    return _ENCODERS[path, leaf]


#: Characters encoded at one time, so that a task's memory does not follow the batch.
AT_ONCE = 2_000_000
CODED = "ids binary, decoded string"


def with_codes(docs: DataFrame, path: str, text: str = "text", into: str = "coded", leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column struct(ids, decoded) of each whole text.

    ids are little-endian unsigned 32-bit integers; decoded is the library's decode of them,
    special tokens kept. A null text counts as empty; both are empty then. Other columns,
    whatever their names, stay as they are; repeated rows are encoded alike.
    """

    @F.arrow_udf(CODED)
    def code(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, leaf)
        for s in parts:
            texts, got, lo, size = s.to_pylist(), [], 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= AT_ONCE or hi == len(texts):
                    got += enc.encode([x or "" for x in texts[lo:hi]])
                    lo, size = hi, 0
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=["ids", "decoded"])

    # so marked, it is worked out once, whatever uses its fields
    return docs.withColumn(into, code.asNondeterministic()(F.col(text)))


def decode_ids(coded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the text of a binary column of ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def words(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for s in parts:
            yield pa.array([enc.decode(struct.unpack(f"<{len(x) // 4}I", x)) if x else "" for x in s.to_pylist()], pa.string())

    return coded.withColumn(into, words(F.col(ids)))
