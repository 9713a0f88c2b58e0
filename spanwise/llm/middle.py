"""Fill-in-middle forms of texts: prefix, middle and suffix change places behind sentinels.

Texts are cut between code points. Where these begin among the UTF-8 bytes is kept as a
compressed set of byte offsets: chunks of 65,536 offsets, each held as a sorted array, a
bitmap or a list of runs, whichever is smallest, with cumulative cardinalities over the
chunks. A cut after k code points is ``select(k)``: a search for the chunk, then a select
inside its container. ASCII stretches are single runs, so long plain texts cost a few bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import free_name

CHUNK = 1 << 16
WORD = np.arange(64, dtype=np.uint64)
#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
SHAPE = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


@dataclass(frozen=True)
class ArrayContainer:
    """Sorted 16-bit offsets."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])

    def nbytes(self) -> int:
        return self.values.nbytes


@dataclass(frozen=True)
class BitmapContainer:
    """1,024 words of 64 bits, and how many bits are set before each."""

    words: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        set_bits = np.flatnonzero((self.words[w] >> WORD) & np.uint64(1))
        return w * 64 + int(set_bits[k - int(self.before[w])])

    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


@dataclass(frozen=True)
class RunContainer:
    """Starts of runs of consecutive offsets, and how many offsets lie before each."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])

    def nbytes(self) -> int:
        return self.starts.nbytes + self.before.nbytes


Container = ArrayContainer | BitmapContainer | RunContainer


def container(member: np.ndarray, card: int) -> Container:
    """The smallest container for a chunk given as one flag an offset."""
    if card == len(member):
        return RunContainer(np.zeros(1, np.uint16), np.zeros(1, np.int32))
    begins = np.flatnonzero(member & ~np.concatenate(([False], member[:-1])))
    sizes = {"runs": 6 * len(begins), "array": 2 * card, "bitmap": CHUNK // 8 + CHUNK // 16}
    kind = min(sizes, key=lambda s: sizes[s])
    if kind == "array":
        return ArrayContainer(np.flatnonzero(member).astype(np.uint16))
    if kind == "bitmap":
        words = np.packbits(np.pad(member, (0, CHUNK - len(member))), bitorder="little").view("<u8")
        each = np.bitwise_count(words).astype(np.int32)
        return BitmapContainer(words, np.cumsum(each) - each)
    ends = np.flatnonzero(member & ~np.concatenate((member[1:], [False]))) + 1
    lengths = (ends - begins).astype(np.int32)
    return RunContainer(begins.astype(np.uint16), np.cumsum(lengths) - lengths)


@dataclass(frozen=True)
class BoundarySet:
    """Byte offsets of UTF-8 text at which a code point begins, and the end of the text."""

    containers: tuple[Container, ...]
    cumulative: np.ndarray

    @staticmethod
    def of(data: bytes) -> BoundarySet:
        raw = np.frombuffer(data, dtype=np.uint8)
        held, cards = [], []
        for lo in range(0, len(raw) + 1, CHUNK):
            member = (raw[lo : lo + CHUNK] & 0xC0) != 0x80
            if lo + CHUNK > len(raw):
                member = np.append(member, True)
            card = int(np.count_nonzero(member))
            held.append(container(member, card))
            cards.append(card)
        return BoundarySet(tuple(held), np.cumsum(cards))

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """Byte offset of boundary k: where code point k begins."""
        c = int(np.searchsorted(self.cumulative, k, side="right"))
        return c * CHUNK + self.containers[c].select(k - (int(self.cumulative[c - 1]) if c else 0))

    def nbytes(self) -> int:
        return sum(c.nbytes() for c in self.containers) + self.cumulative.nbytes


def draws(key: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fim", seed: int = 1, used: int = 90, spm: int = 20) -> DataFrame:
    """``docs`` with a struct column: n (code points), form, prefix_chars, middle_chars, output.

    Of 100 texts ``used`` are rearranged, of these ``spm`` in 100 with the suffix first, drawn
    by a hash of ``seed`` and the key; so are the two cuts. A text that is empty or holds a
    sentinel stays plain, and so does every other; its output is the text and its cuts are null.

    A null text counts as empty. A null key counts as the empty string. Rows that share a key
    share their draws; equal rows get equal results, so there are no ties. Texts of any
    length are cut whole, inside one row. The new column is the last one; while another
    column has its name, underscores are added to it. No rows in, no rows out.
    """
    p, s, m = (x.encode() for x in SENTINELS)

    def rearranged(name: str, data: bytes) -> tuple:
        bounds = BoundarySet.of(data)
        n = len(bounds) - 1
        h1, h2, h3, h4 = draws(name, seed)
        if not data or h3 % 100 >= used or any(x in data for x in (p, s, m)):
            return n, "plain", None, None, data
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = bounds.select(lo), bounds.select(hi)
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if h4 % 100 < spm:
            return n, "spm", lo, hi - lo, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", lo, hi - lo, b"".join((p, prefix, s, suffix, m, middle))

    @F.arrow_udf(SHAPE)
    def shape(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [rearranged(k, t) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # so marked, it is worked out once, however many of its fields are used
    return docs.withColumn(free_name(docs, into), shape.asNondeterministic()(name, whole))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone.

    The first occurrence of a sentinel is the sentinel itself: rearranged texts hold none, and
    none can begin in the text and end in a sentinel.
    """
    p, s, m = SENTINELS
    width = len(p)
    second = F.when(form == "spm", F.instr(output, p)).otherwise(F.instr(output, s))
    third = F.instr(output, m)
    first_part = F.substring(output, F.lit(width + 1), second - width - 1)
    second_part = F.substring(output, second + width, third - second - width)
    middle = F.substring(output, third + width, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(second_part, middle, first_part)).otherwise(F.concat(first_part, middle, second_part))
