"""Sum-of-squares online packing of tokenized documents into fixed windows.

Each partition packs the documents it reads, in order, so nothing is shuffled and
the work is linear. A document fills whole windows first; what is left is placed
by the sum-of-squares rule: of all fill levels where it fits, and an empty
window, the one after which the sum of squared counts of partially filled
windows is least. A level array holds those counts. When a partition ends (or the
open windows hold more than OPEN_TOKENS, which only texts that hardly ever fit
together lead to), the fullest open windows stay as the rule made them and are
filled up from the emptiest, which alone are cut; what is left of those is cut at
powers of two, which need no padding.

Tokens come from a public tokenizer. The JVM splits texts by the tokenizer's own
pattern, and each batch's distinct pieces are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import java_pattern
from .common import table

WINDOW = 1024
#: Tokens in open windows above which they are closed early.
OPEN_TOKENS = 4_000_000
#: Pieces whose ids a Python worker remembers between batches.
REMEMBERED = 400_000
_memory: dict[str, tuple] = {}


def _encoder(path: str):
    """The tokenizer and the ids of pieces met so far, kept by the worker."""
    if path not in _memory:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _memory[path] = (Tokenizer.from_file(path), {})
    return _memory[path]


def _piece_ids(pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces, flat, and where each begins."""
    tokenizer, known = _encoder(path)
    new = [p for p in pieces if p not in known]
    fresh = {}
    for lo in range(0, len(new), 20_000):
        part = new[lo : lo + 20_000]
        fresh.update(zip(part, (np.array(e.ids, np.int32).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    ids = [known[p] if p in known else fresh[p] for p in pieces]
    if len(known) < REMEMBERED:
        known.update(fresh)
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)), out=first[1:])
    return np.frombuffer(b"".join(ids), np.int32), first


class Packer:
    """Windows of one partition; add() and close() return finished pieces (doc number, start, ids, window, offset)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows at each level
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.open: dict[int, list] = {}
        self.made = self.held = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _level(self, size: int) -> int:
        """The level whose choice leaves the least sum of squares; 0 for an empty window, the fullest on ties."""
        levels = np.arange(0, self.window - size + 1)
        change = 2 * self.count[levels + size] + 1
        change[-1] = 0  # a full window counts no more
        change[1:] -= 2 * self.count[levels[1:]] - 1
        change[1:][self.count[levels[1:]] == 0] = np.iinfo(np.int64).max
        return int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        out, w = [], self.window
        whole = len(ids) // w * w
        for start in range(0, whole, w):
            out.append((doc, start, ids[start : start + w], self._new(), 0))
        rest = ids[whole:]
        if not len(rest):
            return out
        level = self._level(len(rest))
        if level:
            number = self.at[level].pop()
            self.count[level] -= 1
        else:
            number = self._new()
            self.open[number] = []
        self.open[number].append((doc, whole, rest, number, level))
        self.held += len(rest)
        full = level + len(rest)
        if full == w:
            out += self.open.pop(number)
            self.held -= w
        else:
            self.at[full].append(number)
            self.count[full] += 1
        return out + (self.close() if self.held > OPEN_TOKENS else [])

    def close(self) -> list[tuple]:
        """Fill the fullest open windows from the emptiest; the last part is cut at powers of two."""
        fill = {n: sum(len(x[2]) for x in parts) for n, parts in self.open.items()}
        order = sorted(self.open, key=lambda n: (-fill[n], n))
        out, given = [], []  # pieces of donors, the last to be given first
        lo, hi = 0, len(order) - 1

        def take(room: int, number: int, offset: int) -> None:
            while room:
                doc, start, ids = given.pop()
                n = min(room, len(ids))
                out.append((doc, start, ids[:n], number, offset))
                room, offset = room - n, offset + n
                if n < len(ids):
                    given.append((doc, start + n, ids[n:]))

        held = 0
        while lo <= hi:
            number = order[lo]
            room = self.window - fill[number]
            while held < room and hi > lo:
                given[:0] = [x[:3] for x in reversed(self.open[order[hi]])]
                held += fill[order[hi]]
                hi -= 1
            lo += 1
            if held < room:  # no donor is left
                given += [x[:3] for x in reversed(self.open[number])]
                held += fill[number]
                break
            out += self.open[number]
            take(room, number, fill[number])
            held -= room
        while held:
            room = self.window if held >= self.window else 1 << (held.bit_length() - 1)
            take(room, self._new(), 0)
            held -= room
        self.count[:], self.open, self.held = 0, {}, 0
        self.at = [[] for _ in range(self.window + 1)]
        return out


def added_tokens(tokenizer: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before it splits the rest, longest first."""
    return sorted((t.content for t in _encoder(tokenizer)[0].get_added_tokens_decoder().values()), key=lambda t: (-len(t), t))


def split_pieces(text: Column, pattern: str, added: list[str]) -> Column:
    """The matches of the pattern in the parts of a text between added tokens, and those tokens."""
    matches = lambda part: F.regexp_extract_all(part, F.lit(java_pattern(pattern)), F.lit(0))
    if not added:
        return matches(text)
    any_of = "|".join(re.sub(r"([^0-9A-Za-z])", r"\\\1", t) for t in added)
    between, tokens = F.split(text, any_of), F.regexp_extract_all(text, F.lit(f"(?:{any_of})"), F.lit(0))
    whole = F.flatten(F.transform(between, lambda part, i: F.concat(matches(part), F.when(i < F.size(tokens), F.array(F.get(tokens, i))).otherwise(F.array().cast("array<string>")))))
    return F.when(text.rlike(any_of), whole).otherwise(matches(text))


PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, pattern: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every row of docs is a document of its own, closed by end_id: a null or empty
    text is that id alone; repeated rows are packed each; a null id stays null;
    other columns are ignored; an empty table gives no pieces. The tokenizer's added
    tokens in a text have their own ids, as the tokenizer gives them.
    """
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.select(F.col(id_col).alias("doc"), split_pieces(F.coalesce(F.col(text_col), F.lit("")), pattern, added_tokens(tokenizer)).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        base, packer, doc_type = TaskContext.get().partitionId() << 32, Packer(window), None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            docs_, sizes = [d[0][0] for d in done], [d[0][1] for d in done]
            start, length, sequence, offset = ([f(d) for d in done] for f in (lambda d: d[1], lambda d: len(d[2]), lambda d: base + d[3], lambda d: d[4]))
            ids = pa.array([d[2].astype("<i4").tobytes() for d in done], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_, doc_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids, pa.array(sizes, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for b in batches:
            doc_type, done = b.schema.field("doc").type, []
            coded = b.column("p").flatten().dictionary_encode()
            flat, first = _piece_ids(coded.dictionary.to_pylist(), tokenizer)
            at, size = coded.indices.to_numpy(), np.diff(first)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("p")).to_numpy())])
            for i, doc in enumerate(b.column("doc").to_pylist()):
                own = at[ends[i] : ends[i + 1]]
                n = size[own]
                stop = np.cumsum(n)
                total = int(stop[-1]) if len(stop) else 0
                ids = np.full(total + 1, end_id, np.int32)
                ids[:-1] = flat[np.repeat(first[own] - (stop - n), n) + np.arange(total)]
                done += packer.add((doc, total + 1), ids)
                if len(done) > 2000:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
        if last := packer.close():
            yield rows(last)

    return pieces.mapInArrow(run, f"doc {kind}, {PIECES}").withColumnRenamed("doc", id_col)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    import public_tokenizers as P

    pieces = pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
