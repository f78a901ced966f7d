"""Repair of conversation structure by a min-plus dynamic program over runs of equal symbols.

A row is a symbol: the initial of its role (s, u, a or another) and its fault. The
wanted role initials are `(s?(ua)+)?`, so a state (start, after s, after u, after a)
admits one next role at most, and a row's edits are a 4 by 4 min-plus matrix. A run of
equal symbols is advanced by the binary powers of its matrix, which are cached; the
audit is then unrolled forward, least letter first among the edits of least cost.

No conversation is held whole: rows are sorted over ranges of (conversation, turn), a
segment is a conversation's rows in one range, segments give 4 by 4 matrices, a pass
over matrices gives each segment the costs behind it, every segment is unrolled alone
for each state that it may begin in, and a pass over the four outcomes picks one. Only
the digest of a conversation's text, which is one sequential hash by definition, is
made in one place, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_NEVER = 1 << 40
#: States: nothing yet, after s, after u, after a. The role that user/assistant edits give from each, and the state it leads to.
_ROLE, _NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Costs behind the last row: a conversation may end with nothing or after a.
_END = (0, 2 * INSERT, INSERT, 0)
#: Initials by their number in a symbol; a symbol is 3 * initial + (0 sound, 1 to be deleted, 2 truncated).
_INITIALS = "sua"
#: Bytes of a block of repaired text.
BLOCK = 1 << 20


def _kept(state: int, initial: int) -> int:
    """The state after a kept row, or -1 where the initial is not admitted."""
    return 1 if state == 0 and initial == 0 else _NEXT[state] if initial < 3 and _INITIALS[initial] == _ROLE[state][0] else -1


def _times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of matrices."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def _inserts() -> tuple:
    """Least cost of inserted rows between states."""
    out = [[0 if i == j else _NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        at, cost = i, 0
        for _ in range(3):
            at, cost = _NEXT[at], cost + INSERT
            out[i][at] = min(out[i][at], cost)
    return tuple(map(tuple, out))


@lru_cache(maxsize=4096)
def power(symbol: int, j: int) -> tuple:
    """The matrix of 2^j rows of one symbol."""
    if j:
        half = power(symbol, j - 1)
        return _times(half, half)
    initial, fault = divmod(symbol, 3)
    row = [[_NEVER] * 4 for _ in range(4)]
    for p in range(4):
        row[p][p] = DELETE
        if fault != 1:
            extra, q = TRUNCATED if fault == 2 else 0, _kept(p, initial)
            if q >= 0:
                row[p][q] = min(row[p][q], KEEP + extra)
            row[p][_NEXT[p]] = min(row[p][_NEXT[p]], REROLE + extra)
    return _times(_inserts(), tuple(map(tuple, row)))


@lru_cache(maxsize=1 << 16)
def _advance(symbol: int, count: int, behind: tuple) -> tuple:
    j = 0
    while count:
        if count & 1:
            m = power(symbol, j)
            behind = tuple(min(_NEVER, *(x + v for x, v in zip(row, behind, strict=True))) for row in m)
        count, j = count >> 1, j + 1
    return behind


def advance(symbol: int, count: int, behind: tuple) -> tuple:
    """Least costs from each state before `count` rows of a symbol, given those behind them."""
    least = min(behind)
    made = _advance(symbol, count, tuple(min(_NEVER, v - least) for v in behind))  # costs less their least: few vectors recur
    return tuple(min(_NEVER, v + least) for v in made)


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, behind: tuple, state: int) -> tuple[str, int]:
    """Letters up to and with one row's own edit, least letter first, and the state after it."""
    before, letters = _advance(symbol, 1, behind), ""
    initial, fault = divmod(symbol, 3)
    while True:
        if before[state] == DELETE + behind[state]:
            return letters + "D", state
        if before[state] == INSERT + before[_NEXT[state]]:
            letters, state = letters + "I", _NEXT[state]
            continue
        extra, q = TRUNCATED if fault == 2 else 0, _kept(state, initial)
        if q >= 0 and before[state] == KEEP + extra + behind[q]:
            return letters + "K", q
        return letters + "R", _NEXT[state]


def runs(symbols: bytes) -> tuple[list[int], list[int]]:
    """Symbols and lengths of runs of equal ones."""
    x = np.frombuffer(symbols, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at].tolist(), np.diff(np.append(at, len(x))).tolist()


def costs_before(symbols: bytes, behind: tuple) -> tuple:
    for s, n in zip(*(reversed(x) for x in runs(symbols)), strict=True):
        behind = advance(s, n, behind)
    return behind


def unroll(symbols: bytes, behind: tuple, state: int, last: bool) -> tuple[str, int]:
    """The audit of a segment from a state, and the state after it; a last one also gets the rows that end it."""
    values = []  # costs behind each run, then inside a run behind each row
    for s, n in zip(*(reversed(x) for x in runs(symbols)), strict=True):
        values.append((s, n, behind))
        behind = advance(s, n, behind)
    out = []
    for s, n, v in reversed(values):
        least = min(v)
        inside = [tuple(min(_NEVER, c - least) for c in v)]
        for _ in range(n - 1):
            made = _advance(s, 1, inside[-1])
            least = min(made)
            inside.append(tuple(min(_NEVER, c - least) for c in made))
        for w in reversed(inside):
            letters, state = _choice(s, w, state)
            out.append(letters)
    if last:
        while _END[state]:
            out.append("I")
            state = _NEXT[state]
    return "".join(out), state


def repaired_lines(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of what an audit leaves of the rows of its segment."""
    for letter in audit:
        if letter == "I":
            yield _ROLE[state] + ":"
            state = _NEXT[state]
            continue
        role, text = next(rows)
        if letter == "K":
            yield f"{role}:{text}"
            state = _kept(state, (_INITIALS + "?").index(role[0] if role[:1] in _INITIALS else "?"))
        elif letter == "R":
            yield f"{_ROLE[state]}:{text}"
            state = _NEXT[state]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with one row in four damaged, by a checksum of conversation and turn; a null counts as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies).drop("copy")


_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64())),
}


def _streamed(df: DataFrame, of, columns: str) -> DataFrame:
    """conv_id and columns of what of(rows in order) yields for each partition, some megabytes at a time."""
    fields = [tuple(c.split()) for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def rows():
            for b in batches:
                kind[:] = [b.schema.field("conv_id").type]
                for lo in range(0, b.num_rows, 256):
                    yield from b.slice(lo, 256).to_pylist()

        def batch():
            return pa.RecordBatch.from_pylist(made, pa.schema([("conv_id", kind[0]), *((n, _KINDS[k]) for n, k in fields)]))

        made, weight = [], 0
        for row in of(rows()):
            made.append(row)
            weight += 64 + sum(len(v) for v in row.values() if isinstance(v, (str, bytes, list)))
            if weight > 4 * BLOCK:
                yield batch()
                made, weight = [], 0
        if made:
            yield batch()

    return df.mapInArrow(run, f"conv_id {dict(df.dtypes)['conv_id']}, {columns}")


def _summed(rows):
    """Each segment's symbols, counts, ends and matrix."""
    for r in rows:
        f, first = np.array([x["f"] for x in r["rows"]], np.int64), [x["first"] for x in r["rows"]]
        faults = f % 4
        symbols = (3 * (f // 4) + np.array([0, 1, 1, 2])[faults]).astype(np.uint8).tobytes()
        columns = [costs_before(symbols, tuple(0 if i == j else _NEVER for i in range(4))) for j in range(4)]
        counts = {c: int((faults == i + 1).sum()) for i, c in enumerate(("blank", "duplicate", "truncated"))}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        yield {"conv_id": r["conv_id"], "range": r["range"], "symbols": symbols, **counts, "illegal": illegal, "head": first[0], "tail": first[-1], "matrix": [[c[i] for c in columns] for i in range(4)]}


def _backward(rows):
    """Segments from a conversation's last to its first: the least costs behind each, and the cost of all at the first."""
    for r in rows:
        behind = _END if r["last"] else before
        before = tuple(min(_NEVER, *(x + v for x, v in zip(row, behind, strict=True))) for row in r.pop("matrix"))
        yield r | {"behind": list(behind), "cost": before[0] if r["first"] else 0}


def _outcomes(rows):
    """A segment's audit and last state for each state that it may begin in."""
    for r in rows:
        symbols, behind, last = r.pop("symbols"), tuple(r.pop("behind")), r["last"]
        made = [unroll(symbols, behind, p, last) for p in range(1 if r["first"] else 4)]
        yield r | {"audits": [a for a, _ in made], "exits": [q for _, q in made]}


def _forward(rows):
    """Segments in order: the audit that the ones before lead to, its state, and whether a line goes before it."""
    for r in rows:
        if r["first"]:
            state, line, tail = 0, False, None
        audit = r.pop("audits")[state]
        head, own = r.pop("head"), r.pop("tail")
        r["illegal"] += tail is not None and tail + head not in ("su", "ua", "au")
        yield r | {"audit": audit, "state": state, "line": line}
        state, line, tail = r.pop("exits")[state], line or audit.strip("D") != "", own


def _texts(rows):
    """A segment's repaired text in blocks, or its digest where it is a whole conversation; its audit comes first."""
    held = next(rows, None)
    while held is not None:
        head, following = held, []

        def own():
            for r in rows:
                if r["audit"] is not None:
                    following.append(r)
                    return
                yield r["role"], r["text"]

        whole, line, block, made, digest, turns = head["first"] and head["last"], head["line"], 0, bytearray(), hashlib.sha256(), own()
        for text in repaired_lines(head["audit"], head["state"], turns):
            made += (b"\n" if line else b"") + text.encode()
            line = True
            while len(made) >= BLOCK:
                if whole:
                    digest.update(made[:BLOCK])
                else:
                    yield {"conv_id": head["conv_id"], "range": head["range"], "block": block, "bytes": bytes(made[:BLOCK]), "sha": None}
                del made[:BLOCK]
                block += 1
        for _ in turns:  # rows behind the last edit: none, but the next audit is read
            pass
        digest.update(made)
        yield {"conv_id": head["conv_id"], "range": head["range"], "block": block, "bytes": None if whole else bytes(made), "sha": digest.hexdigest() if whole else None}
        held = following[0] if following else None


def _digests(rows):
    """One hash of each conversation's blocks in order."""
    own, digest = None, None
    for r in rows:
        if digest is None or r["conv_id"] != own:
            if digest is not None:
                yield {"conv_id": own, "sha": digest.hexdigest()}
            own, digest = r["conv_id"], hashlib.sha256()
        digest.update(r["bytes"])
    if digest is not None:
        yield {"conv_id": own, "sha": digest.hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repaired text of each conversation of (conv_id, turn, role, text).

    Rows are taken by turn, nulls first; rows of one turn by role and text (the first
    64 characters of each, then a hash). A null role or text counts as one space. A
    null conv_id is a conversation of its own. Other columns are left out. No row, no
    conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    order = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.xxhash64("role", "text"), "salt"]
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # so that equal rows can be split; any order of theirs is the same
    spread = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    ends = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(ends == "", 1).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    marks = {"at": F.monotonically_increasing_id(), "k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(7), "text", "role"), "initial": initial, "first": F.left("role", F.lit(1)), "fault": fault}
    turns = materialize(spread.withColumns(marks), "turns").withColumn("range", F.shiftright("at", 33))

    # a row is a duplicate unless it is the first of its role and text; firsts go back by their place, so that no group is held
    firsts = turns.groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    seen = turns.select("conv_id", "range", "at", "initial", "first", "fault").join(firsts, "at", "left")
    number = F.col("initial") * 4 + F.when((F.col("fault") != 1) & F.col("fresh").isNull(), 2).otherwise(F.col("fault"))
    segments = seen.groupBy("conv_id", "range").agg(F.array_sort(F.collect_list(F.struct("at", number.alias("f"), "first"))).alias("rows"))  # at most a range's rows
    counts = "range bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    segments = _streamed(segments, _summed, f"{counts}, symbols binary, head string, tail string, matrix array<array<bigint>>")

    by = Window.partitionBy("conv_id").orderBy(F.desc("range"))
    segments = segments.withColumns({"last": F.lag("range").over(by).isNull(), "first": F.lead("range").over(by).isNull()}).sortWithinPartitions("conv_id", F.desc("range"))
    ends_of = f"{counts}, first boolean, last boolean, cost bigint"
    segments = _streamed(segments, _backward, f"{ends_of}, symbols binary, head string, tail string, behind array<bigint>").repartition("conv_id", "range")
    segments = _streamed(segments, _outcomes, f"{ends_of}, head string, tail string, audits array<string>, exits array<bigint>").repartition("conv_id").sortWithinPartitions("conv_id", "range")
    audits = materialize(_streamed(segments, _forward, f"{ends_of}, audit string, state bigint, line boolean"), "audits")

    heads = audits.select("conv_id", "range", F.lit(-1).cast("bigint").alias("at"), "audit", "state", "line", "first", "last")
    texts = heads.unionByName(turns.select("conv_id", "range", "at", "role", "text"), allowMissingColumns=True).repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "at")
    blocks = materialize(_streamed(texts, _texts, "range bigint, block bigint, bytes binary, sha string"), "blocks")
    parts = blocks.where("sha IS NULL").select("conv_id", "range", "block", "bytes").repartition("conv_id").sortWithinPartitions("conv_id", "range", "block")
    digests = blocks.where("sha IS NOT NULL").select("conv_id", "sha").unionByName(_streamed(parts, _digests, "sha string"))

    span = turns.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    both = audits.drop("first", "last", "state", "line").unionByName(digests, allowMissingColumns=True).unionByName(span, allowMissingColumns=True)
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("range", "audit")))), lambda p: p["audit"])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.groupBy("conv_id").agg(*sums, F.array_join(pieces, "").alias("audit"), F.max("sha").alias("repaired_sha256"))


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    """Every conversation's repair after one row in four is damaged; one without rows has zeros and the empty string's digest."""
    rows = table(spark, sf_dir, "conversations")
    none = [F.lit(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = rows.select("conv_id", *none, F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")).distinct()
    both = every.unionByName(repair(damage(rows)))
    sums = [F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return both.groupBy("conv_id").agg(*sums, F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
