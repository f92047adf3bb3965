"""Repair of the turn structure of conversations by a dynamic programme with checkpoints.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: an optional system row, then user and assistant
in turns. Rows may be kept, given the role that is due, or deleted, and empty rows inserted, each at a cost. The state
is the role last given; a vector holds the least cost from each state to the end. Vectors are computed backwards and
stored at checkpoints only; walking forward, a block is computed once more from the checkpoint behind it, and of the
edits that are tight (that reach the least cost) the first in ASCII order is taken.

Conversations lie in blocks of bounded size, cut where a range partition ends too, so one that holds a third of all rows
is the work of many tasks: the ends of blocks are checkpoints. What a block does to a vector is a matrix of 4 x 4, so
the vectors behind all blocks come from products, first inside a partition, then over the partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map

#: Rows and bytes of text in a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 22
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 40

# States: nothing yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or renamed row leads to.
DUE = (USER, USER, ASSISTANT, USER)
#: Costs from each state at the end: an empty conversation and one that ends with the assistant need nothing more.
END = (0, 2 * INSERT, INSERT, 0)
#: A row as one number: its state, 0 for other roles, and bits for faults.
CUT, DROP = 4, 8


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: initial, cost, next state."""
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if not code & DROP:
            extra, role = TRUNCATED if code & CUT else 0, code & 3
            if role and (role == DUE[state] or (role, state) == (SYSTEM, START)):
                edits.append(("K", extra, role))
            edits.append(("R", RENAME + extra, DUE[state]))
        out.append(edits)
    return out


EDITS = [_edits(code) for code in range(16)]


def _before(code: int, after: tuple) -> tuple:
    """The vector before a row, insertions ahead of it included, from the vector behind it."""
    w = [min([cost + after[to] for _, cost, to in edits]) for edits in EDITS[code]]
    user = min(w[USER], INSERT + w[ASSISTANT])
    return min(w[START], INSERT + user), min(w[SYSTEM], INSERT + user), user, min(w[ASSISTANT], INSERT + w[USER])


def tight_edits(codes: bytes, start: int, end: tuple, last: bool) -> tuple[list[tuple[str, int, int]], int, int]:
    """The ASCII-least cheapest edits of the rows from state ``start``, before costs ``end``.

    Each edit is (initial, row or -1, state it leads to). ``last`` adds the insertions behind the last row. Returns the
    edits, their cost and the state after them. Vectors are held for two times the square root of the rows only.
    """
    n, edits, cost, state = len(codes), [], 0, start
    step = isqrt(n) + 1
    checkpoints, vector = {n: tuple(end)}, tuple(end)
    for i in range(n - 1, -1, -1):
        vector = _before(codes[i], vector)
        if i % step == 0:
            checkpoints[i] = vector
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        vectors = [checkpoints[stop]]
        for i in range(stop - 1, begin, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.append(checkpoints[begin])
        for i in range(begin, stop):
            here, after = vectors.pop(), vectors[-1]
            row = EDITS[codes[i]]
            while True:
                least = here[state]
                options = row[state]
                if DELETE + after[state] == least:
                    letter, spent, to = options[0]
                elif INSERT + here[DUE[state]] == least:
                    edits.append(("I", -1, DUE[state]))
                    cost, state = cost + INSERT, DUE[state]
                    continue
                else:
                    letter, spent, to = next(e for e in options if e[1] + after[e[2]] == least)
                edits.append((letter, i, to))
                cost, state = cost + spent, to
                break
    while last and END[state]:
        edits.append(("I", -1, DUE[state]))
        cost, state = cost + INSERT, DUE[state]
    return edits, cost, state


def _matrix(codes: bytes) -> np.ndarray:
    """Least costs from each state before the rows to each state behind them."""
    columns = []
    for to in range(4):
        vector = tuple(0 if q == to else FAR for q in range(4))
        for code in reversed(codes):
            vector = _before(code, vector)
        columns.append(vector)
    return np.array(columns, np.int64).T


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


_BLOCK = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("faults", pa.binary())]
    + [("firsts", pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int32())])))]
    + [("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("illegal", pa.int64())]
)
_BLOCK_DDL = (
    "key string, part int, block int, whole boolean, roles array<string>, texts array<string>, codes binary, faults binary, "
    "firsts array<struct<digest:binary,at:int>>, turns bigint, least bigint, most bigint, illegal bigint"
)
_NO_FAULT, _BLANK, _DUPLICATE, _CUT = range(4)


def _block(key: str, number: int, whole: bool, rows: list[tuple]) -> dict:
    seen: dict[bytes, int] = {}
    codes, faults = bytearray(), bytearray()
    for i, (_, role, text) in enumerate(rows):
        body, code, fault = text.rstrip(SPACES), STATES.get(role[:1], 0), _NO_FAULT
        digest = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
        if not body:
            code, fault = code | DROP, _BLANK
        else:
            if seen.setdefault(digest, i) != i:
                code, fault = code | DROP, _DUPLICATE
            elif body[-1] not in ".!?":
                code, fault = code | CUT, _CUT
        codes.append(code)
        faults.append(fault)
    known = sorted({turn for turn, _, _ in rows if turn is not None})
    initials = [role[:1] for _, role, _ in rows]
    return {
        "key": key, "part": TaskContext.get().partitionId(), "block": number, "whole": whole,
        "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "codes": bytes(codes), "faults": bytes(faults),
        "firsts": [] if whole else [{"digest": d, "at": i} for d, i in seen.items()],
        "turns": len(known), "least": known[0] if known else None, "most": known[-1] if known else None,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
    }


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of one conversation. A block is whole if rows of other conversations stand on both sides."""
    key, rows, held, number, opened, out = None, [], 0, 0, True, []

    def flush(whole: bool) -> None:
        nonlocal rows, held, number
        out.append(_block(key, number, whole, rows))
        rows, held, number = [], 0, number + 1

    for batch in batches:
        for k, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text")), strict=True):
            if k != key:
                if rows:
                    flush(not opened)
                # Only the first conversation of a partition may have begun in another one.
                opened = key is None
                key = k
            elif len(rows) == BLOCK_ROWS or held + len(text) > BLOCK_BYTES:
                opened = True
                flush(False)
            rows.append((turn, role, text))
            held += len(text)
            if sum(len(b["codes"]) for b in out) > BLOCK_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
                out = []
    if rows:
        flush(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_matrix(codes).ravel().tolist() for codes in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.select(["key", "part", "block"]).columns, pa.array(found, pa.list_(pa.int64()))], names=["key", "part", "block", "m"])


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state before a block the one after it, as a matrix of costs 0, to be applied from the right."""
    for batch in batches:
        found = []
        for codes, end in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist(), strict=True):
            m = np.full((4, 4), FAR, np.int64)
            for state in range(4):
                m[tight_edits(codes, state, end, False)[2], state] = 0
            found.append(m.ravel().tolist())
        yield pa.RecordBatch.from_arrays([*batch.select(["key", "part", "block"]).columns, pa.array(found, pa.list_(pa.int64()))], names=["key", "part", "block", "m"])


def _scan(matrices: DataFrame, seed: tuple, backwards: bool, name: str) -> DataFrame:
    """(key, part, block, ``name``): the vector that comes to each block of ``matrices`` (key, part, block, m) when all
    blocks of its key before it, or behind it if ``backwards``, have been applied to ``seed`` one after the other.

    Blocks of one key and part are multiplied first, so a group holds the blocks of a partition, or one row per partition.
    """

    def ordered(frame: pd.DataFrame, by: str) -> list[tuple]:
        frame = frame.sort_values(by, ascending=not backwards)
        return [(row, np.asarray(row.m, np.int64).reshape(4, 4)) for row in frame.itertuples()]

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, m in ordered(frame, "block"):
            whole = m if whole is None else _times(m, whole)
        return pd.DataFrame([(frame.key.iloc[0], frame.part.iloc[0], whole.ravel().tolist())], columns=["key", "part", "m"])

    def walk(frame: pd.DataFrame, by: str, vector: np.ndarray) -> list:
        out = []
        for row, m in ordered(frame, by):
            out.append((row, vector.tolist()))
            vector = np.minimum((m + vector[None, :]).min(axis=1), FAR)
        return out

    def over_parts(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(r.key, r.part, v) for r, v in walk(frame, "part", np.array(seed, np.int64))], columns=["key", "part", "given"])

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        first = np.asarray(frame.given.iloc[0], np.int64)
        return pd.DataFrame([(r.key, r.part, r.block, v) for r, v in walk(frame, "block", first)], columns=["key", "part", "block", name])

    parts = matrices.groupBy("key", "part").applyInPandas(total, "key string, part int, m array<bigint>")
    given = parts.groupBy("key").applyInPandas(over_parts, "key string, part int, given array<bigint>")
    joined = matrices.join(given, ["key", "part"])
    return joined.groupBy("key", "part").applyInPandas(inside, f"key string, part int, block int, {name} array<bigint>")


_EDITED = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_())]
    + [("edits", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("cost", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most")]
    + [("head", pa.string()), ("tail", pa.string())]
)
_EDITED_DDL = (
    "key string, part int, block int, whole boolean, edits string, roles array<string>, texts array<string>, cost bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, least bigint, most bigint, head string, tail string"
)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to their edits and repaired rows. The roles and texts of deleted rows are null."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            out = []
            for row in batch.slice(at, 16).to_pylist():
                end, start, last = (row["end"], row["state"], row["last"]) if not row["whole"] else (END, START, True)
                edits, cost, _ = tight_edits(row["codes"], start, tuple(end), last)
                roles, texts = [], []
                for letter, i, to in edits:
                    roles.append(None if letter == "D" else row["roles"][i] if letter == "K" else NAMES[to])
                    texts.append(None if letter == "D" else "" if letter == "I" else row["texts"][i])
                count = row["faults"].count
                out.append(
                    {c: row[c] for c in ("key", "part", "block", "whole", "illegal", "turns", "least", "most")}
                    | {"edits": "".join([e[0] for e in edits]), "roles": roles, "texts": texts, "cost": cost}
                    | {"blank": count(_BLANK), "duplicate": count(_DUPLICATE), "truncated": count(_CUT)}
                    | {"head": row["roles"][0][:1], "tail": row["roles"][-1][:1]}
                )
            yield pa.RecordBatch.from_pylist(out, schema=_EDITED)


def _mended(late: list[int] | None, codes: bytes, faults: bytes) -> tuple[bytes, bytes]:
    """Codes and faults with the rows at ``late`` as duplicates."""
    codes, faults = bytearray(codes), bytearray(faults)
    for i in late or []:
        codes[i] = codes[i] & 3 | DROP
        faults[i] = _DUPLICATE
    return bytes(codes), bytes(faults)


def _with_late(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "part", "block"]
    for batch in batches:
        pairs = [_mended(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("late", "codes", "faults")), strict=True)]
        columns = [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *columns], names=[*names, "codes", "faults"])


def _key(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def repair_blocks(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edited blocks of conversations, as ``repair`` and ``audit`` unfold them."""
    picked = rows.select(
        _key(conversation).alias("key"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    # Rows that are equal in all are spread by their number.
    placed = picked.withColumn("digest", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("spread")]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(arrow_map(ranged.select("key", "turn", "role", "text"), _blocks, _BLOCK_DDL), "blocks")
    parted = blocks.where("not whole")
    here = ["key", "part", "block"]
    firsts = parted.select(*here, F.explode("firsts").alias("first")).select(*here, "first.digest", "first.at")
    # One row a block for a text that is repeated throughout a conversation.
    first = firsts.groupBy("key", "digest").agg(F.min(F.struct("part", "block")).alias("least"))
    late = firsts.join(first, ["key", "digest"]).where(F.struct("part", "block") > F.col("least"))
    late = late.groupBy(*here).agg(F.collect_list("at").alias("late"))
    codes = parted.select(*here, "codes", "faults").join(late, here, "left")
    codes = written(arrow_map(codes, _with_late, "key string, part int, block int, codes binary, faults binary"), "codes")
    matrices = written(arrow_map(codes, _products, "key string, part int, block int, m array<bigint>"), "matrices")
    ends = written(_scan(matrices, END, True, "end"), "ends")
    steps = arrow_map(codes.join(ends, here), _steps, "key string, part int, block int, m array<bigint>")
    starts = _scan(written(steps, "steps"), (0, FAR, FAR, FAR), False, "start")
    # The last block of a conversation is the one whose end is that of the conversation; others may have the same costs.
    final = codes.groupBy("key").agg(F.max(F.struct("part", "block")).alias("final"))
    plan = codes.join(ends, here).join(starts, here).join(final, "key")
    plan = plan.select(
        *here, "codes", "faults", "end", (F.array_position("start", F.lit(0).cast("bigint")) - 1).cast("int").alias("state"),
        (F.struct("part", "block") == F.col("final")).alias("last"),
    )
    rest = parted.drop("codes", "faults", "firsts").join(written(plan, "plan"), here)
    whole = blocks.where("whole").drop("firsts").withColumns(
        {"end": F.lit(None).cast("array<bigint>"), "state": F.lit(None).cast("int"), "last": F.lit(None).cast("boolean")}
    )
    return arrow_map(whole.unionByName(rest), _edited, _EDITED_DDL)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, place, edit, role, text): the rows of each conversation with their edits, in the order of ``place``.

    Edits are K (kept), R (given the role that is due), D (deleted; its role and text are null) and I (inserted, empty).
    """
    edited = repair_blocks(rows, conversation, turn, role, text)
    letters = F.transform(F.sequence(F.lit(1), F.length("edits")), lambda i: F.substring("edits", i, F.lit(1)))
    parts = edited.select("key", "part", "block", F.posexplode(F.arrays_zip(letters.alias("edit"), "roles", "texts")).alias("at", "row"))
    place = (F.col("part").cast("bigint") * (1 << 24) + F.col("block")) * BLOCK_ROWS * 8 + F.col("at")
    flat = parts.select("key", place.alias("place"), "row.*").toDF("key", "place", "edit", "role", "text")
    names = rows.select(F.col(conversation)).distinct().withColumn("key", _key(conversation))
    return names.join(flat, "key").drop("key")


_REPORT_DDL = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their conversations to one report each; holds one block and the edits so far."""
    names = [field.split()[0] for field in _REPORT_DDL.split(", ")]
    kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2
    out: list[tuple] = []
    key = tail = most = least = digest = None
    sums, turns, audit, rows = [0] * 5, 0, [], 0

    def close() -> None:
        if key is not None:
            gaps = most - least + 1 - turns if turns else 0
            out.append((key, gaps, *sums, "".join(audit), digest.hexdigest()))

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for at in range(batch.num_rows):
            block = batch.slice(at, 1).to_pylist()[0]
            if block["key"] != key:
                close()
                if len(out) >= 1024:
                    yield packed()
                    out = []
                key, tail, least, most, digest = block["key"], None, None, None, hashlib.sha256()
                sums, turns, audit, rows = [0] * 5, 0, [], 0
            for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                sums[k] += block[c]
            sums[3] += tail is not None and tail + block["head"] not in ("su", "ua", "au")
            if block["turns"]:
                turns += block["turns"] - (block["least"] == most)
                least, most = block["least"] if least is None else least, block["most"]
            tail = block["tail"]
            audit.append(block["edits"])
            for role, text in zip(block["roles"], block["texts"], strict=True):
                if role is not None:
                    digest.update((("\n" if rows else "") + f"{role}:{text}").encode())
                    rows += 1
    close()
    if out:
        yield packed()


def audit(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", all_rows: DataFrame | None = None) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows stand by turn, null first, then by role and a hash of the text. A row is blank without other than white space,
    else a duplicate if its role and text came before in the conversation, else truncated if its last character other
    than white space is none of ``.!?``. ``gaps`` are turns left out between the first and the last, null turns ignored;
    ``illegal`` counts neighbours whose role initials are not su, ua or au. ``audit`` has the initials of the cheapest
    edits, the ASCII-least of them, and the digest is of the repaired ``role:text`` rows joined by line feeds.

    A null role or text is one space; null conversations are one. Conversations of ``all_rows`` without a row in
    ``rows`` have zeros. Repeated rows are duplicates; other columns are ignored; an empty table gives no rows.

    SHA-256 and the audit of one conversation are single values, so the blocks of a conversation that lies in several
    pass through one task in order, a block at a time; that is the only such step.
    """
    edited = written(repair_blocks(rows, conversation, turn, role, text), "edited")
    here = ["key", "part", "block"]
    rest = edited.where("not whole").repartition("key").sortWithinPartitions(*here)
    found = arrow_map(edited.where("whole"), _reports, _REPORT_DDL).union(arrow_map(rest, _reports, _REPORT_DDL))
    names = (rows if all_rows is None else all_rows).select(F.col(conversation)).distinct().withColumn("key", _key(conversation))
    empty = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return names.join(found, "key", "left").withColumns(empty).drop("key")
