"""Conversation repair as a lightest derivation.

The rows of a conversation are edited until the initials of their roles read ``(s?(ua)+)?``. Kept rows cost nothing, rows
given another role ``REROLE``, deleted ones ``DELETE`` (blank and duplicate rows must go), inserted empty turns ``INSERT``;
a truncated row that stays costs ``TRUNCATED`` more. Among the cheapest edits the one whose audit (initials of the edits
in order: D, I, K, R) comes first in ASCII wins.

Items are "rows up to i are repaired and the grammar is in state q". A deduction joins an item with an edit of the next row, or
with an insertion; its function adds costs and joins audits. That is superior in Knuth's sense: an edit never lowers
(cost, audit), and audits of equal cost over the same rows are no prefixes of each other (they would differ by insertions, which
cost), so the order of two items survives whatever follows. The agenda therefore finalises items in the order in which it pops them and stops
at the goal.

Rows are sorted once by ranges of (conversation, turn, ...), and a task repairs the conversations that lie within it as
they stream by. Those at the edge of a task or of more than ``LONG`` rows go on, row by row, in pieces of ``PIECE``
rows: pieces are derived from every grammar state to every other, a second hypergraph joins neighbouring pieces by
(cost, audit), and only pieces move, however long a conversation is. Its audit and its digest are single values by nature.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by role and text, so
repeated rows are adjacent; rows without conv_id form a conversation of their own; roles that begin with another letter
than s, u or a, or are empty, can't be kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.scale import lookup_join, numbered, within_rows
from factloom.session import cut_lineage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LONG = 4096
PIECE = 1024
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Grammar: what may follow nothing, s, u, a. The goal is reached after nothing or after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GOALS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
ADJACENT = {"su", "ua", "au"}


def _edits(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits of a row.

    A row's code is its initial (o: another one), in capitals if it is truncated; x stands for blank and duplicate rows.
    """
    out = [(DELETE, "D", state)]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        out += [(more, "K", then) for role, then in NEXT[state].items() if role == code.lower()]
        out += [(more + REROLE, "R", then) for role, then in NEXT[state].items() if role in ROLES]
    return out


_EDITS = {(code, state): _edits(code, state) for code in "suaoSUAOx" for state in range(4)}
_INSERTS = {state: [(INSERT, "I", then) for role, then in NEXT[state].items() if role in ROLES] for state in range(4)}


def derive(codes: str, start: int, goals: Iterable[int], every: bool = False) -> dict[int, tuple[int, str]]:
    """state: (cost, audit) of the cheapest repair of the rows from ``start``; the first goal alone, or ``every`` one."""
    agenda, final, found = [(0, "", 0, start)], set(), {}
    goals, n = set(goals), len(codes)
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for more, edit, then in _INSERTS[state]:
            if (i, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + edit, i, then))
        if i < n:
            for more, edit, then in _EDITS[codes[i], state]:
                if (i + 1, then) not in final:
                    heapq.heappush(agenda, (cost + more, audit + edit, i + 1, then))
    return found


@lru_cache(maxsize=50_000)
def _cheapest(codes: str) -> tuple[int, str]:
    return next(iter(derive(codes, START, GOALS).values()))


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows; roles follow from the audit and the grammar alone."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text, state = roles[at], texts[at], NEXT[state][roles[at][:1]]
        else:
            letter = "a" if state == USER else "u"
            role, text, state = ROLES[letter], "" if edit == "I" else texts[at], NEXT[state][letter]
        at += edit != "I"
        yield role, text


def faults(roles: list[str], texts: list[str]) -> tuple[str, int, int, int, int]:
    """Codes of a conversation's rows, and its blank, duplicate, truncated and illegal counts."""
    seen, codes, blank, duplicate, truncated = set(), [], 0, 0, 0
    for role, text in zip(roles, texts):
        bare, known = text.rstrip(BLANKS), (role, text) in seen
        seen.add((role, text))
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not bare:
            blank, code = blank + 1, "x"
        elif known:
            duplicate, code = duplicate + 1, "x"
        elif bare[-1] not in ENDS:
            truncated, code = truncated + 1, code.upper()
        codes.append(code)
    illegal = sum(a[:1] + b[:1] not in ADJACENT for a, b in zip(roles, roles[1:]))
    return "".join(codes), blank, duplicate, truncated, illegal


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: every row damaged by a hash of its conversation and turn; dropped rows are not present."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, r"[.!?]", "")).when(fault == 0, F.lit(None)).otherwise(text)
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), (fault != 0).alias("present"), copies.alias("_copy"))
    return out.drop("_copy")


_NOBODY = object()
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _joined(lines: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in lines)


def _report(turns: list[int | None], roles: list[str], texts: list[str], with_text: bool) -> dict:
    known = {t for t in turns if t is not None}
    codes, blank, duplicate, truncated, illegal = faults(roles, texts)
    cost, audit = _cheapest(codes)
    repaired = _joined(replay(audit, START, roles, texts))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        "cost": cost, "audit": audit, "sha256": hashlib.sha256(repaired.encode("utf-8", "replace")).hexdigest(), "repaired": repaired if with_text else None,
    }


def _stream(kind: pa.DataType, with_text: bool, long: int):
    """Repairs the conversations within a task's sorted rows; rows of others come out as they went in."""
    schema = pa.schema(
        [("conv_id", kind), *[(c, pa.int64()) for c in _COUNTS], *[(c, pa.string()) for c in ("audit", "sha256", "repaired")],
         ("open", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("present", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, edge = [], _NOBODY, True  # rows of the conversation under way; whether they must be passed on

        def passed(rows: list) -> list[dict]:
            return [{"conv_id": name, "open": True, "turn": t, "role": r, "text": x, "present": p} for t, r, x, p in rows]

        def closed() -> dict:
            here = [r for r in held if r[3]]
            return {"conv_id": name, "open": False} | _report(*([r[k] for r in here] for k in range(3)), with_text)

        for batch in batches:
            out = []
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present"))):
                if name is _NOBODY:  # the first conversation may begin in another task
                    name = conv
                elif conv != name:
                    if not edge:
                        out.append(closed())
                    held, name, edge = [], conv, False
                held.append(row)
                if edge or len(held) > long:
                    out += passed(held)
                    held, edge = [], True
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:  # the last one may go on in another task
            yield pa.RecordBatch.from_pylist(passed(held), schema)

    return run


_SPANS = pa.schema(
    [("c", pa.string()), ("first", pa.int64()), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()),
     ("starts", pa.list_(pa.int32())), ("goals", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_CHOSEN = pa.schema([("c", pa.string()), ("first", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
_CHUNKS = pa.schema([("c", pa.string()), ("first", pa.int64()), ("repaired", pa.string())])
_DIGESTS = pa.schema([("c", pa.string()), ("sha256", pa.string())])


def _runs(table: pa.Table) -> Iterator[tuple[str, list[dict]]]:
    """Rows of a block, by number, cut at every change of conversation."""
    run: list[dict] = []
    for row in table.sort_by("number").to_pylist():
        if run and run[0]["c"] != row["c"]:
            yield run[0]["c"], run
            run = []
        run.append(row)
    if run:
        yield run[0]["c"], run


def _spans(table: pa.Table) -> pa.Table:
    """Every piece's cheapest repairs from each grammar state to each other."""
    out = []
    for c, run in _runs(table):
        codes, initials = "".join(r["code"] for r in run), [r["initial"] for r in run]
        spans = [(s, g, *found) for s in range(4) for g, found in derive(codes, s, range(4), every=True).items()]
        illegal = sum(a + b not in ADJACENT for a, b in zip(initials, initials[1:]))
        out.append({
            "c": c, "first": run[0]["number"], "block": run[0]["block"], "head": initials[0], "tail": initials[-1], "illegal": illegal,
            "starts": [s[0] for s in spans], "goals": [s[1] for s in spans], "costs": [s[2] for s in spans], "audits": [s[3] for s in spans],
        })
    return pa.Table.from_pylist(out, _SPANS)


def _earlier(left: tuple, right: tuple) -> bool:
    """Whether the audit of one chain of pieces comes before another's; chains of equal length that share their beginning."""
    tails = ([], [])
    while left is not right:
        tails[0].append(left[1])
        tails[1].append(right[1])
        left, right = left[0], right[0]
    return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))


def _extended(best: dict, piece: dict) -> dict:
    """state: (cost, chain) after one more piece; a chain is (chain before, audit, state before, piece)."""
    out: dict[int, tuple[int, tuple]] = {}
    for start, goal, cost, audit in zip(piece["starts"], piece["goals"], piece["costs"], piece["audits"]):
        if start not in best:
            continue
        cost, chain = best[start][0] + cost, (best[start][1], audit, start, piece)
        known = out.get(goal)
        if known is None or cost < known[0] or (cost == known[0] and _earlier(chain, known[1])):
            out[goal] = (cost, chain)
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the pieces of every conversation, in order: how each is repaired, and a row without block for the whole."""

    def finished() -> list[dict]:
        least = min(cost for state, (cost, _) in best.items() if state in GOALS)
        cost, chain = least, None
        for state in GOALS:
            if state in best and best[state][0] == least and (chain is None or _earlier(best[state][1], chain)):
                chain = best[state][1]
        out = []
        while chain:
            before, audit, start, piece = chain
            out.append({"c": name, "first": piece["first"], "block": piece["block"], "start": start, "audit": audit})
            chain = before
        return [*out, {"c": name, "audit": "".join(r["audit"] for r in reversed(out)), "cost": cost, "illegal": illegal}]

    best, name, tail, illegal = {}, None, "", 0
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if piece["c"] != name:
                if name is not None:
                    out += finished()
                best, name, tail, illegal = {START: (0, None)}, piece["c"], None, 0
            illegal += piece["illegal"] + (tail is not None and tail + piece["head"] not in ADJACENT)
            tail = piece["tail"]
            best = _extended(best, piece)
        yield pa.RecordBatch.from_pylist(out, _CHOSEN)
    if name is not None:
        yield pa.RecordBatch.from_pylist(finished(), _CHOSEN)


def _replayed(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    how = {(r["c"], r["first"]): r for r in chosen.to_pylist()}
    out = []
    for c, run in _runs(rows):
        piece = how[c, run[0]["number"]]
        text = _joined(replay(piece["audit"], piece["start"], [r["role"] for r in run], [r["text"] for r in run]))
        if text:
            out.append({"c": c, "first": run[0]["number"], "repaired": text})
    return pa.Table.from_pylist(out, _CHUNKS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation over its pieces, which stream by in order."""
    name, digest = None, None
    for batch in batches:
        out = []
        for c, text in zip(batch.column("c").to_pylist(), batch.column("repaired").to_pylist()):
            if c != name:
                if name is not None:
                    out.append({"c": name, "sha256": digest.hexdigest()})
                name, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.encode("utf-8", "replace"))
        yield pa.RecordBatch.from_pylist(out, _DIGESTS)
    if name is not None:
        yield pa.RecordBatch.from_pylist([{"c": name, "sha256": digest.hexdigest()}], _DIGESTS)


def _by_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and texts of conversations of any length: rows (conv_id, turn, role, text, present)."""
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    names = rows.select("conv_id", c.alias("c")).distinct()
    placed = rows.filter("present").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_n"))
    bare, initial = F.rtrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    code = F.when(bare == "", F.lit("x")).when(F.right(bare, F.lit(1)).isin(*ENDS), code).otherwise(F.upper(code))
    key = F.struct(c, F.col("role"), F.col("text"))
    placed = numbered(placed, ["conv_id", "turn", "role", "text", "_n"])
    placed = placed.select(
        "number", F.floor(F.col("number") / PIECE).alias("block"), c.alias("c"), "turn", "role", "text", initial.alias("initial"), code.alias("code"),
        F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"),
    )
    placed = cut_lineage(placed, "placed")
    firsts = placed.groupBy("k1", "k2").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = cut_lineage(firsts, "firsts")
    narrow = placed.select("number", "block", "c", "turn", "initial", "code", "k1", "k2")
    marked = lookup_join(narrow, firsts, ["k1", "k2"], "left", small_is_bounded=within_rows(firsts), salt_by=F.col("number"))
    again = (F.col("code") != "x") & (F.col("number") > F.col("first"))
    marked = marked.withColumns({"blank": F.col("code") == "x", "again": F.coalesce(again, F.lit(False))})
    marked = marked.withColumn("code", F.when(F.col("again"), F.lit("x")).otherwise(F.col("code")))
    marked = cut_lineage(marked.drop("k1", "k2", "first"), "marked")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("c").agg(
        F.coalesce(turns, F.lit(0)).alias("gaps"), F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"),
        F.count_if(F.col("code").isin("S", "U", "A", "O")).alias("truncated"),
    )
    spans = marked.groupBy("block").applyInArrow(_spans, "c string, first bigint, block bigint, head string, tail string, illegal bigint, starts array<int>, goals array<int>, costs array<bigint>, audits array<string>")
    chosen = spans.repartition("c").sortWithinPartitions("c", "first").mapInArrow(_fold, "c string, first bigint, block bigint, start int, audit string, cost bigint, illegal bigint")
    chosen = cut_lineage(chosen, "chosen")
    lines = placed.select("block", "number", "c", "role", "text").groupBy("block")
    parts = chosen.filter("block IS NOT NULL").select("block", "c", "first", "start", "audit").groupBy("block")
    chunks = cut_lineage(lines.cogroup(parts).applyInArrow(_replayed, "c string, first bigint, repaired string"), "chunks")
    digests = chunks.repartition("c").sortWithinPartitions("c", "first").mapInArrow(_digests, "c string, sha256 string")
    whole = chosen.filter("block IS NULL").select("c", "cost", "illegal", "audit")
    report = names.join(counts, "c", "left").join(whole, "c", "left").join(digests, "c", "left")
    zeros = {name: F.coalesce(name, F.lit(0)) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    report = report.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "sha256": F.coalesce("sha256", empty)})
    return report, names.join(chunks, "c").select("conv_id", F.col("first").alias("part"), "repaired")


def repair(rows: DataFrame, *, with_text: bool = True, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Report and repaired texts of conversations: rows (conv_id, turn, role, text, present).

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256, one row per conversation, also for one
    whose rows are all absent. The texts have conv_id, part, repaired; long conversations have several parts, without
    ``with_text`` only these are returned.
    """
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    known = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "present")
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    schema += "audit string, sha256 string, repaired string, open boolean, turn bigint, role string, text string, present boolean"
    found = cut_lineage(dealt.mapInArrow(_stream(kind, with_text, long), schema), "conversations")
    report, texts = _by_pieces(found.filter("open").select("conv_id", "turn", "role", "text", "present"))
    columns = ["conv_id", *_COUNTS, "audit", "sha256"]
    own = found.filter("NOT open")
    texts = own.filter("repaired IS NOT NULL").select("conv_id", F.lit(0).cast("bigint").alias("part"), "repaired").unionByName(texts)
    return own.select(columns).unionByName(report.select(columns)), texts
