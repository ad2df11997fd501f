"""Conversation structure repair: one solution for each distinct signature of roles and faults.

Each row becomes one letter of its role and fault, a conversation a string of them. Each distinct string is solved once: the
least-cost edits that make the roles read (s?(ua)+)?, by memoised recursion from the end. Audits are joined back by the string
and replayed on the rows in order, which yields the repaired rows or their hash.

Letters: s u a o (system, user, assistant, other) of sound rows, S U A O of truncated ones, x of blank and repeated ones. An
audit is the edits' initials: Keep, Rerole, Delete, Insert; roles follow from it, as the pattern allows one role at a place.

Rows stand by turn (nulls first), then role, then text. Null values of role and text are read as one space; rows of a null
conversation id are one conversation; equal rows are repeats, and all but the first are deleted; an empty table gives no rows.
Other columns are not read. A conversation's rows meet in one task, sorted on disk and read once in order, as a hash over all of
its text asks for; held are one letter a row and the batch at hand. Signatures are put together from parts of ``PART`` rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.llm.common import col, scratch, table

# Fixed by the contract: blanks, ends of sentences, costs of edits, what a truncated row adds if it stays.
BLANKS, ENDS = " \t\n\x0b\x0c\r", [".", "!", "?"]
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

PART = 4096  # rows whose letters are put together at a time
STRIDE = 64  # depth of the recursion
BROADCAST_BYTES = 32 << 20

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]

# States: nothing yet, after system, after user, after assistant. WANTED: the role that the pattern asks for next.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
REACHED = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)


def follows(state: int, role: str) -> bool:
    return role == WANTED[state] or (role == "s" and state == START)


@lru_cache(maxsize=1 << 16)
def step(letter: str, after: tuple) -> tuple[tuple, str]:
    """(costs from before a row on, by state; the least initial of a cheapest edit there, by state), given those from after it."""
    role, more = letter.lower(), TRUNCATED * letter.isupper()
    ways: list[dict] = []
    for s in range(4):
        way = {"D": DELETE + after[s]}
        if letter != "x":
            way["R"] = REROLE + more + after[REACHED[WANTED[s]]]
            if follows(s, role):
                way["K"] = more + after[REACHED[role]]
        ways.append(way)
    least = [min(w.values()) for w in ways]
    costs = list(least)
    for s in (USER, ASSISTANT, START, SYSTEM):  # two inserts in a row help at the start only, a third one never does
        to = REACHED[WANTED[s]]
        ways[s]["I"] = INSERT + (least if s in (USER, ASSISTANT) else costs)[to]
        costs[s] = min(ways[s].values())
    return tuple(costs), "".join(min(e for e, c in w.items() if c == costs[s]) for s, w in enumerate(ways))


@lru_cache(maxsize=1 << 15)
def back(letters: str, after: tuple) -> tuple[tuple, str]:
    """step() over letters, the first edits of all rows and states one after another; endings that signatures share are solved once."""
    if not letters:
        return after, ""
    costs, rest = back(letters[1:], after)
    costs, choice = step(letters[0], costs)
    return costs, choice + rest


def audit(signature: str) -> tuple[str, int]:
    """(edits' initials, cost): the cheapest edits, the ASCII-least of equal ones. Time and room grow with the length."""
    costs, cost, parts = AT_END, 0, []
    for at in range(-(-len(signature) // STRIDE) * STRIDE - STRIDE, -1, -STRIDE):
        costs, choices = back(signature[at : at + STRIDE], costs)
        least = min(costs)  # costs differ by little, so the same few tuples come again
        costs, cost = tuple(c - least for c in costs), cost + least
        parts.append(choices)
    cost += costs[START]
    edits, state, i, choices = [], START, 0, "".join(reversed(parts))
    while i < len(signature):
        edit = choices[4 * i + state]
        edits.append(edit)
        if edit in "RI":
            state = REACHED[WANTED[state]]
        elif edit == "K":
            state = REACHED[signature[i].lower()]
        i += edit != "I"
    edits.append("I" * (AT_END[state] // INSERT))
    return "".join(edits), cost


def damaged(rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, turn, role, text, live): the contract's damage, by crc32 of "conv_id:turn". A dropped row stays with live false, so
    that its conversation is still known."""
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    kept = rows.select(col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), hit.alias("hit"))
    body = F.when(F.col("hit") <= 1, "").when(F.col("hit") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return kept.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("hit") > 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def standing(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, live: str | None) -> DataFrame:
    """(key, conv_id, live, turn, role, text): key is a string that tells a null id from all others."""
    there = F.coalesce(col(live), F.lit(False)) if live else F.lit(True)
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), col(conv_id).cast("string")), F.lit(" "))
    return rows.select(key.alias("key"), col(conv_id).alias("conv_id"), there.alias("live"), col(turn).cast("long").alias("turn"), spaced(role).alias("role"), F.when(there, spaced(text)).otherwise("").alias("text"))


def _letter(role: Column, fault: Column) -> Column:
    own = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(own)).otherwise(own)


def signatures(rows: DataFrame) -> DataFrame:
    """(key, conv_id, gaps, blank, duplicate, truncated, illegal, signature), a row per conversation, of standing rows."""
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(end, F.lit(1)).isin(ENDS), "truncated").otherwise("")
    nth = F.row_number().over(Window.partitionBy("key", "live", "role", "text").orderBy(F.asc_nulls_first("turn")))
    order = Window.partitionBy("key").orderBy(F.desc("live"), F.asc_nulls_first("turn"), "role", "text", "nth")
    initial = F.left("role", F.lit(1))
    seen = rows.withColumn("nth", nth).select(
        "key", "conv_id", "live", "turn", initial.alias("initial"), fault.alias("fault"), F.row_number().over(order).alias("at"),
        F.lag("turn").over(order).alias("turn_before"), F.concat(F.lag(initial).over(order), initial).alias("pair"),
    ).withColumn("turn", F.when(F.col("live"), F.col("turn")))
    count = lambda test, name: F.sum(F.when(F.col("live") & test, 1).otherwise(0)).alias(name)
    letters = F.collect_list(F.when(F.col("live"), F.struct("at", _letter(F.col("initial"), F.col("fault")).alias("letter"))))
    parts = seen.groupBy("key", F.floor((F.col("at") - 1) / PART).alias("part")).agg(
        F.first("conv_id").alias("conv_id"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")), "turns"),
        *(count(F.col("fault") == x, x) for x in ("blank", "duplicate", "truncated")), count(~F.col("pair").isin("su", "ua", "au"), "illegal"),
        F.array_join(F.transform(F.array_sort(letters), lambda x: x["letter"]), "").alias("piece"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0).cast("long"))
    return parts.groupBy("key").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), *(F.sum(c).alias(c) for c in COUNTS[1:]), whole.alias("signature"))


def solve(found: DataFrame) -> DataFrame:
    """found with audit and cost. Each distinct signature is solved once; a frequent one joins by broadcast behind a check of the
    bytes, or by a shuffled join whose hot keys adaptive execution splits."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            each = b.column(0).to_pylist()
            audits, costs = zip(*map(audit, each)) if each else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string()), pa.array(audits, pa.string()), pa.array(costs, pa.int64())], ["signature", "audit", "cost"])

    solved = scratch(found.select("signature").distinct().mapInArrow(run, "signature string, audit string, cost long"))
    size = solved.agg(F.coalesce(F.sum(F.octet_length("signature") + F.octet_length("audit") + 64), F.lit(0))).first()[0]
    return found.join(F.broadcast(solved) if size <= BROADCAST_BYTES else solved.hint("merge"), "signature")


def _replayed(rows: DataFrame, audits: DataFrame, emit, schema: str) -> DataFrame:
    """Rows that emit() makes of each conversation: emit(facts) gives a pair of functions, row(role, text) for each repaired row in
    order and end(), each of which returns a list of output rows."""
    facts = [*COUNTS, "cost"]
    nothing = [F.lit(None).cast("long").alias(c) for c in facts]
    head = audits.select("key", F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"), *facts)
    body = rows.where("live").select("key", F.lit(1).alias("kind"), "conv_id", "turn", "role", "text", *nothing)
    both = head.unionByName(body).repartition("key").sortWithinPartitions("key", "kind", F.asc_nulls_first("turn"), "role", "text")
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        edits, at, state, row, end = "", 0, START, None, None

        def inserted():
            nonlocal at, state
            out = []
            while at < len(edits) and edits[at] == "I":
                want = WANTED[state]
                state, at = REACHED[want], at + 1
                out += row(NAMES[want], "")
            return out

        def written(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t.type) for i, t in enumerate(arrow)], names)

        for b in batches:
            out, cols = [], [b.column(i).to_pylist() for i in range(1, b.num_columns)]
            for kind, conv, _, role, text, *known in zip(*cols):
                if kind == 0:
                    if end:
                        out += inserted() + end()
                    edits, at, state = role, 0, START
                    row, end = emit(conv, edits, dict(zip(facts, known)))
                    continue
                out += inserted()
                edit, at = edits[at], at + 1
                if edit == "K":
                    state = REACHED[role[:1]]
                    out += row(role, text)
                elif edit == "R":
                    want = WANTED[state]
                    state = REACHED[want]
                    out += row(NAMES[want], text)
            yield written(out)
        if end:
            yield written(inserted() + end())

    return both.mapInArrow(run, schema)


def _solved(rows, conv_id, turn, role, text, live):
    stand = standing(rows, conv_id, turn, role, text, live)
    return stand, scratch(solve(scratch(signatures(stand))))


def _id_type(rows: DataFrame, conv_id: str) -> str:
    return rows.select(col(conv_id)).schema[0].dataType.simpleString()


def report(rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", live: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation. live: a flag; a
    conversation whose rows all lack it has zeros, an empty audit and the hash of nothing."""
    stand, audits = _solved(rows, conv_id, turn, role, text, live)

    def emit(conv, edits, facts):
        whole, begun = hashlib.sha256(), [b""]

        def row(role, text):
            whole.update(begun[0] + f"{role}:{text}".encode())
            begun[0] = b"\n"
            return []

        return row, lambda: [(conv, *(facts[c] for c in COUNTS), facts["cost"], edits, whole.hexdigest())]

    counts = ", ".join(f"{c} long" for c in [*COUNTS, "cost"])
    return _replayed(stand, audits, emit, f"conv_id {_id_type(rows, conv_id)}, {counts}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", live: str | None = None) -> DataFrame:
    """(conv_id, place, role, text): the repaired rows, places from 0. A conversation that is deleted whole has none."""
    stand, audits = _solved(rows, conv_id, turn, role, text, live)

    def emit(conv, edits, facts):
        place = [-1]

        def row(role, text):
            place[0] += 1
            return [(conv, place[0], role, text)]

        return row, list

    return _replayed(stand, audits, emit, f"conv_id {_id_type(rows, conv_id)}, place long, role string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")), live="live")
