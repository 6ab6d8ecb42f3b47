"""Repair of conversation structure: the cheapest edits that give roles of the form (s?(ua)+)?.

Fault flags come from windows over a conversation's turns; the turns are collected as one sorted array of small
structs, and ``aggregate`` folds it through the four states of the role grammar. Every state carries the cheapest
(cost, audit) that ends there; ties take the least audit. That is decided step by step without loss: two audits of
one state and cost never extend each other (the longer one would hold more inserts and cost more), so the lesser one
stays the lesser with any ending. The audit alone fixes every edit, and with it the repaired turns.

A conversation longer than BLOCK turns is folded block by block, each block from every state, and the blocks are
then joined; no step copies an audit longer than its block but the last ones, one a block.

States: 0 nothing yet, 1 after a first system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.

Cases: null conversation ids are one conversation; null turns come first; null roles and texts are one space. Equal
turns are ordered by role and text. A conversation that loses all its rows keeps a result row. An empty table gives an
empty result. Columns of other names are ignored. All of a conversation's repaired text is one value, whose hash is
asked for: it has to fit in a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
BLOCK = 256
#: Cost of a state that can't be reached.
NEVER = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
#: (state before, role of the turn, state after)
STEPS = ((0, "system", 1), (0, "user", 2), (1, "user", 2), (2, "assistant", 3), (3, "user", 2))
#: Edits as the fold writes them, by the role they give; in audits J reads I and S reads R. Where two audits first
#: differ they start from one state, which fixes the role, so the order of these letters is the order of D, I, K, R.
INSERTED = {"user": "I", "assistant": "J"}
REROLED = {"user": "R", "assistant": "S"}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of the rows after damage; a dropped row stays, marked as gone."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    hit = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.col("kind") == 0))
    return hit.select("conv_id", "turn", "role", text.alias("text"), F.explode(copies).alias("gone"))


def flag(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with initial, new_turn (none before has its turn), illegal, and the first that holds of blank, duplicate, truncated."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    before = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = rows.repartition("conv_id")  # one shuffle for both windows and for the collected turns
    out = rows.withColumn("again", F.row_number().over(seen) > 1).withColumn("initial", F.left("role", F.lit(1)))
    pair = F.concat(F.lag("initial").over(before), F.col("initial"))
    return out.select(
        *("conv_id", "turn", "role", "text", "gone", "initial"),
        F.coalesce(F.lag("turn").over(before) != F.col("turn"), F.col("turn").isNotNull()).alias("new_turn"),
        (~pair.isin("su", "ua", "au")).alias("illegal"),
        (last == "").alias("blank"),
        ((last != "") & F.col("again")).alias("duplicate"),
        ((last != "") & ~F.col("again") & ~last.isin(".", "!", "?")).alias("truncated"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _add(way: Column, cost: Column | int, edits: str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(edits)))


def _states(ways: list[Column]) -> Column:
    return F.struct(*(w.alias(f"s{k}") for k, w in enumerate(ways)))


def _start(state: int) -> Column:
    return _states([_way(F.lit(0 if k == state else NEVER), F.lit("")) for k in range(4)])


def _with_inserts(at: Column) -> Column:
    """The states when turns may be inserted now: one, or a user and an assistant turn; more than that is never cheaper."""
    user, assistant = INSERTED["user"], INSERTED["assistant"]
    into_user = F.least(at["s2"], *(_add(at[f"s{a}"], INSERT, user) for a in (0, 1, 3)))
    into_assistant = F.least(at["s3"], _add(at["s2"], INSERT, assistant), *(_add(at[f"s{a}"], 2 * INSERT, user + assistant) for a in (0, 1)))
    return _states([at["s0"], at["s1"], into_user, into_assistant])


def _turn(states: Column, t: Column) -> Column:
    """The states after one more turn (initial, faulty, truncated)."""
    staying = F.when(t["faulty"], NEVER).when(t["truncated"], TRUNCATED).otherwise(0)

    def step(at: Column) -> Column:
        options = [[_add(at[f"s{k}"], DELETE, "D")] for k in range(4)]
        for a, role, b in STEPS:
            options[b].append(_add(at[f"s{a}"], staying + F.when(t["initial"] == role[0], 0).otherwise(NEVER), "K"))
            if role in REROLED:
                options[b].append(_add(at[f"s{a}"], staying + REROLE, REROLED[role]))
        return _states([F.least(*x) if len(x) > 1 else x[0] for x in options])

    return _let(_with_inserts(states), step)


def fold(turns: Column, start: int = 0) -> Column:
    """The four states after an array of turns, from one state."""
    return F.aggregate(turns, _start(start), _turn)


def fold_blocks(turns: Column, block: int) -> Column:
    """The same from state 0, block by block."""
    firsts = F.sequence(F.lit(1), F.size(turns), F.lit(block))
    blocks = F.transform(firsts, lambda k: F.array(*(fold(F.slice(turns, k, F.lit(block)), s) for s in range(4))))

    def joined(at: Column, through: Column, b: int) -> Column:
        parts = [(at[f"s{a}"], through[a][f"s{b}"]) for a in range(4)]
        return F.least(*(_way(x["cost"] + y["cost"], F.concat(x["audit"], y["audit"])) for x, y in parts))

    return F.aggregate(blocks, _start(0), lambda at, through: _states([joined(at, through, b) for b in range(4)]))


def cheapest(turns: Column, block: int = BLOCK) -> Column:
    """(cost, audit) of an array of turns (initial, faulty, truncated), the audit in the fold's letters."""
    end = F.when(F.size(turns) <= block, fold(turns)).otherwise(fold_blocks(turns, block))
    return _let(end, lambda e: F.least(e["s0"], _with_inserts(e)["s3"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The repaired turns as an array of (role, text), from the turns (role, text) and the fold's audit."""
    marks = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))  # one a turn, and inserts at the end

    def made(mark: Column) -> Column:
        of = lambda edit: F.when(edit == INSERTED["user"], "user").otherwise("assistant")
        return F.transform(F.regexp_extract_all(mark, F.lit("[IJ]"), F.lit(0)), lambda edit: F.struct(of(edit).alias("role"), F.lit("").alias("text")))

    def own(mark: Column, turn: Column) -> Column:
        edit = F.right(mark, F.lit(1))
        role = F.when(edit == "K", turn["role"]).when(edit == REROLED["user"], "user").when(edit == REROLED["assistant"], "assistant")
        return F.filter(F.array(F.struct(role.alias("role"), turn["text"].alias("text"))), lambda x: x["role"].isNotNull())

    return F.flatten(F.zip_with(marks, turns, lambda mark, turn: F.concat(made(mark), own(mark, turn))))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role, text) of every conversation in rows (conv_id, turn, role, text, gone)."""
    here = lambda c: F.when(~F.col("gone"), c)
    turn = F.struct("turn", "role", "text", "initial", (F.col("blank") | F.col("duplicate")).alias("faulty"), "truncated")
    count = lambda c: F.count(F.when(~F.col("gone") & F.col(c), 1))
    own = here(F.col("turn"))
    out = (
        flag(rows)
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.max(own) - F.min(own) + 1 - count("new_turn"), F.lit(0)).cast("long").alias("gaps"),
            *(count(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
            F.sort_array(F.collect_list(here(turn))).alias("kept"),
        )
        .withColumn("way", cheapest(F.col("kept"), block))
    )
    audit = F.translate("way.audit", "JS", "IR").alias("audit")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "way.cost", audit, repaired(F.col("kept"), F.col("way.audit")).alias("turns"))


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """repair of conversations (conv_id, turn, role, text) after damage, with the repaired turns as their hash."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(damage(conversations)).withColumn("repaired_sha256", F.sha2(joined, 256)).drop("turns")
