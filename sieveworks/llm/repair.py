"""Repair of a conversation's structure by weighted finite-state composition.

Three machines: an input acceptor reads a conversation's turns as symbols (the initial of the role, in upper case where the
text is cut off, ``-`` where the turn must go); an edit transducer keeps a turn, gives it the role user or assistant, deletes
it, or inserts an empty turn, each at a cost; a grammar acceptor takes the initials ``(s?(ua)+)?``. Their composition is made
lazily: only states (turn, inserts since the last turn, place in the grammar) that the search asks for exist. Two inserts
reach every place of the grammar and a third would close a cycle, so states of one turn are ordered by their inserts and the
composition has no cycle. The shortest path is found in reverse topological order over weights (cost, label string), compared
in this order: arcs that leave one state have different labels, so the first label decides between equal costs.

Marks of the turns and the assembly of the result are expressions; only the search is Python, over one symbol a turn, and
remembers short conversations. A conversation is one row and one task, as its audit and its repaired turns are one result.

Cases: turns go by ``turn`` (nulls first), ties by role and text; a null role or text is one space, and turns with a null
conversation id are one conversation; equal turns are duplicates of the first; a role with another initial than s, u or a
can't be kept; no turn is repaired to no turn; extra columns are not read; an empty table gives an empty result;
gaps beyond a long count as none.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and what an undeleted turn adds whose text is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar acceptor of ``(s?(ua)+)?``: nothing yet, after the system, after a user, after an assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Inserts in a row that can be of use.
INSERTS = 2
ROLES = {"u": "user", "a": "assistant"}
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def edits(symbol: str) -> list[tuple[str, str, int]]:
    """Arcs of the edit transducer that read a symbol: label, what is written (nothing for a deletion), cost."""
    if symbol == "-":
        return [("D", "", DELETE)]
    more = TRUNCATED if symbol.isupper() else 0
    return [("D", "", DELETE), ("K", symbol.lower(), more), ("R", "u", REROLE + more), ("R", "a", REROLE + more)]


@lru_cache(maxsize=None)  # a dozen symbols
def arcs(symbol: str | None, inserted: int, place: int) -> list[tuple[str, str, int, int, int]]:
    """Arcs that leave a composed state: label, what is written, cost, inserts and place after it. ``None`` ends the input."""
    own = [(label, out, cost, 0, GRAMMAR[place].get(out) if out else place) for label, out, cost in (edits(symbol) if symbol else [])]
    if inserted < INSERTS:
        own += [("I", out, INSERT, inserted + 1, to) for out, to in GRAMMAR[place].items() if out in ROLES]
    return sorted(a for a in own if a[4] is not None)


def shortest(symbols: str) -> tuple[int, list[tuple[str, str]]]:
    """Cost and edits (label, what is written) of the least accepted path."""
    states = [(e, g) for e in range(INSERTS, -1, -1) for g in range(len(GRAMMAR))]
    after: dict[tuple[int, int], int] = {}
    choices: list[dict[tuple[int, int], tuple[str, str, int, int, int] | None]] = []
    for i in range(len(symbols), -1, -1):
        symbol = symbols[i] if i < len(symbols) else None
        cost: dict[tuple[int, int], int] = {}
        chosen: dict[tuple[int, int], tuple[str, str, int, int, int] | None] = {}
        for e, g in states:
            if symbol is None and g in FINAL:
                cost[e, g], chosen[e, g] = 0, None
                continue
            ways = [(c + there, arc) for arc in arcs(symbol, e, g) for label, _, c, e2, g2 in (arc,) if (there := (cost if label == "I" else after).get((e2, g2))) is not None]
            if ways:
                cost[e, g], chosen[e, g] = min(ways)
        after = cost
        choices.append(chosen)
    path, i, state = [], len(symbols), (0, 0)
    while (arc := choices[i][state]) is not None:
        path.append(arc[:2])
        i -= arc[0] != "I"
        state = arc[3:]
    return after[0, 0], path


def _repaired(symbols: str) -> dict:
    cost, path = shortest(symbols)
    turns, at = [], 0
    for label, out in path:
        if out:
            turns.append({"at": None if label == "I" else at, "role": None if label == "K" else ROLES[out]})
        at += label != "I"
    return {"cost": cost, "audit": "".join(label for label, _ in path), "turns": turns}


_remembered = lru_cache(maxsize=1 << 16)(_repaired)
_PLAN = "cost bigint, audit string, turns array<struct<at: int, role: string>>"
_ARROW = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())])))])


def plans(symbols: pa.Array) -> pa.Array:
    """The least repair of each conversation."""
    return pa.array([(_remembered if len(s) <= 64 else _repaired)(s) for s in symbols.to_pylist()], _ARROW)


def marked(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, t``: each conversation's turns in order, with ``blank``, ``again`` and ``cut`` for their first fault."""
    said = lambda name: F.coalesce(turns[name].cast("string"), F.lit(" "))
    rows = turns.select(turns[conv_id].alias("conv_id"), turns[turn].cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text")).repartition("conv_id")
    last = F.expr(f"right(rtrim({BLANKS}, text), 1)")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.select("*", (last == "").alias("blank"), (F.row_number().over(same) > 1).alias("seen"), (~last.isin(".", "!", "?")).alias("open"))
    again, cut = ~F.col("blank") & F.col("seen"), ~F.col("blank") & ~F.col("seen") & F.col("open")
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "blank", again.alias("again"), cut.alias("cut"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, counts of faults, ``cost, audit`` and ``repaired array<struct<role, text>>``, a row for each conversation.

    ``gaps`` are turn numbers that are missing between the first and the last, ``illegal`` neighbours whose roles may not follow
    one another; ``blank``, ``duplicate`` and ``truncated`` count each turn's first fault.
    """
    plan = F.arrow_udf(plans, _PLAN)
    count = lambda name: F.expr(f"cast(size(filter(t, x -> x.{name})) as bigint)")
    initial = "case when x.role rlike '^[sua]' then substring(x.role, 1, 1) else 'o' end"
    symbols = F.expr(f"array_join(transform(t, x -> case when x.blank or x.again then '-' when x.cut then upper({initial}) else {initial} end), '')")
    numbers = "filter(transform(t, x -> x.turn), x -> x is not null)"
    done = marked(turns, conv_id, turn, role, text).withColumn("plan", plan(symbols))
    return done.select(
        "conv_id",
        F.expr(f"coalesce(try_add(try_subtract(array_max({numbers}), array_min({numbers})), cast(1 - size(array_distinct({numbers})) as bigint)), 0L)").alias("gaps"),
        count("blank").alias("blank"), count("again").alias("duplicate"), count("cut").alias("truncated"),
        F.expr("cast(size(filter(zip_with(slice(t, 1, greatest(size(t) - 1, 0)), slice(t, 2, size(t)), (x, y) -> concat(substring(x.role, 1, 1), substring(y.role, 1, 1))), p -> p not in ('su', 'ua', 'au'))) as bigint)").alias("illegal"),
        F.col("plan.cost").alias("cost"), F.col("plan.audit").alias("audit"),
        F.expr("transform(plan.turns, p -> named_struct('role', coalesce(p.role, t[p.at].role), 'text', if(p.at is null, '', t[p.at].text)))").alias("repaired"),
    )
