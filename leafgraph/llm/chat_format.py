"""Chat formatting with the cheapest repair of the sequence of roles.

Dynamic programming over an automaton of legal turns decides for every turn whether it stands as it is, is given
another role, is merged into the turn before it, or needs an empty turn ahead. Turns are dealt out by range of
conversation and turn, so that a conversation with very many turns spans partitions: what a part of a conversation
costs from each state to each is a small matrix; the matrices of the parts are chained on the driver (two a partition at
most), and then every partition writes its turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafgraph.llm.shipping import Shipped
from leafgraph.session import shared_dir

#: States: nothing yet, or the role of the last turn.
ROLES = ("", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs. A role that isn't known is cheap to replace.
MERGE, INSERT, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN = 2, 5, 3, 4, 1
FAR = 1 << 40


def _ways(s: int, r: int) -> tuple[int, int, str, int]:
    """Cheapest way from state s to a turn of role r: cost, turns added, name, role of the empty turn ahead."""
    if r in NEXT[s]:
        return 0, 1, "keep", 0
    found = [(MERGE, 0, "merge", 0)] if r == s else []
    found += [(INSERT, 2, "insert", q) for q in NEXT[s] if r in NEXT[q]]
    return min(found, default=(FAR, 0, "", 0))


WAYS = {(s, r): _ways(s, r) for s in range(4) for r in (1, 2, 3)}
#: A conversation may end with a user's or an assistant's turn; after a system turn an empty user's turn is needed.
FINISH = {0: (FAR, 0), 1: (INSERT, 1), 2: (0, 0), 3: (0, 0)}


def known(role: str | None) -> int:
    """The state of a role's name, 0 where it isn't known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def relabel(given: int, r: int) -> int:
    if given == r:
        return 0
    return RELABEL_UNKNOWN if not given else RELABEL_SYSTEM if 1 in (given, r) else RELABEL


def priced(roles: list[int], entry: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(cost, turns) by the state after all roles from state ``entry`` on, and where each step's states come from."""
    now = [(0, 0) if s == entry else (FAR, 0) for s in range(4)]
    back = []
    for given in roles:
        then, froms = [(FAR, 0)], [0]
        for r in (1, 2, 3):
            best, of = (FAR, 0), 0
            for s in range(4):
                cost, turns = now[s]
                if cost < FAR:
                    way = WAYS[s, r]
                    sum_ = (cost + way[0] + relabel(given, r), turns + way[1])
                    if sum_ < best:
                        best, of = sum_, s
            then.append(best)
            froms.append(of)
        now = then
        back.append(froms)
    return now, back


def walked(back: list[list[int]], last: int) -> list[tuple[int, int]]:
    """(state before, role) of each step on the way to state ``last``."""
    out = []
    for froms in reversed(back):
        out.append((froms[last], last))
        last = froms[last]
    return out[::-1]


def finished(now: list[tuple[int, int]]) -> int:
    """The state to end in."""
    return min(range(4), key=lambda s: (now[s][0] + FINISH[s][0], now[s][1] + FINISH[s][1], s))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of the runs of one conversation in a sorted partition."""
    held, key = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def rendered(role: int, text: str, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{ROLES[role]}|>\n{text}"


def pieces_of(conv, rows: list[tuple], plan: tuple | None) -> Iterator[tuple]:
    """Output rows of one part; plan: entry and exit states, rows and turns before it, whether it is the last part."""
    entry, last, place, turn, ends = plan or (0, None, 0, 0, True)
    given = [known(r[2]) for r in rows]
    now, back = priced(given, entry)
    last = finished(now) if last is None else last
    for i, ((s, r), row) in enumerate(zip(walked(back, last), rows, strict=True)):
        _, _, way, ahead = WAYS[s, r]
        text = row[3] or ""
        if way == "insert":
            turn += 1
            yield conv, place + i, 0, None, turn - 1, ROLES[ahead], "insert", rendered(ahead, "", turn == 1)
        if way == "merge":
            action, out = "merge", "\n\n" + text
        else:
            turn += 1
            action, out = "keep" if given[i] == r else "relabel", rendered(r, text, turn == 1)
        yield conv, place + i, 1, row[1], turn - 1, ROLES[r], action, out + ("<|end|>\n" if ends and i == len(rows) - 1 and last != 1 else "")
    if ends and last == 1:
        yield conv, place + len(rows), 0, None, turn, "user", "insert", rendered(2, "", False) + "<|end|>\n"


def chained(found: list[dict]) -> dict[tuple[int, int], tuple]:
    """Plans of the parts of conversations that span partitions, by (partition, 0 first or 1 last part)."""
    chains: list[list[dict]] = []
    for part in sorted(found, key=lambda p: (p["partition"], p["last"])):
        end = chains[-1][-1] if chains else None
        if end and end["conv_id"] == part["conv_id"] and end["partition"] != part["partition"] and end["ends"]:
            chains[-1].append(part)
        else:
            chains.append([part])
    plans = {}
    for chain in chains:
        if len(chain) == 1:
            continue
        at: list[dict[int, tuple[int, int, int]]] = [{0: (0, 0, 0)}]  # by state: cost, turns, state before
        for part in chain:
            then: dict[int, tuple[int, int, int]] = {}
            for s, (cost, turns, _) in at[-1].items():
                for r in (1, 2, 3):
                    price = part["costs"][4 * s + r]
                    if price < FAR:
                        way = (cost + price, turns + part["turns"][4 * s + r], s)
                        then[r] = min(then.get(r, (FAR, 0, 0)), way)
            at.append(then)
        state = min(at[-1], key=lambda s: (at[-1][s][0] + FINISH[s][0], at[-1][s][1] + FINISH[s][1], s))
        states = [state]
        for step in reversed(at[1:]):
            states.append(step[states[-1]][2])
        states.reverse()
        place = 0
        for i, part in enumerate(chain):
            turn = at[i][states[i]][1]
            plans[part["partition"], part["last"]] = (states[i], states[i + 1], place, turn, i == len(chain) - 1)
            place += part["n"]
    return plans


def formatted(turns: DataFrame) -> DataFrame:
    """The repaired and rendered pieces of each conversation of ``turns`` (conv_id, turn, role, text).

    conv_id, place (of the input turn in its conversation, from 0), after (0 for an empty turn ahead of it, else 1),
    turn (as given; null for empty turns), out_turn, role, action (keep, relabel, merge, insert), rendered. A
    conversation's text is the concatenation of its pieces by place and after. Turns go by turn, nulls first, then by
    role and text; repeated turns are turns of their own. Null texts are empty, null or unknown roles get the cheapest
    one, rows of a null conv_id are one conversation, an empty table gives no rows. Other columns are not looked at.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    # the row's own number keeps equal rows apart where ranges are cut
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys, "row").sortWithinPartitions(*keys, "row").drop("row")
    rows = rows.checkpoint()  # both passes see the same partitions
    kind, id_type = turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part in parts(batches):
            first, last = first or part, part
        out = []
        for which, part in ((0, first), (1, last)):
            if part is None or which == 1 and last is first:
                continue
            roles = [known(r[2]) for r in part[1]]
            ways = [priced(roles, s)[0] for s in range(4)]
            ends = which == 1 or last is first
            out.append((TaskContext.get().partitionId(), which, ends, part[0], len(roles), [w[r][0] for w in ways for r in range(4)], [w[r][1] for w in ways for r in range(4)]))
        columns = list(zip(*out)) if out else [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.bool_(), id_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["partition", "last", "ends", "conv_id", "n", "costs", "turns"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = f"partition int, last int, ends boolean, conv_id {kind}, n long, costs array<long>, turns array<long>"
    plans = Shipped(spark.sparkContext, chained([r.asDict() for r in rows.mapInArrow(edges, schema).collect()]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, plan = TaskContext.get().partitionId(), plans.open()
        kinds = [id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "place", "after", "turn", "out_turn", "role", "action", "rendered"]
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        def numbered() -> Iterator[tuple]:
            """(part, which): 0 for the first, 1 for the last of several, else None."""
            before, first = None, True
            for part in parts(batches):
                if before is not None:
                    yield before, 0 if first else None
                    first = False
                before = part
            if before is not None:
                yield before, 0 if first else 1

        for (conv, own), which in numbered():
            held += pieces_of(conv, own, plan.get((partition, which)) if which is not None else None)
            if len(held) > 5000:
                yield pack()
                held = []
        yield pack()

    out = f"conv_id {kind}, place long, after int, turn long, out_turn long, role string, action string, rendered string"
    return rows.mapInArrow(write, out)
