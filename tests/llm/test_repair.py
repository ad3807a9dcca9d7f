import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

from gaugeworks.llm import repair

SMALL = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, block int, audit string"


def brute_edits(turns):
    """Least (cost, audit, roles) over all edits of a few (initial, fault), with at most two insertions in a gap."""
    found = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, fault in turns]
    for edits in product(*choices):
        for inserted in product(gaps, repeat=len(turns) + 1):
            initials, cost, audit = "", 0, ""
            for n, gap in enumerate(inserted):
                initials, audit, cost = initials + gap, audit + "I" * len(gap), cost + 5 * len(gap)
                if n < len(turns):
                    edit, (initial, fault) = edits[n], turns[n]
                    audit += edit[0]
                    cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + (5 if fault == "truncated" and edit != "D" else 0)
                    initials += "" if edit == "D" else initial if edit == "K" else edit[1]
            if (found is None or (cost, audit) < found[:2]) and re.fullmatch("(s?(ua)+)?", initials):
                found = (cost, audit, initials)
    return found


def test_cells_are_the_best_of_all_edits():
    random.seed(6)
    for _ in range(120):
        turns = [(random.choice("suuaat"), random.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(random.randint(0, 3))]
        cell = repair.combine_all([repair.turn_cell(*turn) for turn in turns])
        cost, audit, initials = brute_edits(turns)
        assert repair.best(cell) == (cost, audit), turns
        replay, roles = repair.Replay(audit), ""
        for initial, _ in turns:
            roles += "".join(role[0] for role, _ in replay.turn(initial, "", 1))
        assert roles + "".join(role[0] for role, _ in replay.inserted()) == initials


def test_cells_do_not_depend_on_splits():
    random.seed(7)
    cells = [repair.turn_cell(random.choice("sua "), random.choice(["", "", "truncated", "blank"]), random.choice([1, 1, 3])) for _ in range(60)]
    one = cells[0]
    for cell in cells[1:]:
        one = repair.combine(one, cell)
    assert one == repair.combine_all(cells)
    alone = [repair.turn_cell("u", ""), *[repair.turn_cell("u", "duplicate")] * 3]
    assert repair.combine_all(alone) == repair.turn_cell("u", "", 4)


def brute_repair(rows):
    """Everything from the rows (turn, role, text) of one conversation, step by step."""
    kept = []
    for conv_id, turn, role, text in rows:
        spelled = [" " if value is None else str(value) for value in (conv_id, turn)]
        kind = zlib.crc32(":".join(spelled).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    kept.sort()
    seen, faults = set(), []
    for _, _, role, text in kept:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, _, role, _ in kept]
    steps = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    @lru_cache(None)
    def least(at, state):
        options = [(0, "", ())] if at == len(kept) and state in ("", "a") else []
        if at < len(kept):
            def add(cost, letter, state, out):
                more, audit, rest = least(at + 1, state)
                options.append((cost + more, letter + audit, out + rest))

            add(2, "D", state, ())
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] == "truncated" else 0
                role, text = kept[at][2:]
                if state in steps.get(initials[at], {}):
                    add(extra, "K", initials[at], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    if state in steps[name[0]]:
                        add(extra + 1, "R", name[0], (f"{name}:{text}",))
        for name in ("user", "assistant"):
            if state in steps[name[0]]:
                for more in after_insertion(at, name[0]):
                    options.append((5 + more[0], "I" + more[1], (f"{name}:", *more[2])))
        return min(options)

    depth = [0]

    def after_insertion(at, state):
        if depth[0] > 1:  # a third insertion in a row goes round in a circle
            return []
        depth[0] += 1
        try:
            return [least.__wrapped__(at, state)]
        except ValueError:
            return []
        finally:
            depth[0] -= 1

    cost, audit, out = least(0, "")
    turns = [number for some, number, _, _ in kept if some]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(name) for name in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def compared(frame):
    groups = {}
    for row in frame.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(row.conv_id, []).append(tuple(row))
    got = {row[0]: tuple(row[1:]) for row in repair.repair(frame).collect()}
    assert got == {conv_id: brute_repair(rows) for conv_id, rows in groups.items()}
    return got


def test_conversations_of_a_table(spark):
    got = compared(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert len(got) == 100 and sum(row[5] for row in got.values()) > 50


def test_odd_conversations(spark):
    random.seed(8)
    texts = [None, "", " \n", "One.", "Two", "Is it?  ", "Oh!\n", "No end \x85", "é."]
    rows = [(n % 23, random.choice([None, *range(8)]), random.choice(["user", "assistant", "system", "tool", "", None]), random.choice(texts)) for n in range(200)]
    rows += [(None, 3, "user", "Who?"), (None, None, "user", "Who?"), (77, None, None, None)]
    rows += [(50, n, ("user", "assistant")[n % 2], f"Turn {n}.") for n in range(300)] + [(51, 4, "user", "Again.")] * 40
    lost = next(n for n in range(1000, 2000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA).repartition(3)
    got = compared(frame)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.repair(frame.limit(0)).count() == 0


def test_repaired_turns_are_those_of_the_digest(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = repair.faults(repair.damaged(frame))
    found, digests = repair.parse(turns), {row.conv_id: row.repaired_sha256 for row in repair.repair(frame).collect()}
    rows = sorted(map(tuple, repair.repaired_turns(found, turns).collect()))
    for conv_id in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == conv_id]
        assert [row[1] for row in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in mine).encode()).hexdigest() == digests[conv_id]
