"""Repaired conversations against an exhaustive search over edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from cloakframe.llm import conversation_repair as R

PREFIX, WHOLE = re.compile(r"(s?(ua)*u?)?"), re.compile(r"(s?(ua)+)?")


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], found: list[str]) -> tuple[int, str, str]:
    """All edits of at most the cost of deleting everything; least cost, then least in ASCII."""
    best = (4 * len(rows), "D" * len(rows), "")

    def go(i: int, cost: int, audit: str, initials: str, lines: tuple) -> None:
        nonlocal best
        if cost > best[0] or not PREFIX.fullmatch(initials):
            return
        if i == len(rows) and WHOLE.fullmatch(initials):
            best = min(best, (cost, audit, "\n".join(lines)))
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", initials + role[0], (*lines, f"{role}:"))
        if i < len(rows):
            _, _, own, text = rows[i]
            go(i + 1, cost + 4, audit + "D", initials, lines)
            if found[i] in ("", "truncated"):
                more = 3 if found[i] else 0
                if own:
                    go(i + 1, cost + more, audit + "K", initials + own[:1], (*lines, f"{own}:{text}"))
                for role in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", initials + role[0], (*lines, f"{role}:{text}"))

    go(0, 0, "", "", ())
    return best


def searched(rows: list[tuple]) -> tuple[tuple[int, str, str], int]:
    """What the survivors find, and the most edits they held back."""
    audit, lines, held = [], [], 0
    one = R.Audit(None, lambda initials, more: (audit.append(initials.decode()), lines.extend(f"{r}:{t}" for _, r, t in more)))
    seen = set()
    for _, turn, role, text in rows:
        body = text.rstrip(R.SPACES)
        one.take(turn, role, text, not body, bool(body) and body[-1] not in ".!?", (role, text) in seen)
        seen.add((role, text))
        held = max(held, sum(len(one.survivors.unresolved(s)) for s in one.survivors.paths))
    cost = one.survivors.end()
    return (cost, "".join(audit), "\n".join(lines)), held


def some_rows(rnd: random.Random, n: int) -> list[tuple]:
    return [(0, i, rnd.choice(["user", "assistant", "system", " ", "", "u2"]), rnd.choice([f"t{i}.", f"t{i}", "again.", "", "\t "])) for i in range(n)]


def test_survivors_equal_an_exhaustive_search():
    rnd = random.Random(11)
    for n in [0, 1, 2, 3] * 40 + [4, 5] * 25:
        rows = some_rows(rnd, n)
        assert searched(rows)[0] == cheapest(rows, faults(rows)), rows


def test_every_start_of_two_roles_and_faults():
    kinds = [(r, t) for r in ("user", "assistant", "system") for t in ("x.", "x", "")]
    for chosen in itertools.product(kinds, repeat=3):
        rows = [(0, i, r, t and f"{i}{t}") for i, (r, t) in enumerate(chosen)]
        assert searched(rows)[0] == cheapest(rows, faults(rows)), rows


def test_memory_is_what_survivors_do_not_share():
    rnd = random.Random(5)
    rows = [(0, i, ["user", "assistant"][i % 2] if rnd.random() < 0.9 else rnd.choice(["user", "assistant", "system"]), f"t{i}." if rnd.random() < 0.9 else f"t{i}") for i in range(5000)]
    (cost, audit, _), held = searched(rows)
    assert held < 400 and cost > 0 and sum(map(audit.count, "KRD")) == 5000
    # nothing but blank turns after a system turn: two ways stay open to the end, as initials only
    (cost, audit, text), held = searched([(0, 0, "system", "s.")] + [(0, i, "user", " ") for i in range(1, 3000)])
    assert (cost, audit, text) == (12000, "D" * 3000, "") and held <= 4 * 3001


def test_query_over_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(None, 0, "user", None), (None, None, None, "x."), (None, 2, "assistant", "y."), (3, None, "user", "a."), (3, None, "assistant", "b."), (3, 7, "user", "a."), (4, 5, None, None)]
    rows += [(c, i // 2 if c % 3 else i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["é.", "b", "", "long " * 2000 + "!", "a.\r\n", None])) for c in range(10, 40) for i in range(rnd.randint(1, 5))]
    rows += [rows[0], rows[8], rows[8]]
    # a conversation whose only row is dropped
    gone = next(c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "bye."))
    table = spark.createDataFrame([(*r, "m", True, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, mark string, dropped boolean, first int")
    damage = R.damage(table)
    got = {r.conv_id: r for r in R.repair_digest(damage).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == R.repair_digest(damage).count()
    turns = sorted(R.edits(damage).collect(), key=lambda r: (str(r.conv_id), r.edit_no))
    for conv, r in got.items():
        mine = damaged([x for x in rows if x[0] == conv])
        found, given = faults(mine), [x[1] for x in mine if x[1] is not None]
        cost, audit, text = cheapest(mine, found)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), mine
        assert r.gaps == (max(given) - min(given) + 1 - len(set(given)) if given else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(found.count, ("blank", "duplicate", "truncated")))
        assert r.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        own = [x for x in turns if x.conv_id == conv]
        assert [x.edit_no for x in own] == list(range(len(own))) and "\n".join(f"{x.role}:{x.text}" for x in own) == text
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    empty = R.damage(table.limit(0))
    assert R.repair_digest(empty).count() == R.edits(empty).count() == 0
