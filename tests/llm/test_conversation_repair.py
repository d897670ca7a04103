"""Conversation repair against a plain version over the four phases of the grammar, without tables or lengths."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("lodestar.llm.queries")
from lodestar.llm import conversation_repair as cr  # noqa: E402

FROM, TO = {0: "u", 1: "u", 2: "a", 3: "u"}, {"u": 2, "a": 3}


def plain(rows):
    """(cost, audit, turns): rows of (role, text, fault)."""

    def put(into, phase, way):
        if phase not in into or way[:2] < into[phase][:2]:
            into[phase] = way

    def inserted(ways):
        for _ in range(3):
            for p, (c, a, t) in list(ways.items()):
                put(ways, TO[FROM[p]], (c + 3, a + "I", [*t, (cr.NAMES[FROM[p]], "")]))
        return ways

    ways = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        after, cut = {}, 3 * (fault == "truncated")
        for p, (c, a, t) in ways.items():
            put(after, p, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            if p == 0 and role[:1] == "s":
                put(after, 1, (c + cut, a + "K", [*t, (role, text)]))
            same = role[:1] == FROM[p]
            put(after, TO[FROM[p]], (c + cut + 3 * (not same), a + "RK"[same], [*t, (role if same else cr.NAMES[FROM[p]], text)]))
        ways = inserted(after)
    return min((ways[p] for p in (0, 3) if p in ways), key=lambda w: w[:2])


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("lengths", [(0, 1, 2, 3, 4, 5, 6, 7), (9, 12, 20), (31, 32, 33, 64, 65, 100)])
def test_alignment(lengths):
    rng = random.Random(sum(lengths))
    aligned = cr._Aligned()
    for n in range(300 if max(lengths) < 8 else 25):
        roles = ["user", "assistant"] if n % 2 else ["user", "assistant", "system", "tool", "sage", "", "User"]
        rows = [(rng.choice(roles), f"t{k}", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for k in range(rng.choice(lengths))]
        talk = cr.Conversation(1, aligned.__getitem__)
        for k, (role, text, fault) in enumerate(rows):
            talk.add(k, role, text, role[:1], fault)
        cost, audit, turns = plain(rows)
        assert talk.result()[6:] == (cost, audit, sha(turns)), rows


def test_band_is_the_incumbents():
    assert cr.wagner_fischer("uaua", "uaua", 0) == (0, "KKKK")
    assert cr.wagner_fischer("uaua", "uauaua", 5) is None
    assert cr.wagner_fischer("uaua", "uauaua", 6) == (6, "IIKKKK")
    assert cr.wagner_fischer("-a", "ua", 7) == (7, "DIK")


def annotated(rows):
    """Rows (turn, role, text) in order, with their first fault."""
    out, seen = [], set()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    for turn, role, text in sorted(rows, key=key):
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(9)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Yes.", "Why?", "no end", "", " \n", None, f"Turn {t}.", "x" * 3000 + "!"])))
    rows += [(50, t, ("user", "assistant")[t % 2], f"line {t % 70}.") for t in range(400)] + [rows[3], rows[3]]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "z", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, `fault.x` boolean").repartition(5)


def test_conversations(spark, talks):
    want = {}
    for conv, turn, role, text, *_ in talks.collect():
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {r[0]: tuple(r)[1:] for r in cr.digest(talks).collect()}
    assert got.keys() == want.keys()
    turns_of = {}
    for conv, rows in want.items():
        rows = annotated(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [r[3] for r in rows]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, turns_of[conv] = plain([r[1:] for r in rows])
        assert got[conv] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(turns_of[conv])), conv
    out = {}
    for r in cr.repaired(talks, cr.digest(talks)).orderBy("conv_id", "position").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert out == {c: t for c, t in turns_of.items() if t}


def test_damage(spark, talks):
    rows = talks.where("conv_id is not null and turn is not null").collect()
    want = []
    for conv, turn, role, text, *_ in rows:
        role, text = role or " ", " " if text is None else text
        d = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if d:
            want += [(conv, turn, "user" if d == 4 else role, "" if d == 1 else "".join(x for x in text if x not in ".!?") if d == 2 else text)] * (2 if d == 3 else 1)
    got = cr.damaged(talks).where("conv_id is not null and turn is not null")
    assert sorted(tuple(r)[:4] for r in got.where("not dropped").collect()) == sorted(want)
    assert got.where("dropped").count() == sum(zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0 for r in rows)


def test_nothing_left_and_nothing_given(spark, talks):
    gone = spark.createDataFrame([(7, 0, "user", "Hi.", True)], "conv_id int, turn int, role string, text string, dropped boolean")
    assert [tuple(r) for r in cr.digest(gone).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", sha([]))]
    assert cr.digest(talks.limit(0)).collect() == []
