"""Conversation structure repair: turns are aligned to the alternating grammar (s?(ua)+)? by Wagner-Fischer tables.

Each row has one fault at most, the first of: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white space is none of . ! ?). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate rows allow nothing else), Insert of an empty user or assistant turn 3; a truncated row that stays adds 3. Of the cheapest ways to a sequence that the grammar has, the one whose initials (K, R, D, I in order) are least is taken.

A conversation is read in blocks of BLOCK rows. Where a block begins, the grammar is in one of four phases: nothing yet, after the system turn, after a user, after an assistant. From each phase that can be reached the block is aligned to the grammar's string from there in each feasible length; Ukkonen's band, from the cost of the best alignment so far that ends in the same phase, bounds both the lengths and the cells of each table. Tables are filled from the end, so a walk from the start that takes the least letter among cheapest moves gives the least audit of that length; audits of equal cost are compared. Costs and audits of phases add up over blocks, which is exact: two ways of equal cost to the same place are never prefixes of one another, as the longer one would pay for its inserts. Most conversations are one block, and blocks of the same kinds of rows are aligned once in a task.

One shuffle, by conversation. Rows stream through sorted, so a conversation of any length takes as much memory as its audit (which is one value of the result) for four phases, and the state of as many hashes; that a hash and an audit run over a conversation in order is why it is one task's.

Rows: turn nulls first, ties by role, then text. Null roles and texts are one blank. A null key is a conversation of its own. Rows marked as dropped only make their conversation known. An empty table gives an empty result. The key is a bigint; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Cache, arrow, batches

#: Rows aligned at a time.
BLOCK = 32
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Phases of the grammar: nothing yet, after a system turn, after a user, after an assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60

_BLANK = r"\x20\x09-\x0D"


def faults(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, initial, fault) by conversation, each in order. fault: blank, duplicate, truncated or null; 'dropped' for rows whose column of that name is true. initial: of the role."""
    dropped = F.col("dropped") if "dropped" in df.columns else F.lit(False)
    rows = df.select(F.col(key).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), dropped.alias("dropped")).repartition("conv")
    order = [F.asc_nulls_first("turn"), "role", "text"]
    # conv clusters conv, role and text too: no second shuffle
    again = F.row_number().over(W.partitionBy("conv", "role", F.sha2("text", 256), "dropped").orderBy(*order)) > 1
    kind = F.when(F.col("dropped"), "dropped").when(~F.col("text").rlike(f"[^{_BLANK}]"), "blank").when(F.col("_again"), "duplicate").when(~F.col("text").rlike(rf"[.!?][{_BLANK}]*\z"), "truncated")
    # of equal rows the one that counts as seen before comes later
    return rows.withColumn("_again", again).sortWithinPartitions(F.asc_nulls_first("conv"), *order, "_again").select("conv", "turn", "role", F.when(~F.col("dropped"), F.col("text")).alias("text"), F.substring("role", 1, 1).alias("initial"), kind.alias("fault"))


# -- alignment of a block


def _string(phase: int, length: int, system: bool) -> str:
    """What the grammar has from a phase on, so many turns long; from the start with or without the system turn."""
    body = ("au" if phase == USER else "ua") * (length // 2 + 1)
    return ("s" + body if system else body)[:length]


def _ends(phase: int, string: str) -> int:
    return phase if not string else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[string[-1]]


def _least(net: int) -> int:
    """What so many more turns than rows cost at least; negative: fewer."""
    return INSERT * net if net > 0 else -DELETE * net


def wagner_fischer(kinds: str, target: str, limit: int) -> tuple[int, str] | None:
    """The least cost of turning rows into the target's turns, and its least audit; None if it is over limit. kinds: a row's initial, in capitals if truncated, '-' if it must go, '?' or '!' (truncated) for other roles. Cells that a cost of limit can't reach are left out."""
    n, m = len(kinds), len(target)
    net = m - n
    lo, hi = 0, 0
    if _least(net) > limit:
        return None
    while _least(lo - 1) + _least(net - lo + 1) <= limit and lo > -n:
        lo -= 1
    while _least(hi + 1) + _least(net - hi - 1) <= limit and hi < m:
        hi += 1
    lo, hi = min(lo, net), max(hi, net)
    inserts = [INSERT if c != "s" else _NEVER for c in target]

    def stays(kind: str, want: str) -> tuple[int, str]:
        cut = TRUNCATED if kind.isupper() or kind == "!" else 0
        if kind == "-":
            return _NEVER, "K"
        if kind.lower() == want:
            return cut, "K"
        return (_NEVER, "R") if want == "s" else (REROLE + cut, "R")

    below: dict[int, int] = {}
    tables: list[dict[int, int]] = [{}] * (n + 1)
    for i in range(n, -1, -1):
        here: dict[int, int] = {}
        for j in range(min(m, i + hi), max(0, i + lo) - 1, -1):
            best = 0 if i == n and j == m else _NEVER
            if i < n:
                best = min(best, below.get(j, _NEVER) + DELETE)
                if j < m:
                    best = min(best, below.get(j + 1, _NEVER) + stays(kinds[i], target[j])[0])
            if j < m:
                best = min(best, here.get(j + 1, _NEVER) + inserts[j])
            here[j] = best
        tables[i] = below = here
    cost = tables[0].get(0, _NEVER)
    if cost > limit or cost >= _NEVER:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        left = tables[i][j]
        if i < n and tables[i + 1].get(j, _NEVER) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and tables[i].get(j + 1, _NEVER) + inserts[j] == left:
            audit.append("I")
            j += 1
        else:
            audit.append(stays(kinds[i], target[j])[1])
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def align(kinds: str, phase: int) -> dict[int, tuple[int, str]]:
    """For each phase that rows may end in: the least cost from phase, and its least audit."""
    n = len(kinds)
    best: dict[int, tuple[int, str]] = {}

    def reached(length: int, system: bool) -> bool:
        """Aligns to one length; False if the incumbent is cheaper than that many more or fewer turns, and so than all lengths further on."""
        target = _string(phase, length, system)
        end = _ends(phase, target)
        limit = best[end][0] if end in best else DELETE * n + INSERT * length + (_NEVER if system else 0)
        if _least(length - n) > limit:
            return False
        got = wagner_fischer(kinds, target, min(limit, (DELETE + REROLE + TRUNCATED) * n + INSERT * length))
        if got and (end not in best or got < best[end]):
            best[end] = got
        return True

    for system in (False, True) if phase == START else (False,):
        least = int(system)
        reached(least, system)  # no turn, or the system turn alone, may be the only length with its end
        near = max(n - kinds.count("-"), least)
        for lengths in (range(near, least, -1), range(near + 1, 2 * n + 4)):
            over: set[int] = set()  # ends go by the parity of the length
            for length in lengths:
                if length % 2 not in over and not reached(length, system):
                    over.add(length % 2)
                if len(over) == 2:
                    break
    return best


# -- a conversation


class Way:
    """The best way to a phase so far: its cost, what of its audit the others don't share, and the hash of the repaired turns."""

    __slots__ = ("cost", "audit", "sha")

    def __init__(self, cost: int, audit: str, sha):
        self.cost, self.audit, self.sha = cost, audit, sha


def _turns(audit: str, phase: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that an audit makes of rows. From the start, a kept row with s is the system turn."""
    at, want = 0, "a" if phase == USER else "u"
    for c in audit:
        if c == "D":
            at += 1
            continue
        role, text = (NAMES[want], "") if c == "I" else rows[at]
        at += c != "I"
        if c == "R":
            role = NAMES[want]
        yield role, text
        want = "u" if (c == "K" and role[:1] == "s") or want == "a" else "a"


class Conversation:
    """Rows come one after another; ways by phase."""

    def __init__(self, key: int | None, aligned: Callable[[tuple[int, str]], list]):
        self.key, self.aligned = key, aligned
        self.ways = {START: Way(0, "", hashlib.sha256())}
        self.settled, self.said = [], False
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = self.before = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, initial: str, fault: str | None) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.before = initial
        cut = fault == "truncated"
        if fault:
            self.count[fault] += 1
        self.kinds.append("-" if fault and not cut else (initial.upper() if cut else initial) if initial and initial in "sua" else "!" if cut else "?")
        self.rows.append((role, text))
        if len(self.rows) == BLOCK:
            self.align_block()

    def align_block(self) -> None:
        kinds, found = "".join(self.kinds), {}
        for phase, way in self.ways.items():
            for end, cost, audit in self.aligned((phase, kinds)):
                new = way.cost + cost, way.audit + audit
                if end not in found or new < found[end][0]:
                    found[end] = new, way, phase, audit
        self.ways = {}
        for end, (new, way, phase, audit) in found.items():
            sha, lead = way.sha.copy(), b"\n" if self.said or way.audit.strip("D") else b""
            for role, text in _turns(audit, phase, self.rows):
                sha.update(lead + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                lead = b"\n"
            self.ways[end] = Way(*new, sha)
        same = len(os.path.commonprefix([w.audit for w in self.ways.values()]))  # what all ways share is settled
        settled = next(iter(self.ways.values())).audit[:same]
        self.settled.append(settled)
        self.said = self.said or bool(settled.strip("D"))
        for w in self.ways.values():
            w.audit = w.audit[same:]
        self.rows, self.kinds = [], []

    def result(self) -> tuple:
        if self.rows:
            self.align_block()
        way = min((self.ways[p] for p in (START, ASSISTANT) if p in self.ways), key=lambda w: (w.cost, w.audit))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.key, gaps, *(self.count[x] for x in ("blank", "duplicate", "truncated", "illegal")), way.cost, "".join(self.settled) + way.audit, way.sha.hexdigest()


class _Aligned(Cache):
    """Alignments of blocks that a task has met."""

    def __init__(self):
        super().__init__(lambda key: [[end, cost, audit] for end, (cost, audit) in align(key[1], key[0]).items()], 16 << 20)


COLUMNS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digest(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). A boolean column `dropped` marks rows that are no longer there."""
    schema = pa.schema([(key, pa.int64()), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COLUMNS.split(", "))])

    def run(it) -> Iterator[tuple]:
        aligned, open_ = _Aligned(), None
        for conv, t, r, x, initial, fault in batches(it, "conv", "turn", "role", "text", "initial", "fault"):
            if open_ is None or conv != open_.key:
                if open_ is not None:
                    yield open_.result()
                open_ = Conversation(conv, aligned.__getitem__)
            if fault != "dropped":
                open_.add(t, r, x, initial, fault)
        if open_ is not None:
            yield open_.result()

    return faults(df, key, turn, role, text).mapInArrow(lambda it: arrow(schema, run(it), 1000), f"{key} bigint, {COLUMNS}")


def repaired(df: DataFrame, audits: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: (key, position, role, text, edit), position from 0. audits: what digest() gave, written before. An audit comes ahead of its conversation's rows in the same partition, so rows stream through once more."""
    schema = pa.schema([(key, pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    lead = audits.select(F.col(key).cast("bigint").alias("conv"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("lead"))
    rows = faults(df, key, turn, role, text).where("fault is null or fault <> 'dropped'").select("conv", "turn", "role", "text", F.lit(False).alias("lead"))
    both = rows.union(lead).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("lead"), F.asc_nulls_first("turn"), "role", "text")

    def run(it) -> Iterator[tuple]:
        audit, at, position, want = "", 0, 0, "u"

        def inserted() -> Iterator[tuple]:
            nonlocal at, position, want
            while at < len(audit) and audit[at] == "I":
                yield conv, position, NAMES[want], "", "I"
                at, position, want = at + 1, position + 1, "a" if want == "u" else "u"

        for conv, _, r, x, first in batches(it, "conv", "turn", "role", "text", "lead"):
            if first:
                audit, at, position, want = x, 0, 0, "u"
            else:
                c, at = audit[at], at + 1
                if c != "D":
                    r = NAMES[want] if c == "R" else r
                    yield conv, position, r, x, c
                    position, want = position + 1, "u" if r[:1] == "s" or want == "a" else "a"
            yield from inserted()

    return both.mapInArrow(lambda it: arrow(schema, run(it), 500), f"{key} bigint, position bigint, role string, text string, edit string")


# -- damage, to have something to repair


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, dropped) with faults set by a checksum of `key:turn`: one row in twenty each is dropped, emptied, bereft of its sentence marks, repeated, given to the user. Nulls are one blank, but the turn stays null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice: Column = F.pmod(F.crc32(F.concat(said(key), F.lit(":"), said(turn)).cast("binary")), F.lit(20))
    rows = df.select(F.col(key).alias("_k"), F.col(turn).alias("_t"), said(role).alias("_r"), said(text).alias("_x"), dice.alias("_d"))
    return rows.select(
        F.col("_k").alias(key),
        F.col("_t").alias(turn),
        F.when(F.col("_d") == 4, "user").otherwise(F.col("_r")).alias(role),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("_x", "[.!?]", "")).otherwise(F.col("_x")).alias(text),
        (F.col("_d") == 0).alias("dropped"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


#: A checksum bit by bit over the digits, the four phases as a fold over a conversation's rows. Each phase: cost, audit, repaired text; the least of each comes first.
SQL = r"""
with recursive coded as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: [ord(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 20 as dice
    from conversations
), hurt as (
    select conv_id, turn, case when dice = 4 then 'user' else role end as role,
        case when dice = 1 then '' when dice = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from (select *, unnest(case when dice = 3 then [1, 2] else [1] end) from coded where dice <> 0)
), placed as (
    select *, row_number() over (partition by conv_id, role, text order by place) > 1 as again
    from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from hurt)
), faulty as (
    select *, role[1] as i, lag(role[1]) over (partition by conv_id order by place) as before,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate'
            when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from placed
), gathered as (
    select conv_id, list({'role': role, 'text': text, 'i': i, 'fault': fault} order by place) as rows,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal
    from faulty group by conv_id
), steps as (
    select conv_id, 0 as k, {'c': 0, 'x': '', 't': ''} as nothing, {'c': 1000000000, 'x': '', 't': ''} as s, {'c': 3, 'x': 'I', 't': chr(10) || 'user:'} as u, {'c': 6, 'x': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as a from gathered
    union all
    select conv_id, k + 1, nothing, s, u, list_min([a, {'c': u.c + 3, 'x': u.x || 'I', 't': u.t || chr(10) || 'assistant:'}]) as a from (
        select conv_id, k, nothing, s, a, list_min([u, {'c': nothing.c + 3, 'x': nothing.x || 'I', 't': nothing.t || chr(10) || 'user:'}, {'c': s.c + 3, 'x': s.x || 'I', 't': s.t || chr(10) || 'user:'}, {'c': a.c + 3, 'x': a.x || 'I', 't': a.t || chr(10) || 'user:'}]) as u from (
            select conv_id, k, {'c': nothing.c + 4, 'x': nothing.x || 'D', 't': nothing.t} as nothing,
                list_min([{'c': s.c + 4, 'x': s.x || 'D', 't': s.t}, {'c': nothing.c + stay + if(r.i = 's', 0, 1000000000), 'x': nothing.x || 'K', 't': nothing.t || line}]) as s,
                list_min([{'c': u.c + 4, 'x': u.x || 'D', 't': u.t}, {'c': before.c + stay + if(r.i = 'u', 0, 3), 'x': before.x || if(r.i = 'u', 'K', 'R'), 't': before.t || if(r.i = 'u', line, chr(10) || 'user:' || r.text)}]) as u,
                list_min([{'c': a.c + 4, 'x': a.x || 'D', 't': a.t}, {'c': u.c + stay + if(r.i = 'a', 0, 3), 'x': u.x || if(r.i = 'a', 'K', 'R'), 't': u.t || if(r.i = 'a', line, chr(10) || 'assistant:' || r.text)}]) as a
            from (select steps.*, rows[k + 1] as r, list_min([nothing, s, a]) as before, chr(10) || rows[k + 1].role || ':' || rows[k + 1].text as line, case rows[k + 1].fault when '' then 0 when 'truncated' then 3 else 1000000000 end as stay
                from steps join gathered using (conv_id) where k < len(rows))))
), ended as (
    select conv_id, list_min([nothing, a]) as way from steps join gathered using (conv_id) where k = len(rows)
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    coalesce(way.c, 0)::bigint as cost, coalesce(way.x, '') as audit, sha256(coalesce(way.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join gathered on c.conv_id is not distinct from gathered.conv_id left join ended on c.conv_id is not distinct from ended.conv_id
"""
