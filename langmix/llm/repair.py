"""Conversation structure repair by a dynamic program over a Re-Pair grammar.

1. Every row becomes one of 16 symbols (role initial s, u, a or other; sound, truncated,
   blank or duplicate).  Duplicates are found by an aggregate over (conversation, role,
   text digest); symbols are lined up by a range partitioning over (conversation, turn,
   role, digest), so that a conversation of any length spreads over tasks, each of which
   writes its stretches as strings of at most ``SEGMENT`` symbols.  No text travels here.
2. Re-Pair: distinct strings are counted once; each round counts the adjacent pairs of the
   strings as compressed so far and makes rules of the most frequent ones that share no
   symbol.  The grammar has ``MAX_RULES`` rules at most, which bounds what the driver and
   the tasks hold and affects speed alone.
3. Every symbol has one 4 x 4 min-plus transfer matrix over the states of
   ``(s?(ua)+)?`` (nothing yet; after s; after u; after a).  A rule's matrix is the product
   of its two; an entry's audit is a rope, the entries it was made of.  Entries with
   equal cost take the ASCII-least audit.  All conversations share these matrices.
4. Each string is compressed where it lies; a conversation's compressed strings meet in
   order, and its state vector is multiplied through them (one character of audit a row
   and four ropes are all that grows with its length, as the audit itself does).
5. Texts are shuffled once, by conversation, sorted behind the audit, and streamed: the
   audit's letters are applied row by row, and no conversation is held in memory.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and duplicate
rows), Insert an empty-text user or assistant 3; undeleted truncated rows add 3.

Rows go by turn (null first), then role and SHA-256 of the text.  A null role or text is
one space; a null id is a conversation of its own.  Blank: no character outside space and
\\t\\n\\v\\f\\r; duplicate: role and text seen earlier; truncated: the last such character
is none of ``.!?``.  A row counts ``copies`` times if that column is named (0: only its
conversation is noted; such a conversation has zeros and an empty audit).  Other columns
are not read.  Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import common as C

SEGMENT = 4096
MAX_RULES = 1024
#: rows that one rule may stand for
MAX_SPAN = 1024
MAX_ROUNDS = 16
#: a round that saves a smaller share of the symbols is the last one
LEAST_GAIN = 0.01
RAN, SYSTEM, USER, ASSISTANT = range(4)
#: state after an output of role initial s, u or a, by state before it
_STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_INSERTS = {(x, y): n for x, row in enumerate([(0, None, 1, 2), (None, 0, 1, 2), (None, None, 0, 1), (None, None, 1, 0)])
            for y, n in enumerate(row) if n is not None}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
_FIRST = 65


def symbol(role: str, kind: int) -> str:
    return chr(_FIRST + 4 * ("sua".find(role[:1]) if role[:1] in tuple("sua") else 3) + kind)


def _terminal(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit): insertions, then the row's edit."""
    initial, kind = "sua?"[code // 4], code % 4
    row: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(key, value):
        row[key] = min(row.get(key, value), value)

    for (x, y), n in _INSERTS.items():
        offer((x, y), (INSERT * n + DELETE, "I" * n + "D"))
        if kind in (SOUND, TRUNCATED):
            extra = CUT if kind == TRUNCATED else 0
            if initial in _STEP[y]:
                offer((x, _STEP[y][initial]), (INSERT * n + KEEP + extra, "I" * n + "K"))
            for role in "ua":
                if role in _STEP[y]:
                    offer((x, _STEP[y][role]), (INSERT * n + REROLE + extra, "I" * n + "R"))
    return row


def compress(symbols: str, rounds: list[list[tuple[str, str]]]) -> str:
    for rules in rounds:
        for pair, new in rules:
            symbols = symbols.replace(pair, new)
    return symbols


class Grammar:
    """Rules by round, and the matrix of each symbol: cost by (state, state), with
    the state between the halves, from which the audit is spelled out on demand."""

    def __init__(self, rounds: Iterable[list[str]] = ()):
        self.rounds: list[list[tuple[str, str]]] = []
        self.halves: dict[str, str] = {}
        self.span = {chr(_FIRST + c): 1 for c in range(16)}
        self.cost = {chr(_FIRST + c): {k: v[0] for k, v in _terminal(c).items()} for c in range(16)}
        self.words = {chr(_FIRST + c): {k: v[1] for k, v in _terminal(c).items()} for c in range(16)}
        self.middle: dict[str, dict[tuple[int, int], int]] = {}
        self.audit = lru_cache(1 << 16)(self._audit)
        for pairs in rounds:
            self.add(pairs)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "audit"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.audit = lru_cache(1 << 16)(self._audit)

    def add(self, pairs: list[str]) -> None:
        """A round of rules for pairs of symbols that have no symbol in common."""
        rules = []
        for pair in pairs:
            new, (a, b) = chr(0x100 + len(self.halves)), pair
            cost, middle = {}, {}
            for (i, x), left in self.cost[a].items():
                for (y, o), right in self.cost[b].items():
                    if x == y and ((i, o) not in cost or self._better(a, b, i, x, o, left + right, cost, middle)):
                        cost[i, o], middle[i, o] = left + right, x
            self.cost[new], self.middle[new], self.halves[new] = cost, middle, pair
            self.span[new] = self.span[a] + self.span[b]
            rules.append((pair, new))
        self.rounds.append(rules)

    def _better(self, a, b, i, x, o, total, cost, middle) -> bool:
        if total != cost[i, o]:
            return total < cost[i, o]
        y = middle[i, o]
        return self.audit(a, i, x) + self.audit(b, x, o) < self.audit(a, i, y) + self.audit(b, y, o)

    def _audit(self, s: str, i: int, o: int) -> str:
        if s not in self.halves:
            return self.words[s][i, o]
        a, b = self.halves[s]
        x = self.middle[s][i, o]
        return self.audit(a, i, x) + self.audit(b, x, o)

    def compress(self, symbols: str) -> str:
        return compress(symbols, self.rounds)

    def advance(self, vector: dict, symbols: str) -> dict:
        """The state vector {state: (cost, rope)} behind the symbols; a rope is
        (rope before, symbol, state before, state after) or None."""
        for s in symbols:
            after: dict = {}
            for (i, o), c in self.cost[s].items():
                if i in vector:
                    cost, rope = vector[i][0] + c, (vector[i][1], s, i, o)
                    if o not in after or (cost, 0) < (after[o][0], self._less(after[o][1], rope) if cost == after[o][0] else 0):
                        after[o] = cost, rope
            vector = after
        return vector

    def _less(self, old, new) -> int:
        """1 if the audit of ``new`` is less than that of ``old``, else 0: spelled out
        back to where both ropes were one."""
        a, b = [], []
        while old is not new:
            a.append(self.audit(*old[1:]))
            b.append(self.audit(*new[1:]))
            old, new = old[0], new[0]
        return int("".join(reversed(b)) < "".join(reversed(a)))

    def spell(self, rope) -> str:
        out = []
        while rope is not None:
            out.append(self.audit(*rope[1:]))
            rope = rope[0]
        return "".join(reversed(out))

    def finish(self, vector: dict) -> tuple[int, str]:
        """Insertions at the end, up to a state that may end a conversation."""
        ends = []
        for i, (cost, rope) in vector.items():
            for o in (RAN, ASSISTANT):
                if (i, o) in _INSERTS:
                    ends.append((cost + INSERT * _INSERTS[i, o], rope, "I" * _INSERTS[i, o]))
        least = min(e[0] for e in ends)
        return least, min(self.spell(rope) + tail for cost, rope, tail in ends if cost == least)


def edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a conversation's rows under its audit; deleted rows keep
    their role and text, inserted ones have an empty text."""
    state, at = RAN, 0

    def wanted():
        return "assistant" if state == USER else "user"

    for role, text in rows:
        while audit[at] == "I":
            yield "I", wanted(), ""
            state, at = (ASSISTANT if state == USER else USER), at + 1
        edit, at = audit[at], at + 1
        if edit == "R":
            role = wanted()
        if edit != "D":
            state = _STEP[state][role[:1]]
        yield edit, role, text
    for _ in audit[at:]:
        yield "I", wanted(), ""
        state = ASSISTANT if state == USER else USER


# ---- rows to strings of symbols ----

_ORDER = ["conv", "turn", "role", "digest"]


def _rows(conv: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: str | None) -> DataFrame:
    """The rows under plain names, with the digest of the text."""
    return (conv.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
                        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
            .withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))


def _shape() -> Column:
    text = F.col("text")
    return (F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND))


def segments(rows: DataFrame) -> DataFrame:
    """Strings of symbols: (conv, part, seg, symbols, first_turn, last_turn, turns),
    in order by (part, seg) within a conversation."""
    counted = C.ckpt(rows.where("copies > 0").select(*_ORDER, _shape().alias("shape"), "copies")
                     .groupBy(*_ORDER, "shape").agg(F.sum("copies").alias("copies")))
    first = (counted.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
             .agg(F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("first")))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    is_first = F.when(F.col("null_first"), F.col("turn").isNull()).otherwise(F.col("turn").eqNullSafe(F.col("first")))
    lined = (counted.join(first, same).select(*_ORDER, "shape", "copies", is_first.alias("is_first"))
             .repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "turn", "role", "shape", "copies", "is_first"))
    out = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("symbols", pa.string()),
                     ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())])

    def work(batches):
        part, seg, held = TaskContext.get().partitionId(), 0, None

        def row():
            conv, symbols, first_turn, last_turn, turns = held
            return {"conv": conv, "part": part, "seg": seg, "symbols": "".join(symbols), "first_turn": first_turn,
                    "last_turn": last_turn, "turns": turns}

        for batch in batches:
            done = []
            for conv, turn, role, shape, n, is_first in zip(*[c.to_pylist() for c in batch.columns]):
                if held is not None and held[0] != conv:
                    done.append(row())
                    seg, held = seg + 1, None
                held = held or [conv, [], None, None, 0]
                if turn is not None and turn != held[3]:
                    held[2], held[3], held[4] = turn if held[2] is None else held[2], turn, held[4] + 1
                again = symbol(role, BLANK if shape == BLANK else DUPLICATE)
                if is_first:
                    held[1].append(symbol(role, shape))
                    n -= 1
                while n or len(held[1]) >= SEGMENT:
                    take = min(n, SEGMENT - len(held[1]))
                    held[1] += [again] * take
                    n -= take
                    if len(held[1]) >= SEGMENT:
                        done.append(row())
                        seg, held = seg + 1, [conv, [], None, held[3], 0]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if held is not None and (held[1] or held[4]):
            yield pa.RecordBatch.from_pylist([row()], schema=out)

    return lined.mapInArrow(work, "conv long, part int, seg long, symbols string, first_turn long, last_turn long, turns long")


# ---- Re-Pair ----

def learn(strings: DataFrame, max_rules: int = MAX_RULES) -> Grammar:
    """A grammar for strings of symbols (column ``symbols``)."""
    distinct = C.ckpt(strings.groupBy("symbols").agg(F.count("*").alias("n")))
    grammar = Grammar()
    for _ in range(MAX_ROUNDS):
        found = distinct.mapInArrow(_pairs(grammar.rounds), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = found.where("n > 1").orderBy(F.desc("n"), "pair").limit(max_rules + 1).collect()
        used, chosen, saved = set(), [], 0
        total = next((n for pair, n in top if not pair), 0)
        for pair, n in top:
            if (pair and used.isdisjoint(pair) and grammar.span[pair[0]] + grammar.span[pair[1]] <= MAX_SPAN
                    and len(chosen) < max_rules - len(grammar.halves)):
                chosen.append(pair)
                used |= set(pair)
                saved += n
        if chosen:
            grammar.add(chosen)
        if saved < LEAST_GAIN * total or not chosen:
            break
    return grammar


def _pairs(rounds: list[list[tuple[str, str]]]) -> Callable:
    def work(batches):
        for batch in batches:
            total: dict[str, int] = {"": 0}  # pairs, and all symbols under no pair
            for symbols, n in zip(*[c.to_pylist() for c in batch.columns]):
                s = compress(symbols, rounds)
                total[""] += len(s) * n
                for k in range(len(s) - 1):
                    total[s[k:k + 2]] = total.get(s[k:k + 2], 0) + n
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
    return work


# ---- evaluation ----

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def _initial(s: str) -> str:
    return "sua?"[(ord(s) - _FIRST) // 4]


def _compressed(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """The strings compressed, with their counts and first and last symbols."""
    out = pa.schema([("symbols", pa.string()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])

    def of(s: str) -> dict:
        kinds = [sum(s.count(chr(_FIRST + 4 * r + k)) for r in range(4)) for k in (BLANK, DUPLICATE, TRUNCATED)]
        initials = "".join(map(_initial, s))
        illegal = sum(initials[k:k + 2] not in _LEGAL for k in range(len(s) - 1))
        return {"symbols": grammar.compress(s), "first": s[:1], "last": s[-1:], **dict(zip(_COUNTS, [*kinds, illegal]))}

    def work(batches):
        known = lru_cache(1 << 12)(of)
        for batch in batches:
            at = batch.schema.get_field_index("symbols")
            new = pa.Table.from_pylist([known(s) for s in batch.column(at).to_pylist()], schema=out)
            rest = [k for k in range(batch.num_columns) if k != at]
            full = pa.Table.from_batches([batch]).select(rest)
            for name in out.names:
                full = full.append_column(name, new.column(name))
            yield from full.combine_chunks().to_batches()

    return strings.mapInArrow(work, "conv long, part int, seg long, first_turn long, last_turn long, turns long, symbols string, "
                              "first string, last string, blank long, duplicate long, truncated long, illegal long")


def _evaluated(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """A report row per conversation from its compressed strings in order."""
    order = ["conv", "part", "seg"]
    lined = strings.repartition("conv").sortWithinPartitions(*order)
    names = _REPORT.replace(" long", "").replace(" string", "").split(", ")

    def work(batches):
        held = None

        def row():
            cost, audit = grammar.finish(held["vector"])
            gaps = held["last_turn"] - held["first_turn"] + 1 - held["turns"] if held["turns"] else 0
            return {"conv": held["conv"], "gaps": gaps, **{c: held[c] for c in _COUNTS}, "cost": cost, "audit": audit}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held is not None and held["conv"] != r["conv"]:
                    done.append(row())
                    held = None
                if held is None:
                    held = {"conv": r["conv"], "vector": {RAN: (0, None)}, "first_turn": None, "last_turn": None, "turns": 0,
                            "before": "", **dict.fromkeys(_COUNTS, 0)}
                if r["turns"]:
                    held["turns"] += r["turns"] - (r["first_turn"] == held["last_turn"])
                    held["first_turn"] = r["first_turn"] if held["first_turn"] is None else held["first_turn"]
                    held["last_turn"] = r["last_turn"]
                for c in _COUNTS:
                    held[c] += r[c]
                if r["symbols"]:
                    held["illegal"] += bool(held["before"]) and _initial(held["before"]) + _initial(r["first"]) not in _LEGAL
                    held["before"] = r["last"]
                    held["vector"] = grammar.advance(held["vector"], r["symbols"])
            if done:
                yield _batch(done, names)
        if held is not None:
            yield _batch([row()], names)

    return lined.mapInArrow(work, _REPORT)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"audit": pa.string(), "edit": pa.string(), "role": pa.string(), "text": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds.get(n, pa.int64())) for n in names]))


def _conversations(batches) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """(report, edits) of one conversation after the other; edits are read before
    the next conversation is."""
    stream = (r for b in batches for r in b.to_pylist())
    row = next(stream, None)
    while row is not None:
        conv = row["conv"]
        head = row if row["tag"] == 0 else {"conv": conv, "text": "", **dict.fromkeys(("gaps", *_COUNTS, "cost"), 0)}
        at = [row]

        def own(conv=conv, at=at):
            while at[0] is not None and at[0]["conv"] == conv:
                r = at[0]
                for _ in range(r["copies"]):
                    yield r["role"], r["text"]
                at[0] = next(stream, None)

        todo = edits(head["text"], own())
        yield head, todo
        for _ in todo:  # what was not read
            pass
        row = at[0]


class Plan:
    """What a repair needs: the rows, and the report (counts, cost and audit) of each
    conversation that has any."""

    def __init__(self, conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", copies: str | None = None, max_rules: int = MAX_RULES):
        self.rows = _rows(conv, id_col, turn_col, role_col, text_col, copies)
        strings = C.ckpt(segments(self.rows))
        self.grammar = learn(strings, max_rules)
        self.report = C.ckpt(_evaluated(_compressed(strings, self.grammar), self.grammar))

    def _streamed(self) -> DataFrame:
        """Each conversation's report, then its rows in order, side by side in one
        partition; the conversation's rows of no copies follow."""
        nothing = {c: F.lit(None).cast("long") for c in ("gaps", *_COUNTS, "cost")}
        rows = self.rows.select("conv", F.lit(1).alias("tag"), "turn", "role", "digest", F.when(F.col("copies") > 0, F.col("text")).alias("text"),
                                "copies", *[v.alias(c) for c, v in nothing.items()])
        head = self.report.select("conv", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                                  F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"),
                                  *nothing)
        both = rows.unionByName(head).repartition("conv").sortWithinPartitions("conv", "tag", "turn", "role", "digest")
        return both.select("conv", "tag", "role", "text", "copies", *nothing)

    def repaired(self) -> DataFrame:
        """The edited conversations: (conv, position, edit, role, text), deleted rows too."""
        names = ["conv", "position", "edit", "role", "text"]

        def work(batches):
            rows, size = [], 0
            for head, todo in _conversations(batches):
                for k, (edit, role, text) in enumerate(todo):
                    rows.append({"conv": head["conv"], "position": k, "edit": edit, "role": role, "text": text})
                    size += len(text) + 64
                    if size > 4 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
            yield _batch(rows, names)

        return self._streamed().mapInArrow(work, "conv long, position long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """The report of every conversation with the SHA-256 of its repaired rows
        (``role:text``, joined by newlines)."""
        names = ["conv", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]

        def work(batches):
            rows = []
            for head, todo in _conversations(batches):
                sha, between = hashlib.sha256(), b""
                for edit, role, text in todo:
                    if edit != "D":
                        sha.update(between + f"{role}:{text}".encode())
                        between = b"\n"
                rows.append({**{n: head[n] for n in names[:-2]}, "audit": head["text"], "repaired_sha256": sha.hexdigest()})
                if len(rows) == C.ARROW_ROWS:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

        return self._streamed().mapInArrow(work, _REPORT + ", repaired_sha256 string")


def damaged(conv: DataFrame) -> DataFrame:
    """The contract's damage, from crc32(``conv_id:turn``) % 20: 0 drops a row (it stays
    with 0 copies), 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key.cast("binary")) % 20
    return conv.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"),
                       F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after the contract's damage."""
    C.prepare(spark)
    plan = Plan(damaged(C.table(spark, sf_dir, "conversations")), copies="copies")
    return plan.digests().withColumnRenamed("conv", "conv_id")


ORACLE = r"""
with recursive""" + C.CRC_SQL + r""",
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         """ + C.crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')") + r""" % 20 as k
  from conversations, poly),
convs as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
damaged as (
  select c, turn, case when k = 4 then 'user' else role end as role,
         case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy
  from given join convs on given.conv_id is not distinct from convs.conv_id),
lined as (
  select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i,
         regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') as bare from damaged),
faults as (
  select *, case when bare = '' then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
                 when bare[-1] not in ('.', '!', '?') then 'truncated' else 'sound' end as fault,
         lag(role) over (partition by c order by i) as before
  from lined),
step(x, r, y) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(x, y, cost, audit, line) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', 'user:' || chr(10)), (1, 2, 3, 'I', 'user:' || chr(10)), (3, 2, 3, 'I', 'user:' || chr(10)),
  (2, 3, 3, 'I', 'assistant:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
edit as (
  select c, i, x, x as y, 4 as cost, 'D' as audit, '' as line from faults, (values (0), (1), (2), (3)) v(x)
  union all
  select c, i, x, y, if(fault = 'truncated', 3, 0), 'K', role || ':' || text || chr(10) from faults join step on r = role[1]
  where fault in ('sound', 'truncated')
  union all
  select c, i, x, y, if(fault = 'truncated', 6, 3), 'R', if(r = 'u', 'user:', 'assistant:') || text || chr(10) from faults join step on r <> 's'
  where fault in ('sound', 'truncated')),
best as (
  select c, 0::bigint as i, 0 as x, {'cost': 0, 'audit': '', 'line': ''} as b from convs
  union all
  select b.c, b.i + 1, e.y, min({'cost': (b.b.cost + n.cost + e.cost)::integer, 'audit': b.b.audit || n.audit || e.audit, 'line': b.b.line || n.line || e.line})
  from best b join ins n on n.x = b.x join edit e on e.c = b.c and e.i = b.i + 1 and e.x = n.y
  group by b.c, b.i, e.y),
ended as (
  select b.c, min({'cost': b.b.cost + n.cost, 'audit': b.b.audit || n.audit, 'line': b.b.line || n.line}) as b
  from best b join ins n on n.x = b.x and n.y in (0, 3)
  where b.i = (select coalesce(max(i), 0) from faults f where f.c = b.c) group by b.c),
counted as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before[1] || role[1] not in ('su', 'ua', 'au')) as illegal
  from faults group by c)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, b.cost::bigint as cost, b.audit as audit,
       sha256(b.line[:-2]) as repaired_sha256
from convs join ended using (c) left join counted using (c)
"""
