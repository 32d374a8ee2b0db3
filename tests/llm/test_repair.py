"""Conversation repair against a plain dynamic program."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from langmix.llm import repair
from tests.llm import fixtures as X

DDL = "conv_id long, turn long, role string, text string, conv string, digest string, tag string, copies string, symbols string"
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def cheapest(rows) -> tuple[int, str, list[tuple[str, str]]]:
    """rows: (role, text, fault); the best (cost, audit, repaired) by plain search."""
    def inserts(best):
        for _ in range(3):
            for s, (cost, audit, done) in list(best.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if r in STEP[s]:
                        new = (cost + 3, audit + "I", [*done, (role, "")])
                        best[STEP[s][r]] = min(best.get(STEP[s][r], new), new, key=lambda x: x[:2])
        return best

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        best, after = inserts(best), {}
        for s, (cost, audit, done) in best.items():
            options = [(s, 4, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] in STEP[s]:
                    options.append((STEP[s][role[:1]], extra, "K", role))
                options += [(STEP[s][r], 3 + extra, "R", full) for r, full in (("u", "user"), ("a", "assistant")) if r in STEP[s]]
            for to, c, letter, new_role in options:
                new = (cost + c, audit + letter, done if new_role is None else [*done, (new_role, text)])
                after[to] = min(after.get(to, new), new, key=lambda x: x[:2])
        best = after
    best = inserts(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def report(conv, rows) -> tuple:
    """rows: (turn, role, text) in order."""
    kinds = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, done = cheapest([(role, text, k) for (_, role, text), k in zip(rows, kinds)])
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    return (conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)


def brute(table, damage=True) -> Counter:
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text, n = " " if role is None else role, " " if text is None else text, 1
        if damage:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            n = {0: 0, 3: 2}.get(k, 1)
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            role = "user" if k == 4 else role
        convs[conv] += [(turn, role, text)] * n
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return Counter(report(c, sorted(rows, key=order)) for c, rows in convs.items())


def table(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice([f"Fine {t}.", f"Fine {t}.", "ok?", "cut off", " \t", "", "Same.", "Yes! \n"])
            rows.append((c, t + (t > 5), role, text))
    rows += [(c, 1, "user", "Tie."), (c, 1, "assistant", "Tie."), (c, 1, "user", "Tie.")] if (c := 9001) else []
    rows += [(None, None, None, None), (None, 3, "user", "a."), (9002, None, "user", "Hm."), (9002, None, "assistant", "Hm."), (9002, 0, "", "x."),
             (9003, 5, "sam", "long " * 50_000 + "."), (9003, 6, "umpire", "é。"), (-7, -3, "user", "a.\x0b"), (-7, -3, "user", "a.\x0b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DDL).repartition(5)


def test_query_equals_brute_force(spark):
    rows = table()
    found = X.rows_of(repair.Plan(repair.damaged(frame(spark, rows)), copies="copies").digests())
    assert found == brute(rows)


def test_no_rules_and_short_strings_give_the_same(spark, monkeypatch):
    rows = table(2, 60) + [(5000, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"T {t % 50}.") for t in range(700)]
    want = brute(rows, damage=False)
    monkeypatch.setattr(repair, "SEGMENT", 16)
    for rules in (0, 3, 1024):
        plan = repair.Plan(frame(spark, rows), max_rules=rules)
        assert X.rows_of(plan.digests()) == want, rules
    assert len(plan.grammar.halves) > 10


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", " ")]
    out = [tuple(r) for r in repair.Plan(frame(spark, rows)).repaired().orderBy("conv", "position").collect()]
    cost, audit, done = cheapest([("assistant", "Hi.", ""), ("user", "cut", "truncated"), ("user", " ", "blank")])
    assert "".join(r[2] for r in out) == audit
    assert [(r[3], r[4]) for r in out if r[2] != "D"] == done


def test_one_conversation_of_many_equal_and_distinct_rows(spark):
    rows = [(7, t // 2, ("user", "assistant")[t % 2], "Again." if t % 3 == 0 else f"Row {t}.") for t in range(9000)] + [(8, 0, "user", "Again.")] * 5000
    assert X.rows_of(repair.Plan(frame(spark, rows)).digests()) == brute(rows, damage=False)


def test_all_rows_dropped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 0)], "conv_id long, turn long, role string, text string, n long")
    assert X.rows_of(repair.Plan(df, copies="n").digests()) == Counter({(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1})


def test_empty_table(spark):
    plan = repair.Plan(spark.createDataFrame([], DDL))
    assert plan.digests().count() == 0 and plan.repaired().count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "truncated", "blank", "duplicate"])), max_size=14))
def test_grammar_product_equals_plain_program(rows):
    kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    symbols = "".join(repair.symbol(role, kinds[k]) for role, k in rows)
    grammar = repair.Grammar()
    rng = random.Random(symbols)
    for _ in range(4):
        s = grammar.compress(symbols)
        if len(s) < 2:
            break
        k = rng.randrange(len(s) - 1)
        grammar.add([s[k:k + 2]])
    found = grammar.finish(grammar.advance({repair.RAN: (0, None)}, grammar.compress(symbols)))
    assert found == cheapest([(role, "t", k) for role, k in rows])[:2]
    assert len(list(repair.edits(found[1], iter([(r, "t") for r, _ in rows])))) == len(found[1])
