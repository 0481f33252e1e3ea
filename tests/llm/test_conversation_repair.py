import hashlib
import random
import zlib

from barloom.llm import conversation_repair as cr
from barloom.llm import queries

SCHEMA = "turn long, text string, conv_id long, role string, _c string, audit string"
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
BLANKS = " \t\n\v\f\r"


def plain(turns):
    """Report of one conversation's sorted (turn, role, text), every path tried state by state."""
    seen, faults = set(), []
    for _, role, text in turns:
        held = text.strip(BLANKS)
        faults.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(found):
        for _ in range(3):
            for q in list(found):
                cost, audit, kept = found[q]
                role = {"u": "user", "a": "assistant"}[wanted[q]]
                offer(found, wanted[q], (cost + INSERT, audit + "I", kept + ((role, ""),)))
        return found

    for (_, role, text), fault in zip(turns, faults, strict=True):
        now = {}
        for q, (cost, audit, kept) in inserted(best).items():
            offer(now, q, (cost + DELETE, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = CUT if fault else 0
            if (q, role[:1]) in after:
                offer(now, after[q, role[:1]], (cost + more, audit + "K", kept + ((role, text),)))
            for new in ("user", "assistant"):
                if (q, new[0]) in after and role != new:
                    offer(now, new[0], (cost + more + REROLE, audit + "R", kept + ((new, text),)))
        best = now
    cost, audit, kept = min(v for q, v in inserted(best).items() if q in ("", "a"))
    numbers = {t for t, _, _ in turns if t is not None}
    legal = {"su", "ua", "au"}
    illegal = sum(a[1][:1] + b[1][:1] not in legal for a, b in zip(turns, turns[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), kept


def ordered(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def spoilt(rows):
    """The query's damage: {conv_id: [(turn, role, text)]}, with every conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def got(df):
    return sorted(((str(r[0]), *r[1:]) for r in df.collect()))


def made(conversations):
    return sorted((str(c), *plain(ordered(t))[0]) for c, t in conversations.items())


def random_rows(n, seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["a.", "b", "c!", "", " \n", "d?", "e.", "f.", "g.", None, "é…", "x. \t"]
    return [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(texts), rng.choice([None, *range(1, n // 6)]), rng.choice(roles), "clash", "clash") for _ in range(n)]


def by_conversation(rows):
    out = {}
    for turn, text, conv, role, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_automaton_equals_every_path():
    rng, automaton = random.Random(1), cr.Automaton()
    for _ in range(3000):
        turns = [(k, rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice("a. b c! d? e. f.".split() + [""])) for k in range(rng.randrange(14))]
        report, _ = plain(turns)
        faults = [cr.fault_of(r, t, (r, t) in [(x, y) for _, x, y in turns[:k]]) for k, (_, r, t) in enumerate(turns)]
        assert automaton.repair([cr.symbol_of(r, f) for (_, r, _), f in zip(turns, faults, strict=True)]) == report[5:7]
    assert len(automaton.vectors) < 100


def test_states_stay_few_however_long_the_scan():
    automaton, rng = cr.Automaton(), random.Random(2)
    automaton.repair([4 + 3] * 5000)
    automaton.repair([rng.randrange(12) for _ in range(20000)])
    assert len(automaton.vectors) < 100


def test_reports_equal_the_plain_ones_whole_and_in_blocks(spark):
    rows = random_rows(400)
    df = spark.createDataFrame(rows, SCHEMA)
    want = made(by_conversation(rows))
    assert got(cr.repair_report(df)) == want
    for most in (3, 7):
        assert got(cr.repair_report(df, most=most)) == want


def test_one_conversation_with_most_rows_and_copies_alike(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9) // 8 * k, rng.choice(["a.", "b.", f"t{k}.", "cut"]), 1, rng.choice(["user", "assistant"]), "x", "y") for k in range(500)]
    rows += [(0, "same.", 1, "user", "x", "y")] * 200 + [(1, "hi.", 2, "user", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = made(by_conversation(rows))
    assert got(cr.repair_report(df, most=40)) == want == got(cr.repair_report(df))


def test_repaired_turns(spark):
    rows = random_rows(200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((str(c), k, *t) for c, turns in by_conversation(rows).items() for k, t in enumerate(plain(ordered(turns))[1]))
    for most in (10_000, 4):
        found = cr.repair(df, most=most).collect()
        assert sorted((str(r.conv_id), r.place, r.role, r.text) for r in found) == want
        assert {r.edit for r in found} <= {"K", "R", "I"}


def test_query_equals_the_plain_damage_and_repair(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert got(queries.op11_conversation_repair(spark, sf_dir)) == made(spoilt(rows))
    odd = [(c, t, r, x) for t, x, c, r, *_ in random_rows(500, 9)]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op11_conversation_repair(spark, str(tmp_path))) == made(spoilt(odd))


def test_long_texts_and_an_empty_table(spark):
    long = "wörd " * 300_000
    rows = [(0, long + ".", 1, "user", "", ""), (1, long, 1, "assistant", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(cr.repair_report(df)) == made(by_conversation(rows)) == got(cr.repair_report(df, most_bytes=1000))
    assert cr.repair_report(df.limit(0)).count() == 0 == cr.repair(df.limit(0)).count()
