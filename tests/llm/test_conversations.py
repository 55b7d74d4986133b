"""Conversation repair and chat formatting against brute force."""

import hashlib
import itertools
import random
import re
import zlib

from traitscope.llm import chat_format as cf
from traitscope.llm import conversation_repair as cr

NAMES = "conv_id long, turn long, role string, text string"


def brute_repair(rows):
    """Cost and audit by a plain table of costs over rows [(initial, must_go, open_end)]."""
    n = len(rows)
    far = 10**9
    go = [[far] * 4 for _ in range(n + 1)]
    for k in range(n, -1, -1):
        for s in range(4):
            if k == n:
                go[k][s] = 0 if s in (0, 3) else far
            else:
                initial, must, open_end = rows[k]
                best = 2 + go[k + 1][s]
                if not must:
                    if s in cr.KEPT.get(initial, {}):
                        best = min(best, 5 * open_end + go[k + 1][cr.KEPT[initial][s]])
                    best = min(best, 1 + 5 * open_end + go[k + 1][cr.FOLLOWS[s]])
                go[k][s] = best
        for _ in range(4):
            for s in range(4):
                go[k][s] = min(go[k][s], 5 + go[k][cr.FOLLOWS[s]])
    k, s, audit = 0, 0, ""
    while not (k == n and s in (0, 3)):
        found = []
        if 5 + go[k][cr.FOLLOWS[s]] == go[k][s]:
            found.append(("I", k, cr.FOLLOWS[s]))
        if k < n:
            initial, must, open_end = rows[k]
            if 2 + go[k + 1][s] == go[k][s]:
                found.append(("D", k + 1, s))
            if not must:
                if s in cr.KEPT.get(initial, {}) and 5 * open_end + go[k + 1][cr.KEPT[initial][s]] == go[k][s]:
                    found.append(("K", k + 1, cr.KEPT[initial][s]))
                if 1 + 5 * open_end + go[k + 1][cr.FOLLOWS[s]] == go[k][s]:
                    found.append(("R", k + 1, cr.FOLLOWS[s]))
        letter, k, s = min(found)
        audit += letter
    return go[0][0], audit


def every_audit(rows, longest):
    """The best of all lists of edits, straight from the grammar."""
    best = None
    for size in range(longest + 1):
        for edits in itertools.product(["D", "K", "Ru", "Ra", "Iu", "Ia"], repeat=size):
            at, cost, out = 0, 0, ""
            for e in edits:
                if e[0] == "I":
                    cost, out = cost + 5, out + e[1]
                    continue
                if at == len(rows):
                    break
                initial, must, open_end = rows[at]
                at += 1
                if e == "D":
                    cost += 2
                elif must:
                    break
                else:
                    cost, out = cost + 5 * open_end + (e[0] == "R"), out + (initial if e == "K" else e[1])
            else:
                if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
                    key = (cost, "".join(e[0] for e in edits))
                    best = key if best is None or key < best else best
    return best


def symbols(rows):
    return [(cr.GONE if m else 2 * ("sua".find(i) if i in tuple("sua") else 3) + t, 1) for i, m, t in rows]


def test_costs_and_audits_are_the_best_of_all_lists():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suaax"), rng.random() < 0.15, rng.random() < 0.25) for _ in range(rng.randint(0, 3))]
        assert cr.repair_runs(symbols(rows)) == every_audit(rows, 5) == brute_repair(rows)


def test_runs_of_any_length():
    rng = random.Random(2)
    for _ in range(300):
        runs = [((rng.choice("suaax"), rng.random() < 0.2, rng.random() < 0.3), rng.choice([1, 1, 2, 3, 7, 50])) for _ in range(rng.randint(0, 12))]
        rows = [r for r, n in runs for _ in range(n)]
        assert cr.repair_runs([(symbols([r])[0][0], n) for r, n in runs]) == brute_repair(rows)


def test_a_long_run_takes_few_steps():
    n = 3_000_001
    cost, audit = cr.repair_runs([(2, n)])  # users only
    assert len([x for x in audit if x != "I"]) == n and cost == 1 * audit.count("R") + 2 * audit.count("D") + 5 * audit.count("I")
    assert cost == (n - 1) // 2 + 2
    assert cr._cached_letters.cache_info().currsize < 4096


def brute_report(rows):
    """The contract, row by row, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
            damaged += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in damaged:
            end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in damaged if t is not None}
        cost, audit = brute_repair(kinds)
        state, at, parts = 0, 0, []
        for letter in audit:
            if letter == "I":
                state = cr.FOLLOWS[state]
                parts.append(cr.ROLES[state] + ":")
                continue
            _, role, text = damaged[at]
            at += 1
            if letter == "K":
                state = cr.KEPT[role[0]][state]
            elif letter == "R":
                state = cr.FOLLOWS[state]
                role = cr.ROLES[state]
            if letter != "D":
                parts.append(f"{role}:{text}")
        roles = "".join(p[0] for p in parts)
        assert re.fullmatch("(s?(ua)+)?", roles)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def report(df):
    rows = cr.conversation_repair(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "No end"), (1, None, None, "Null turn."), (1, None, "user", "Also null."),
    (None, 0, "user", "No id."), (None, None, None, None), (2, 5, "", "Empty role!"), (2, 9, "tool", "Other role?"), (2, 9, "tool", "Same turn."),
    (3, 0, "user", None), (3, 1, "assistant", " \t\n\x0b\x0c\r "), (3, -4, "system", "Below zero."), (4, 0, "system", "Only a system."),
    (5, 0, "user", "é  größer 🙂."), (5, 1, "assistant", "Ends in blanks. \n"), (5, 2, "User", "Capital."), (5, 3, "assistant", "x" * 300_000 + "."),
    (6, -(1 << 63), "user", "Far."), (6, (1 << 63) - 1, "assistant", "apart."),
]


def test_report_of_odd_rows(spark):
    rows = ODD + [(c, t, r, x) for c in range(100, 160) for t, r, x in [(0, "user", "Q."), (1, "user", "Q."), (2, "assistant", "A no end"), (3, "assistant", "A.")]]
    rows += [(7, t, "ua"[t % 2] + "x", f"T{t % 90}.") for t in range(400)]
    df = spark.createDataFrame(rows, NAMES).repartition(5)
    want = brute_report(rows)
    want[6] = ((1 << 63) - 1, *want[6][1:]) if want[6][0] > (1 << 63) - 1 else want[6]
    clash = df.selectExpr("*", "1 as digest", "2 as kind", "3 as fault", "4 as audit", "5 as _salt", "6 as gone")
    assert report(df) == report(clash) == want


def test_report_of_the_table(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    assert report(df) == brute_report([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "Q."), (1, 2, "assistant", ""), (1, 3, "assistant", "R.")], NAMES)
    rows = cr.undamaged(df)
    found = cr.audits(rows)
    assert found.first().audit == "DKDK"
    got = cr.repaired_conversations(rows, found).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Q."), (1, 1, "assistant", "R.")]


def test_no_conversations(spark):
    df = spark.createDataFrame([], NAMES)
    assert cr.conversation_repair(df).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(9, gone, "user", "Dropped.")], NAMES)
    assert report(one) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


CONTROLS = ["</s>", "<s>", "[INST] ", " [/INST]", "[SYS] ", " [/SYS]", "[ROLE]", "[/ROLE]", "[END]", "<\\/s>", "[\\\\INST]", "<", "[", "\\", " ", "\n", "é🙂", ""]


def brute_chat(rows):
    """Digests straight from the rows, and the length by the template."""
    out = {}
    escape = lambda t: re.sub(r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|END\])", lambda m: m[1] + "\\" + m[2] + m[3], t)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c == conv))
        turns = [(r.decode(), x.decode()) for _, _, r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        frame = {"user": 15, "assistant": 7, "system": 13}
        chars = sum(len(escape(x)) + (frame[r] if r in frame else 18 + len(escape(r))) for r, x in turns)
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    rows = list(ODD)
    for c in range(200, 260):
        for t in range(rng.randint(1, 6)):
            said = "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 8)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[END]", "", "a</s>\n[/ROLE]"]), said))
    df = spark.createDataFrame(rows, NAMES).repartition(3).selectExpr("*", "1 as loss", "2 as formatted", "3 as plain", "4 as turn_text")
    got = {r.conv_id: tuple(r)[1:] for r in cf.chat_format(df).collect()}
    hostile = [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert got == brute_chat(rows + hostile)


def test_chat_masks_and_bare_control_strings(spark):
    df = spark.createDataFrame([(1, 0, "user", "<s>x"), (1, 1, "assistant", "y</s>z"), (2, 0, "tool", "t")], NAMES)
    got = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    assert got[1].formatted == "[INST] <\\s>x [/INST]<s>y<\\/s>z</s>"
    assert [tuple(x) for x in got[1].loss] == [(20, 0), (3, 7)]
    assert got[2].formatted == "[ROLE]tool[/ROLE]t[END]"


def test_chat_of_no_conversations(spark):
    df = spark.createDataFrame([], NAMES)
    assert cf.format_conversations(df).collect() == []
    assert [r.conv_id for r in cf.chat_format(df).collect()] == [-7]


def test_broken_conversations_are_refused(spark):
    import pytest

    for text, loss in [("[INST] x [/INST]y", "array(struct(16 as skip, 0 as take))"), ("<s>a<s>b</s>", "array(struct(3 as skip, 5 as take))")]:
        df = spark.createDataFrame([(1, text)], "conv_id long, formatted string").selectExpr("*", f"{loss} as loss")
        with pytest.raises(Exception, match="grammar"):
            cf.chat_digests(df).collect()
