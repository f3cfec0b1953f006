"""Main text, filter audit and conversation repair against plain versions and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.llm import conversations as C
from presswork.llm import filter_audit as A
from presswork.llm import main_text as H

LONG = "The harbour was quiet in the morning, and the boats, which had come in late, lay still. " * 3


def page(body, head=""):
    return f"<!doctype html><html><head><title>Site</title>{head}</head><body>{body}</body></html>"


PAGES = {
    "chrome": (
        page(
            f"<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class='cookie-notice'><p>We use cookies, really, for all, of this.</p></div>"
            f"<article><header><h1>A &amp; B</h1></header><p>{LONG}</p><script>var x='<p>no</p>'</script><div class=ad>Buy, buy, buy</div><p>Second<br>line &lt;here&gt;&nbsp;now</p><form><p>Sign up, please</p></form>"
            f"<section id=comments><article><p>{LONG} I agree, fully.</p></article></section><footer>By us</footer></article><aside><p>{LONG}</p></aside><footer>&copy; 2026, all rights</footer>"
        ),
        f"A & B\n\n{LONG.strip()}\n\nSecond line <here> now",
    ),
    "no article": (page(f"<div id=menu><a href=/>One, two</a></div><h1>Head</h1><div class=story><p>{LONG}</p><p>Short one.</p><ul><li>First item</li><li>Second</ul></div><div class=sidebar><p>{LONG}{LONG}</p></div>"), f"Head\n\n{LONG.strip()}\n\nShort one.\n\nFirst item\n\nSecond"),
    "sections": (page(f"<main><section><p>{LONG}</p></section><section><h2>More</h2><p>{LONG}</p></section><div class=related><p>{LONG}</p></div></main>"), f"{LONG.strip()}\n\nMore\n\n{LONG.strip()}"),
    "soup": (f"<article><h1>T</h1><p><b>T<br><p>{LONG}<p>One <i>two</b> three</i>&am", f"T\n\nT\n\n{LONG.strip()}\n\nOne two three&am"),
    "form page": (page(f"<form id=page><div><article><h1>T</h1><p>{LONG}</p></article></div></form>"), f"T\n\n{LONG.strip()}"),
    "menu inside": (page(f"<article><p>{LONG}</p><ul><li><a href=1>See one</a></li><li><a href=2>See two</a></li></ul><p><a href=3>Only a link</a></p></article>"), f"{LONG.strip()}\n\nOnly a link"),
    "hidden": (page(f"<article><p>{LONG}</p><p style='display: none'>secret</p><p hidden>more</p><p aria-hidden=true>x</p></article>"), LONG.strip()),
    "nothing": (page("<nav><a href=/>Home</a></nav><script>1</script>"), ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text_of_made_pages(name):
    html, text = PAGES[name]
    assert H.main_text(html) == text


def test_main_text_of_odd_rows(spark):
    deep = "<div>" * 3000 + "<p>Deep, deeper, deepest words.</p>"
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "no tags at all, only text", "x"), (4, "u", deep, "x"), (5, "u", "<p>" + "word, " * 50_000, "x"), (6, "u", "<a<b", "x"), (6, "u", "<a<b", "x")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    told = {r.page_id: r.text for r in out}
    assert told[None] == "no tags at all, only text" and told[4] == "Deep, deeper, deepest words." and told[5] == ("word, " * 50_000).strip() and told[1] == ""


def plain_counts(text):
    words = text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)]


def made_texts(seed):
    r = random.Random(seed)
    alphabet = "aAbB #$\t\né中 \x00\U0001f600" + " " * 4
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 1, 5, 60, 900]))) for _ in range(120)]
    return [*texts, "", " ", "x" * 3000, "ab " * 2000, "".join(f"w{i % 700} " for i in range(4000))]


@pytest.mark.parametrize("run", [7, 64, A.RUN])
def test_measured_texts_equal_plain_counts(monkeypatch, run):
    monkeypatch.setattr(A, "RUN", run)
    texts = made_texts(1)
    got = A.measured_texts(pa.array(["skipped", *texts]).slice(1))
    assert got.T.tolist() == [plain_counts(t) for t in texts]
    assert A.measured_texts(pa.array(texts, pa.large_string())).T.tolist() == [plain_counts(t) for t in texts]


@pytest.mark.parametrize("run", [64, A.RUN])
def test_words_of_one_hash_are_told_apart(monkeypatch, run):
    monkeypatch.setattr(A, "RUN", run)
    monkeypatch.setattr(A, "powers", lambda n: (np.ones(n, np.uint64), np.ones(n, np.uint64)))  # the hash is the sum of the bytes
    texts = [*made_texts(2), "ab ba ab", "ad bc cb " * 50]
    assert A.measured_texts(pa.array(texts)).T.tolist() == [plain_counts(t) for t in texts]


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = []
    for d, text, source in docs:
        n, distinct, capitals, symbols, points = plain_counts(text or "")
        f = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0, "E": d is not None and d > least[text or ""]}
        fails.append((source or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = {f: sum(next((s for s in o if s in x[1]), "") == f for o in orders for x in mine) for f in "ABCDE"}
        for o in orders:
            for k, f in enumerate(o):
                left = [x for x in mine if not x[1] & set(o[:k])]
                gone = [x for x in left if f in x[1]]
                out[part, o, k + 1] = (len(left) - len(gone), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), shapley[f])
    return out


def test_filter_audit_equals_plain_loops(spark, docs, none):
    r = random.Random(3)
    texts = ["".join(f"word{r.randint(0, n)} " for _ in range(r.choice([3, 210, 400]))) + r.choice(["", "", "$", "ABC" * 40]) for n in (5, 500) for _ in range(8)] + [None, "", " "]
    rows = [(r.choice([None, *range(12)]), r.choice(texts), r.choice(["s", "t", "", None])) for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(9)] + [(1, 0, 0), (1, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in A.audit(A.cells(docs(rows), table)).collect()}
    assert got == plain_audit(rows, labels)
    assert A.audit(A.cells(none, table)).count() == 0


def plain_repair(rows):
    """Cheapest edits by a table of (cost, audit, repaired) over rows and states, insertions relaxed until nothing changes."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def relaxed(best):
        changed = True
        while changed:
            changed = False
            for (q, x), p in moves.items():
                if q in best and x in names:
                    c, e, out = best[q]
                    new = (c + 3, e + "I", [*out, (names[x], "")])
                    if p not in best or new[:2] < best[p][:2]:
                        best[p], changed = new, True
        return best

    best = relaxed({0: (0, "", [])})
    for role, text, fault in rows:
        now = {}
        for q, (c, e, out) in best.items():
            options = [(q, (c + 4, e + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                options += [(p, (c + extra, e + "K", [*out, (role, text)])) for (a, x), p in moves.items() if a == q and role[:1] == x]
                options += [(p, (c + 3 + extra, e + "R", [*out, (names[x], text)])) for (a, x), p in moves.items() if a == q and x in names]
            for p, new in options:
                if p not in now or new[:2] < now[p][:2]:
                    now[p] = new
        best = relaxed(now)
    return min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])


def plain_digest(table):
    every = {}
    for conv, turn, role, text in table:
        name = " " if conv is None else str(conv)
        rows = every.setdefault(name, [conv, []])[1]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.sha256(text.encode()).hexdigest(), text)] * (2 if kind == 3 else 1)
    out = {}
    for name, (conv, rows) in every.items():
        seen, word = set(), []
        for _, _, role, _, text in sorted(rows):
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            word.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for known, t, *_ in rows if known]
        cost, audit, left = plain_repair(word)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(word, word[1:])]
        faults = [sum(w[2] == f for w in word) for f in ("blank", "duplicate", "truncated")]
        lines = "\n".join(f"{a}:{b}" for a, b in left)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def made_conversations(seed, n=60):
    r = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", "", " \n", "What?", "a longer text, cut", "Fine! ", None, "ok.é"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "sales"]
    rows = [(c if c else None, r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for c in range(n) for _ in range(r.randint(0, 14))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t % 50}.") for t in range(300)] + [(1001, None, "user", "again.")] * 40  # long ones
    r.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [2, 14])
def test_repair_equals_a_plain_table(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "CHUNK_BITS", bits)
    table = made_conversations(bits)
    got = {r.conv_id: tuple(r[c] for c in NUMBERS) for r in C.digest(spark.createDataFrame(table, TURNS)).collect()}
    assert got == plain_digest(table)


def test_repair_of_an_empty_table_and_clashing_names(spark):
    assert C.digest(spark.createDataFrame([], TURNS)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], TURNS).withColumns({"conv": F.lit(3), "digest": F.lit("x"), "at": F.lit(0), "n": F.lit(1)})
    rows, audits, numbers = C.repair(C.with_digest(C.keyed(df)))
    assert [(r.action, r.role, r.text) for r in rows.orderBy("chunk", "k", "step").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    assert audits.first().audit == "KK" and numbers.first().cost == 0


def test_the_automaton_stays_small():
    automaton = C.Automaton()
    r = random.Random(1)
    for _ in range(200):
        automaton.scan("".join(r.choices("suaoSUAO1234", k=200)), C.BEGIN)
    assert len(automaton.vectors) < 100 and len(automaton.moves) < 1200
