"""Bodies by the host's template on made hosts whose bodies are known."""

from __future__ import annotations

import random

from presswork.sources import templates as X


def made_host(host, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(3, 9))) for _ in range(400)]
    sentence = lambda: " ".join(r.choices(words, k=r.randint(10, 25))).capitalize() + "."
    topics = [sentence()[:20] for _ in range(6)]
    for i in range(n):
        body = [sentence() for _ in range(r.randint(4, 9))]
        menu = "".join(f"<li><a href='/{k}'>{t}</a>" for k, t in enumerate(topics)) + f"<li><a href='/x'>{sentence()[:15]}</a>"
        inside = "".join(f"<p>{b}<div class='box'>Read more at {host}</div>" if k == 1 else f"<p>{b}</p>" for k, b in enumerate(body))
        yield i, host, f"<html><body><div class='m'><ul>{menu}</ul></div><div class='c{seed}'>{inside}</div><div class='n'><p>Hot today: {topics[i % 6]}</p><p>All rights of {host}</p></div></body></html>", "\n".join(body)


def f1(got, want):
    a, b = got.split("\n") if got else [], want.split("\n")
    same = len(set(a) & set(b))
    return 2 * same / (len(a) + len(b))


def test_made_hosts_of_fifty_pages(spark):
    rows = [(100 * k + i, host, html, body) for k, host in enumerate(("a.example", "b.example")) for i, _, html, body in made_host(host, 50, k)]
    rows += [(900, "alone.example", "<p>" + "One page only, with words enough. " * 12 + "</p><nav>Home</nav>", ""), (901, None, None, ""), (902, "a.example", "<p>short", "")]
    df = spark.createDataFrame(rows, "page_id long, host string, html string, want string")
    got = {r.page_id: r.body for r in X.template_bodies(df).collect()}
    assert len(got) == 103
    mean = sum(f1(got[i], want) for i, _, _, want in rows[:100]) / 100
    assert mean >= 0.95, mean
    assert got[900] == ("One page only, with words enough. " * 12).strip() and got[901] == "" and got[902] == ""


def test_the_second_extractor_fills_in(spark):
    rows = [(i, h, html) for i, h, html, _ in made_host("c.example", 12, 3)] + [(50, "c.example", "<article><p>" + "An article of its own, at length. " * 12 + "</p></article>")]
    out = {r.page_id: r for r in X.bodies(spark.createDataFrame(rows, "page_id long, host string, html string")).collect()}
    assert out[50].extractor == "article" and all(r.body for r in out.values())
