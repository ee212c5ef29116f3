"""The path-template tree against a plain one in Python, and what only a tree can tell."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tilewright.llm import urls


def plain_tree(shapes, prior=1.0, threshold=0.5, z=2.0, star_share=2 / 3):
    """{(host, template): (node, purity)}; shapes: {(host, template): (n, bad)}."""
    n, bad = (sum(v[i] for v in shapes.values()) for i in (0, 1))
    out = {}

    def walk(node, over, rows):
        n, bad = (sum(r[2 + i] for r in rows) for i in (0, 1))
        purity = (bad + prior * over) / (n + prior)
        rests = [r[1] for r in rows if r[2] and r[1]]
        if bad in (0, n) or not rests:
            out.update({r[0]: (node, purity) for r in rows})
            return
        take = 1
        while all(len(x) > take and x[:take + 1] == min(rests)[:take + 1] for x in rests):
            take += 1
        counts = defaultdict(lambda: [0, 0])
        for r in rows:
            if r[2] and r[1]:
                c = counts["/".join(r[1][:take])]
                c[0] += r[2]
                c[1] += r[3]
        side = {s: (b + prior * purity) / (m + prior) >= threshold for s, (m, b) in counts.items()}
        alike = {}
        for s, (m, b) in counts.items():
            own = [counts[x] for x in counts if side[x] == side[s]]
            rate, size = sum(x[1] for x in own) / sum(x[0] for x in own), sum(x[0] for x in own)
            alike[s] = abs(b / m - rate) <= z * (max(rate * (1 - rate), 1 / (4 * size)) / m) ** 0.5
        kinds = {k: sum(alike[s] and side[s] == k for s in counts) for k in (True, False)}
        names = {True: f"{node}/{{unwanted}}", False: f"{node}/{{fine}}"}
        most = max(kinds.values())
        star = names[kinds[True] > kinds[False]] if most >= 2 and most >= star_share * len(counts) else None
        below = defaultdict(list)
        for r in rows:
            seg = "/".join(r[1][:take]) if r[1] and len(r[1]) >= take else None
            child = star if seg else None
            if seg in counts:
                child = names[side[seg]] if alike[seg] and kinds[side[seg]] >= 2 else f"{node}/{seg}"
            if child:
                below[child].append((r[0], r[1][take:], *r[2:]))
            else:
                out[r[0]] = (node, purity)
        for child, own in below.items():
            walk(child, purity, own)

    for host in {h for h, _ in shapes}:
        walk(host, bad / n, [((h, t), list(t), *v) for (h, t), v in shapes.items() if h == host])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    shapes = {}
    for _ in range(300):
        depth = rng.randint(0, 5)
        template = tuple(rng.choice("abcdefgh"[: 2 + 2 * k]) for k in range(depth))
        n = rng.choice([0, 1, 2, 9])
        lean = 0.9 if template[:1] == ("a",) else 0.1 if template[1:2] != ("b",) else 0.5
        shapes[f"h{rng.randint(0, 2)}", template] = (n, sum(rng.random() < lean for _ in range(n)))
    shapes["h0", ("a", "long", *"xyzxyzxyz", "end")] = (4, 2)
    rows = [(h, list(t), *v) for (h, t), v in shapes.items()]
    got = urls.judge_templates(spark.createDataFrame(rows, "host string, template array<string>, n long, bad long")).collect()
    want = plain_tree(shapes)
    assert {(r.host, tuple(r.template)): r.node for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.purity - want[r.host, tuple(r.template)][1]) < 1e-9 for r in got) and len({r.node for r in got}) > 20


def judged(spark, labelled, asked):
    table = spark.createDataFrame([(k, f"http://{u}") for k, u in enumerate([*labelled, *asked])], "page_id long, url string")
    from pyspark.sql import functions as F
    taught = spark.createDataFrame([(f"http://{u}", y) for u, y in labelled.items()], "url string, label int").select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "label")
    return {r.url[7:]: r.unwanted for r in urls.judge_urls(table, taught).collect()}


def test_wildcards_depth_and_smoothing(spark):
    labelled = {f"h.org/cat{c}/x{k}": 1 for c in "abcdefgh" for k in "pqr"} | {f"h.org/ok/x{k}": 0 for k in "pqr"}
    labelled |= {f"d.org/a/b/c/d/e/f/{w}/{k}": int(w == "bad") for w in ("good", "bad") for k in "pqrst"}
    labelled |= {f"m.org/{s}/item{k}": int(s == "promo") for s in ("news", "blog", "shop", "promo") for k in range(6)} | {"m.org/news/odd-one": 1}
    out = judged(spark, labelled, ["h.org/catzz/x", "h.org/ok/new", "d.org/a/b/c/d/e/f/bad/zz", "d.org/a/b/c/d/e/f/good/zz", "d.org/a", "m.org/other/item9", "m.org/promo/else", "m.org/news/item77", "new.org/x", "h.org"])
    assert out["h.org/catzz/x"] and not out["h.org/ok/new"], "unseen siblings follow the merged branch"
    assert out["d.org/a/b/c/d/e/f/bad/zz"] and not out["d.org/a/b/c/d/e/f/good/zz"], "no cap on depth"
    assert not out["m.org/other/item9"] and out["m.org/promo/else"] and not out["m.org/news/item77"]
    assert all(out[u] == bool(y) for u, y in labelled.items())


def test_url_table_edge_rows(spark):
    table = spark.createDataFrame([(None, "http://a.org/x", 1), (1, None, 1), (1, None, 1), (2, "", 1), (3, "http://a.org/" + "s/" * 20_000, 1), (4, "http://a.org//x//", 1)], "page_id long, url string, host int")
    taught = spark.createDataFrame([("a.org", "/x", 1), ("a.org", "/x", 1), ("a.org", "/y", 0), ("a.org", "/y", None), ("a.org", "/y", 0), ("", "", 0)], "host string, path string, label int")
    out = urls.judge_urls(table, taught).collect()
    assert len(out) == 6 and sorted(r.page_id or 0 for r in out) == [0, 1, 1, 2, 3, 4]
    assert {r.page_id: r.unwanted for r in out if r.page_id in (None, 1, 4)} == {None: True, 1: False, 4: True}


def test_page_labels_come_from_shown_text(spark):
    rows = spark.createDataFrame([(k, f"http://h.org/{k}", h) for k, h in enumerate(["<p class='casino'>fine</p>", "<p>Casino!</p>", None, "betting", "éadults", "a<b>bet</b>"] * 4)], "page_id long, url string, html string")
    out = {r.path: r.label for r in urls.page_labels(rows).collect()}
    want = {f"/{k}": [0, 1, 0, 0, 0, 1][k % 6] for k in range(24)}
    assert out and len(out) < 24 and all(want[p] == y for p, y in out.items())

