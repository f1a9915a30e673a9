"""Quality cascade, source mix, URL tree and chat repair against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchspark.llm import chat, mixing, quality, url_tree

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").translate(str.maketrans(BLANK, " " * 6)).split(" ") if text else []


def counts(text):
    words = [w for w in words_of(text) if w]
    text = text or ""
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(lines), len(at))


QUALITY = [
    None, "", " \n\t ", "a", "a b c", "a a a", "a a a a", "a b a b a", "x y z x y z", "one two\none two\n\none two ", "# * $ 😀 | <b>", "a\u00a0b c",
    " ".join(f"word{i}" for i in range(60)), "!!! " * 60, " ".join(f"t{i}!!" for i in range(60)), "\n".join(f"a{i // 2} b{i // 2} c d{i}" for i in range(40)),
    "same line here\n" * 30, "x" * 5000, " ".join(str(i) for i in range(70)), "lang " * 3000, " ".join(f"{'ab' * 9}{i}" for i in range(60)),
]


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = QUALITY + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").withColumn("at", F.lit("x"))
    got = quality.judged(df).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r["text"], r)
    for t in texts:
        r, want = by[t], counts(t)
        assert tuple(r[c] for c in quality.COUNTS) == want, t
        failed = want[0] < 50 or 100 * want[5] > 50 * want[0]
        assert r["base_failed"] == failed
        if failed:
            assert not r["kept"]
    assert by[QUALITY[12]]["kept"] and not any(by[QUALITY[i]]["kept"] for i in (13, 14, 15, 18, 20))


def test_the_order_of_rules_never_changes_verdicts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(QUALITY)), "doc_id long, text string")
    want = sorted((r["doc_id"], r["kept"]) for r in quality.judged(df).collect())
    monkeypatch.setattr(quality, "cascade_order", lambda _, of: list(of)[::-1])
    assert sorted((r["doc_id"], r["kept"]) for r in quality.judged(df).collect()) == want
    assert quality.judged(df.limit(0)).count() == 0


def test_rules_change_places_by_cost_and_selectivity(spark):
    rows = spark.createDataFrame([(i, ("good words " if i % 2 else "bad! ") * 300) for i in range(400)], "doc_id long, text string").cache()
    cheap, dear = F.length("text") < 0, F.length(F.regexp_replace("text", r"(\w+) (?=\w)", "$1")) < 0
    half = F.col("text").startswith("bad")
    order = lambda of: quality.cascade_order(rows, of)
    # Idle rules go by cost, whatever their order; a selective rule overtakes an idle one, dear or not.
    assert order({"dear": dear, "cheap": cheap}) == ["cheap", "dear"] == order({"cheap": cheap, "dear": dear})
    assert order({"idle": dear, "hits": half}) == ["hits", "idle"]
    assert order({"cheap": cheap & ~half, "dear hits": dear | half})[0] == "dear hits"
    assert order({"hits": half, "dear hits": dear | half}) == ["hits", "dear hits"] == order({"dear hits": dear | half, "hits": half})
    cost = quality.measured(rows, {"hits": half, "idle": cheap})
    assert cost["hits"][1] > 0.49 and 0 < cost["idle"][1] < 0.01
    assert quality.cascade_order(rows.limit(0), {"a": cheap, "b": dear}) == ["a", "b"]


def fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in clamped]
        level = (total - sum(clamped.values())) / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return clamped | {s: level * weight[s] for s in open_}
        clamped |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        source = ["big", "é", "small", None, "Z", "\U0001f600", "tiny"][min(6, int(rng.geometric(0.45)) - 1)]
        rows.append((i, source, " ".join(["w"] * int(rng.integers(0, 40))), 9))
    rows += [rows[5], rows[5], (None, "big", "a b c", 1), (700, "empty", None, 1), (701, "empty", "", 1), (702, "long", "word " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int").withColumn("target", F.lit("clash"))
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken = fill(sizes), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, mixing.mix(df.repartition(7)).collect())) == sorted(map(key, got))
    out = mixing.mixed_rows(df.drop("target"))
    assert out.columns == ["doc_id", "source", "text", "n_chars"]
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    urls = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/"), "https://badexample.org/es/1": ("badexample.org", "/es/1", "org/"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/"), "ftp://x.com/de/1#a": ("x.com", "/de/1", "com/de/"), "http://com/fr/": ("com", "/fr/", "com/fr/"),
        "http://x.com": ("x.com", "", None), "http://x.org?q=/a": ("x.org", "", None), "a://b://c/d": ("b:", "//c/d", None), "://É.com/fr/é": ("É.com", "/fr/é", "com/fr/"),
        "http://x.com#/de/1": ("x.com", "", None), "http://xcom/de/1": ("xcom", "/de/1", None), "http://x.org\n/a\nb?c": ("x.org\n", "/a\nb", None),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = url_tree.url_verdicts(df).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == urls[r["url"]]
        assert r["verdict"] in ("allow", "block")
    assert url_tree.url_verdicts(df.limit(0)).count() == 0


def test_templates_learn_from_rules(spark):
    rows = [f"http://h.com/bad/item-{'abcdefghijklmnop'[i]}{i}/x" for i in range(12)] + [f"http://h.com/good/{i}" for i in range(30)]
    rows += [f"http://h.com/bad/other{c}/y" for c in "qrstuv"] + ["http://h.com/new/1"]
    rules = (("h.com", "/bad/item", "block"), ("h.com", "/good/", "allow"))
    got = {r["url"]: r for r in url_tree.url_verdicts(spark.createDataFrame([(u,) for u in rows], "url string"), rules).collect()}
    assert got["http://h.com/bad/otherq/y"]["rule"] is None and got["http://h.com/bad/otherq/y"]["verdict"] == "block"
    assert got["http://h.com/new/1"]["verdict"] == "allow"


def templates_of(shapes):
    """(template, parent) of every (host, shape) of ``shapes`` with pages, all levels by hand."""
    out = {}

    def grow(node, rows, k):
        deeper = {}
        for (host, shape), n in rows:
            segments = shape.split("/")[1:]
            if len(segments) > k:
                deeper.setdefault(segments[k], []).append(((host, shape), n))
        distinct, pages = len(deeper), sum(n for of in deeper.values() for _, n in of)
        groups = {}
        for s, of in deeper.items():
            groups.setdefault("*" if distinct >= 8 and pages < 4 * distinct else s, []).extend(of)
        for s, of in groups.items():
            for (host, shape), _ in of:
                out[host, shape] = (f"{node}/{s}", node)
            grow(f"{node}/{s}", of, k + 1)

    hosts = {}
    for (host, shape), n in shapes.items():
        out[host, shape] = (host, host)
        hosts.setdefault(host, []).append(((host, shape), n))
    for host, rows in hosts.items():
        grow(host, rows, 0)
    return out


def test_templates_of_any_depth(spark):
    rng = random.Random(9)
    shapes = {("h", ""): 2, ("h", "/"): 1, ("h", "/" * 40): 1, ("g", "//a//"): 3, ("", ""): 1, ("h", "x"): 1}
    for host, few, most in (("h", 3, 9), ("g", 2, 7), ("i", 12, 5)):
        for _ in range(300):
            depth = rng.randint(1, most)
            path = "".join("/" + (f"s{rng.randrange(few)}" if rng.random() < 0.8 else "".join(rng.choices("abcdef", k=4))) for _ in range(depth))
            shapes[host, path] = rng.choice((1, 1, 1, 2, 9))
    shapes |= {("k", f"/a/b/c/d/{''.join(rng.choices('abcdef', k=4))}/{end}/{''.join(rng.choices('abcdef', k=4))}"): 1 for end in "xy" for _ in range(30)}
    df = spark.createDataFrame([(h, s, n, 0, 0) for (h, s), n in shapes.items()], "host string, shape string, n long, a long, b long")
    got = url_tree.generalised(df).collect()
    assert len(got) == len(shapes)
    want = templates_of(shapes)
    assert {(r["host"], r["shape"]): (r["template"], r["parent"]) for r in got} == want
    assert any("*" in t.split("/")[5:] for t, _ in want.values())


def test_branches_part_at_the_sixth_segment(spark):
    letters = "abcdefghijkl"
    rows = [f"http://h.com/a/b/c/d/{kind}/{x}{x}" for kind in ("good", "bad") for x in letters]
    rows += [f"http://h.com/a/b/c/d/{kind}/new{x}" for kind in ("good", "bad") for x in letters]
    rules = tuple(("h.com", f"/a/b/c/d/{kind}/{x}{x}", v) for kind, v in (("good", "allow"), ("bad", "block")) for x in letters)
    got = {r["url"]: r for r in url_tree.url_verdicts(spark.createDataFrame([(u,) for u in rows], "url string"), rules).collect()}
    for x in letters:
        assert got[f"http://h.com/a/b/c/d/good/new{x}"]["verdict"] == "allow"
        row = got[f"http://h.com/a/b/c/d/bad/new{x}"]
        assert (row["rule"], row["verdict"]) == (None, "block")


def branch_verdict(counts):
    """Verdict of every template of ``counts`` (template -> allowed, blocked) from its whole path."""
    total = {}
    for template, (a, b) in counts.items():
        parts = template.split("/")
        for i in range(1, len(parts) + 1):
            x = total.setdefault("/".join(parts[:i]), [0, 0])
            x[0], x[1] = x[0] + a, x[1] + b

    def group(node):
        if "/" not in node:
            return total[node]
        near = {n: c for n, c in total.items() if "/" in n and n.rsplit("/", 1)[0] == node.rsplit("/", 1)[0]}
        ta, tb = sum(c[0] for c in near.values()), sum(c[1] for c in near.values())

        def alone(c):
            a, b = c
            below = (a + b) * (ta + tb - a - b) * ta * tb
            return below > 0 and (ta + tb) * (a * (tb - b) - b * (ta - a)) ** 2 / below >= 3.841

        if alone(total[node]):
            return total[node]
        rest = [c for c in near.values() if not alone(c)]
        return sum(c[0] for c in rest), sum(c[1] for c in rest)

    out = {}
    for template in counts:
        node, found = template, group(template)
        while not sum(found) and "/" in node:
            node = node.rsplit("/", 1)[0]
            found = group(node)
        out[template] = "block" if (found[0] + 3) / (sum(found) + 4) < 0.5 else "allow"
    return out


def test_branches_take_evidence_from_higher_up(spark):
    rng = random.Random(12)
    counts = {}
    for i in range(120):
        template = f"h{i % 6}" + "".join(f"/{rng.choice('abc')}" for _ in range(rng.randint(0, 6)))
        bad = rng.random() < (0.9 if "/a" in template else 0.2)
        counts[template] = (0, 0) if rng.random() < 0.6 else (0, rng.randint(1, 30)) if bad else (rng.randint(1, 30), 0)
    rows = [(t.split("/")[0], t.rsplit("/", 1)[0], t, a, b) for t, (a, b) in counts.items()]
    df = spark.createDataFrame(rows, "host string, parent string, template string, a long, b long")
    got = {r["template"]: r["_judged"] for r in url_tree.branch_verdicts(df).collect()}
    assert got == branch_verdict(counts)
    urls = [f"http://x.com/bad/l/{'abcdefghi'[i]}/q" for i in range(9)] + ["http://x.com/bad/other/deep/one", "http://y.com/bad/other/deep/one", "http://x.com"]
    rules = (("x.com", "/bad/l/", "block"),)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["verdict"] for r in url_tree.url_verdicts(df, rules, branches=True).collect()}
    assert got[urls[9]] == "block" and got[urls[10]] == "allow" and got[urls[11]] == "block"
    plain = {r["url"]: r["verdict"] for r in url_tree.url_verdicts(df, rules).collect()}
    assert plain[urls[9]] == "allow"


def legal(roles):
    state = chat.START
    for r in roles:
        if r not in chat.LEGAL[state]:
            return False
        state = r
    return state == chat.END


def cheapest(roles, costs):
    """Least cost over all legal sequences, by search over (turns taken, state)."""
    best = {(0, chat.START): 0}
    for _ in range(6 * len(roles) + 6):
        for (k, s), c in list(best.items()):
            moves = [((k, r), c + costs.insert) for r in chat.LEGAL[s] if r != chat.SYSTEM]
            if k < len(roles):
                for to in (1, 2, 3):
                    named = roles[k] < 0
                    change = (costs.to_system if to == 1 else costs.name) if named else 0 if to == roles[k] else costs.to_system if to == 1 else costs.relabel
                    if to in chat.LEGAL[s]:
                        moves.append(((k + 1, to), c + change))
                    if to == s:
                        moves.append(((k + 1, to), c + change + costs.merge))
            for key, cost in moves:
                if cost < best.get(key, 1e9):
                    best[key] = cost
    return best[len(roles), chat.END]


def test_repairs_are_cheapest():
    machine, costs = chat.Repair(), chat.Costs()
    for n in range(1, 5):
        for roles in itertools.product((-1, 1, 2, 3), repeat=n):
            m = machine.matrix(list(roles))
            assert (m[chat.START] + machine.ends).min() == cheapest(roles, costs)
            last = int(np.argmin(m[chat.START] + machine.ends))
            out = []
            for to, inserted, action in machine.path(list(roles), chat.START, last):
                out += [*inserted, *([] if action == "merge" else [to])]
            assert legal([*out, *machine.fill[last, chat.START][1]])


def test_repair_over_segments(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "human", "tool", None, "Assistant ", ""]
    rows = [(1, t, rng.choice(roles), f"t{t}", 0) for t in range(400)]
    rows += [(c, t, rng.choice(roles), None if rng.random() < 0.1 else f"{c}-{t}", 0) for c in range(2, 40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no id", 0), (50, None, "assistant", "late", 0), (50, 1, "user", "x", 0), (50, 1, "user", "x", 0), (51, 0, "user", "word " * 50_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int").withColumn("part", F.lit("clash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repaired_turns(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["action"] != "insert" for r in got) == len(rows)
    machine, costs = chat.Repair(), chat.Costs()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        out = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["turn"] is None, r["turn"] or 0, r["part"]))
        assert legal([chat.ROLES.index(r["role"]) + 1 for r in out if r["action"] != "merge"])
        price = {"insert": costs.insert, "merge": costs.merge}
        codes = [chat.role_code(r[2]) for r in own]
        taken = [r for r in out if r["action"] != "insert"]
        paid = sum(price.get(r["action"], 0) for r in out)
        for code, r in zip(codes, taken, strict=True):
            to = chat.ROLES.index(r["role"]) + 1
            paid += 0 if to == code else costs.to_system if to == 1 else costs.name if code < 0 else costs.relabel
        assert paid == (cheapest(codes, costs) if len(codes) < 40 else (machine.matrix(codes)[chat.START] + machine.ends).min())
        assert [t for r in taken if (t := r["rendered"].removeprefix(f"<|{r['role']}|>\n")) is not None] == [f"{r[3] or ''}\n" for r in own]
    assert chat.repaired_turns(df.limit(0)).count() == 0


def test_rows_of_long_ties_keep_one_order(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", None]
    rows = [(c, None if c == 1 else 7, rng.choice(roles), f"{c}-{i}") for c in (1, 2) for i in range(3000)] + [(c, 0, "user", "x") for c in range(3, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repaired_turns(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({(r["conv_id"], r["place"], r["part"]) for r in got}) == len(got)
    for conv in (1, 2):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[2] is not None, r[2] or "", r[3]))
        out = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["place"], r["part"]))
        assert legal([chat.ROLES.index(r["role"]) + 1 for r in out if r["action"] != "merge"])
        taken = [r for r in out if r["action"] != "insert"]
        assert [r["place"] for r in taken] == list(range(3000))
        assert [r["rendered"].removeprefix(f"<|{r['role']}|>\n") for r in taken] == [f"{r[3]}\n" for r in own]
