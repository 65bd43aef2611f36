import random
import re

import pytest

from lumenmatch.llm import decontaminate, licenses, quality_rules, url_filter

from .conftest import SCHEMA, edited, rows_of, sentence


def prose(r, n):
    """Words of 3 to 9 letters, so that documents differ in their longest one."""
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_base_counts_equal_brute_force(docs, texts):
    more = [(900, "a b c a b c a b c\n\nx # $\nx # $\n x # $"), (901, "a b c d a b c d")]
    df = docs.sparkSession.createDataFrame(rows_of(texts + more), SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in texts + more:
        w, t = words_of(t), t or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 300 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        if hit is not None:
            assert r.n_repeat_words == len(hit)
            assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_boilerplate_documents_are_rejected_and_copies_are_not(spark, empty):
    r = random.Random(2)
    menu = [prose(r, 30) for _ in range(3)]
    rows = [(k, "\n".join([*menu, prose(r, 8 if k < 40 else 60)]), "en", "site", 0, "h", 1, "p", 1) for k in range(60)]
    copied = "\n".join(prose(r, 12) for _ in range(8))
    rows += [(100 + k, copied, "en", "site", 0, "h", 1, "p", 1) for k in range(60)]
    rows += [(200 + k, "\n".join(prose(r, 12) for _ in range(8)), "en", None, 0, "h", 1, "p", 1) for k in range(30)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    kept = {v.doc_id: v.kept for v in quality_rules.judge(df).collect()}
    assert not any(kept[k] for k in range(40)) and all(kept[k] for k in range(40, 60))
    assert all(kept[k] for k in kept if k >= 100)
    out = quality_rules.clean_documents(df)
    assert out.columns == df.columns and {x.doc_id for x in out.collect()} == {k for k, v in kept.items() if v}
    bare = {x.doc_id: x.text for x in out.collect()}
    assert bare[50] == rows[50][1].split("\n")[-1]
    assert quality_rules.judge(empty).count() == 0


def brute_kept(rows):
    """{(id, text): (removed words, kept)} of (id, text, host) rows, straight from the definition."""
    return {k: v[:2] for k, v in brute_cleaned(rows).items()}


def brute_cleaned(rows):
    """{(id, text): (removed words, kept, text without boilerplate lines)}."""
    docs = {(i, t or "", h) for i, t, h in rows}
    lines = {d: [(" ".join(words_of(x)).translate({k: k + 32 for k in range(65, 91)}), words_of(x)) for x in d[1].split("\n") if words_of(x)] for d in docs}
    longest = lambda w: max((len(x), x.encode()) for x in w)
    boiler, limit = set(), {}
    for host in {d[2] for d in docs}:
        mine = [d for d in docs if d[2] == host and lines[d]]
        limit[host] = max(5, 0.03 * len(mine))
        cands = {x for d in mine for x, _ in lines[d] if sum(x in {y for y, _ in lines[e]} for e in mine) > limit[host]}
        vote = {d: max((longest(w) for x, w in lines[d] if x not in cands), default=(0, b""))[1] for d in mine}
        boiler |= {(host, x) for x in cands if len({vote[d] for d in mine if x in {y for y, _ in lines[d]}}) > limit[host]}
    out = {}
    for i, t, host in docs:
        w = words_of(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        gone = sum(len(v) for x, v in lines[i, t, host] if (host, x) in boiler)
        base = len(w) >= 50 and 100 * len(hit) <= 50 * len(w)
        plain = lambda x: " ".join(words_of(x)).translate({k: k + 32 for k in range(65, 91)})
        left = "\n".join(x for x in t.split("\n") if (host, plain(x)) not in boiler)
        out[i, t] = (gone, base and len(w) - gone >= 50 and 100 * gone <= 70 * len(w), left)
    return out


@pytest.mark.parametrize("hosts", [quality_rules.HOSTS, 0])
def test_verdicts_equal_brute_force(spark, monkeypatch, hosts):
    """Banners, exact and edited copies, short documents, null hosts and texts, repeated rows and ids."""
    monkeypatch.setattr(quality_rules, "HOSTS", hosts)
    r = random.Random(3)
    own = lambda n: [prose(r, 12) for _ in range(n)]
    texts = [own(6) for _ in range(240)]
    line, base = prose(r, 20), own(8)
    for k in range(30):
        texts[k].insert(k % 7, line.upper() if k % 2 else line)
    rows = [(k, "\n".join(t), "site") for k, t in enumerate(texts)]
    rows += [(500 + k, "\n".join([line, *own(3)]), "site") for k in range(10)]
    rows += [(1000 + k, "\n".join(edited(r, x, 0.02) for x in base), "site") for k in range(120)]
    rows += [(2000 + k, "\n".join(base), "site") for k in range(80)] + [(3000 + k, "\n".join([*own(5), line]), None) for k in range(25)]
    rows += [(None, None, "site"), (None, "", None), (7, "\n".join(own(6)), "site"), *rows[:25]]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    want = brute_kept(rows)
    keys = {r.doc_id: [] for r in got}
    assert len(got) == len(rows)
    for v in got:
        keys[v.doc_id].append((v.removed_words, v.kept))
    for (i, _), x in want.items():
        assert x in keys[i]
    assert all(x in [y for (j, _), y in want.items() if j == i] for i, found in keys.items() for x in found)
    assert all(keys[k][0] == (20, True) for k in range(1, 30) if k != 7) and not any(keys[500 + k][0][1] for k in range(10))
    assert all(keys[k] == [(0, True)] for k in [*range(1000, 1120), *range(2000, 2080)])


def test_keep_documents_with_clashing_columns(spark):
    rows = [(1, "few words", 1, 2, 3, 4, "s"), (2, " ".join(f"w{k}" for k in range(60)), 1, 2, 3, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _k int, known int, h int, source string")
    kept = quality_rules.clean_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def items(spark, texts):
    return spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "item_id long, text string, h int")


def test_contamination_equals_brute_force(spark, docs, texts, empty):
    bench = [" ".join((texts[0][1] or "").split()[5:25]), " ".join((texts[36][1] or "").split()[18:40]), "One Two", None, "", "zz qq"]
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items(spark, bench)).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    for i, t in texts:
        w, hit, names = split(t), set(), set()
        for k, b in enumerate(bench):
            v = split(b)
            n = min(10, len(v))
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1 if v else 0):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (len(w), len(hit), sorted(names), bool(hit))
    assert decontaminate.contamination(empty, items(spark, bench)).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items(spark, [])).collect())


def test_spans_are_removed_and_the_rest_stays(spark, docs):
    out = decontaminate.remove_spans(docs, items(spark, ["three"]))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert decontaminate.contamination(out, items(spark, ["three"])).where("contaminated").count() == 0
    got = {r.doc_id: r.text for r in out.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    changed = {i for i in before if got[i] != before[i]}
    assert {before[i] for i in changed} == {"one two three four", "One two three four", "one two three four five"}
    assert got[next(i for i in changed if before[i].endswith("five"))] == "one two four five"


@pytest.mark.parametrize("run", ["\n", "# ", "* ", "> ", "-- ", " ", "\t", ". ", "\r\n", "/", "<!--", "x ; "])
def test_licenses_in_very_long_runs(spark, run):
    text = "Released under the MIT License." + run * (10**6 // len(run)) + "\nLicensed under CC BY 4.0."
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licenses.split(",")[-1] == "CC-BY-4.0" and (got.licenses == "MIT,CC-BY-4.0" or run in ("/", "x ; ", "<!--"))


def test_license_files_tags_and_numbered_clauses(spark):
    clauses = [f"   ({k}) {c}" for k, c in enumerate(licenses.BSD_CLAUSES, 1)]
    texts = {
        "MIT": "// SPDX-License-Identifier: MIT\nint main() {}\n", "GPL-3.0": "#!/bin/sh\n# SPDX-License-Identifier: GPL-3.0-or-later\n\necho",
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n",
        "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n",
        "BSD-3-Clause": "\n".join([licenses.BSD_OPENING, "", *clauses]), "BSD-2-Clause": "\n".join([licenses.BSD_OPENING, *clauses[:2]]),
        "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    }
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {k: k for k in texts}


def test_licenses(spark, empty):
    full = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance\nwith the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, full), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (6, "Released under the MIT License"), (7, "not released under the mit license")]
    got = {r.doc_id: (r.licenses, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("Apache-2.0", "Apache-2.0"), 3: ("", None), 4: ("", None), 5: ("GPL-3.0,CC-BY-NC-4.0", "GPL-3.0"), 6: ("MIT", "MIT"), 7: ("", None)}
    assert licenses.scan(empty).count() == 0


def test_every_notice_is_found_wrapped_indented_and_in_comments(spark):
    import textwrap

    rows, want = [], {}
    for k, (name, wording) in enumerate(licenses.NOTICES):
        lines = textwrap.wrap(wording, 66)
        for j, mark in enumerate(("", "    ", "# ", " * ", "// ", ";; ", "> ")):
            body = "\n".join(mark + x for x in lines)
            rows.append((10 * k + j, f"{mark}Some title\n{mark}\n{mark}Copyright (c) 2020 A. Body. All rights reserved.\n{mark}\n{body}\n\ncode = 1"))
            want[10 * k + j] = name
        rows.append((10 * k + 8, f"A heading\n{wording}\nmore"))
        want[10 * k + 8] = name
    rows += [(5000, "Copyright X. All rights reserved."), (5001, "# All rights reserved.\n" * 300)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want
    assert got[5000] == got[5001] == licenses.ALL_RIGHTS


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "/", "block"), (None, "/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string")
    urls = ["https://WWW.Example.com/en/7?q", "http://x.com/en/1#f", "http://com/en/", "http://b.a.example.com/z", "http://acom/en/", None, "nothing", "http://xexample.com/en/7", "ftp://a.example.com/en/71", "http://example.com"]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls + urls[:2])], "page_id long, url string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got[0] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/1", "com/en/", "block") and got[2][2] == "com/en/"
    assert got[3][2:] == ("a.example.com/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7][2] == "com/en/"
    assert got[8][2] == "example.com/en/7" and got[9] == ("example.com", "", None, "allow")
    assert len(got) == 12
    none = url_filter.judge(df, rules.limit(0))
    assert none.where("verdict = 'allow'").count() == 12 and url_filter.judge(df.limit(0), rules).count() == 0


def test_registered_url_rules_are_those_of_the_contract(spark, tmp_path):
    """Each rule once on its own host and once on a subdomain, and urls that fit none."""
    from lumenmatch.llm import queries

    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [(rule, f"http://{www}{rule}1") for rule in contract for www in ("", "www.")]
    urls += [(None, "http://example.net/en/8"), (None, "http://example.info/de/8"), ("net/de/", "http://example.net/de/7"), ("com/en/", "http://example.com/en/8")]
    rows = [(k, u, "") for k, (_, u) in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == {k: (rule, contract.get(rule, "allow")) for k, (rule, _) in enumerate(urls)}
    for host, path, verdict in queries.URL_RULES:
        assert contract[f"{host}{path}"] == verdict
    assert all(f"('{h}', '{p}', '{v}', '{h}{p}')" in queries.OP3_SQL for h, p, v in queries.URL_RULES)


def test_many_rules_of_one_host_and_a_host_with_most_urls(spark):
    """100,000 path rules on a host that holds nine tenths of the urls; nested ones, ties and prefixes as in the plain rule."""
    r = random.Random(4)
    paths = [f"/{k % 1000}/{k // 1000}" for k in range(100_000)] + ["/", "/7", "/7/", "/7/1/x", "/7/1/xy"]
    rules = [("a.org", p, "block" if k % 2 else "allow") for k, p in enumerate(paths)] + [("org", "/7/1/x/long/path", "allow"), ("b.a.org", "/7/5", "block")]
    urls = [f"http://{'b.' if k % 5 == 0 else ''}a.org/{r.randrange(1100)}/{r.randrange(120)}{r.choice(['', '/x', 'y'])}" for k in range(900)]
    urls += ["http://a.org/7/1/xyz", "http://a.org/7/1/x/long/path/2", "http://b.a.org/7/55", "http://c.net/7"] + [f"http://h{k}.com/" for k in range(96)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    by = {}
    for host, path, what in rules:
        by.setdefault(host, {})[path] = what
    for k, u in enumerate(urls):
        host, _, rest = u.removeprefix("http://").partition("/")
        path, best = "/" + rest, None
        for h, mine in by.items():
            if host == h or host.endswith("." + h):
                for n in range(len(path) + 1):
                    if path[:n] in mine and (best is None or (n + len(h), len(h)) > best[0]):
                        best = ((n + len(h), len(h)), h + path[:n], mine[path[:n]])
        assert got[k] == ((best[1], best[2]) if best else (None, "allow"))


def test_contamination_past_the_broadcast(spark, docs, texts):
    bench = [" ".join((texts[0][1] or "").split()[5:25]), " ".join((texts[36][1] or "").split()[18:40]), "One Two", "three"]
    rows = lambda n: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontaminate.contamination(docs, items(spark, bench), broadcast_rows=n).collect())
    assert rows(0) == rows(1000) and sum(x[2] for x in rows(0)) > 50


def test_remove_spans_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three", 5, 6, 7), (None, "three", 5, 6, 7)], "doc_id long, text string, _id int, _k int, _spans int")
    out = decontaminate.remove_spans(df, items(spark, ["two"]))
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["one three", "three"]
