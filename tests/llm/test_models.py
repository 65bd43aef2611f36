import random
import re
from collections import Counter

from lumenmatch.llm import language, quality_classifier, secrets

from .conftest import SCHEMA, rows_of, sentence

SAMPLES = {
    "aa": ["the", "and", "with", "from", "house", "river", "which", "there", "would", "through"],
    "bb": ["der", "und", "nicht", "schön", "straße", "über", "zwischen", "haus", "fluß", "werden"],
    "cc": ["que", "los", "niño", "calle", "donde", "río", "ción", "mañana", "también", "hacia"],
}


def prose(r, lang, n):
    return " ".join(r.choice(SAMPLES[lang]) for _ in range(n))


def test_language_on_held_out_texts(spark, empty):
    r = random.Random(1)
    rows = [(k, prose(r, lang, r.randint(5, 60)), lang) for k, lang in enumerate(list(SAMPLES) * 60)]
    odd = [(900, None, "aa"), (901, "12 --- 34", "bb"), (902, "", None), (903, prose(r, "aa", 20000), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    held = language.held_out(df["doc_id"])
    learned = language.profiles(df.where(~held))
    assert set(learned) == set(SAMPLES)
    got = {x.doc_id: x for x in language.identify(df, learned).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    assert language.profiles(empty) == {} and language.identify(empty, {}).count() == 0


def brute_ranking(text, size):
    """The most frequent 1- to 3-grams of the padded words, ties by code points from the last character on."""
    cut = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = f" {' '.join(cut)} " if cut else ""
    grams = Counter(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1))
    del grams[" "]
    return sorted(grams, key=lambda g: (-grams[g], [0] * (3 - len(g)) + [ord(c) for c in reversed(g)]))[:size]


def test_rankings_profiles_and_predictions_equal_brute_force(spark):
    r = random.Random(12)
    size = language.PROFILE
    marks = lambda t: "".join(r.choice([c, c, c, c.upper(), c + "! 7", ". " + c]) for c in t)
    rows = [(k, marks(prose(r, lang, r.randint(3, 40))), lang) for k, lang in enumerate(list(SAMPLES) * 12)]
    rows += [*rows[:3], (None, "the river und", None), (None, "aaa", "aa"), (80, "ab ba ab", None), (81, "  ...the", "bb"), (82, "the..", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    plain = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    for _, text, _ in rows:
        assert language.ranking(text).tolist() == [plain(g) for g in brute_ranking(text, size)]
    known = {}
    for lang in SAMPLES:
        total = Counter()
        for _, text, g in rows:
            if g == lang:
                cut = "".join(c if c.isalpha() else " " for c in text.lower()).split()
                padded = f" {' '.join(cut)} "
                total.update(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1))
        del total[" "]
        known[lang] = sorted(total, key=lambda g: (-total[g], plain(g)))[:size]
    learned = language.profiles(df)
    assert {k: v.tolist() for k, v in learned.items()} == {k: [plain(g) for g in v] for k, v in known.items()}
    want = []
    for i, text, _ in rows:
        mine = brute_ranking(text, size)
        far = {g: sum(abs(p.index(x) - k) if x in p else size for k, x in enumerate(mine)) for g, p in known.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, best, round(1 - far[best] / (size * len(mine)), 9)))
    got = [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in language.identify(df, learned).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def planted(r, k):
    tail = "".join(r.choice("0123456789abcdef") for _ in range(40))
    return [f'token = "{tail}"', f"password={tail[:18]}", f"AKIA{tail[:16].upper()}", tail[:30], f"API_KEY: {tail}"][k % 5]


def test_base_spans_equal_the_patterns_and_are_redacted(spark, empty):
    r = random.Random(3)
    rows = [(k, f"{sentence(r, 12)} {planted(r, k) if k % 2 else ''} {sentence(r, 12)}é日本") for k in range(200)]
    rows += [(500, None), (501, ""), (502, "password=ab token:abcdef"), (503, "PASSWORD = 'x_y-z.9'"), (504, "AKIA123")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = {x.doc_id: x.spans for x in secrets.find_secrets(df).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for i, t in rows:
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        assert sorted((s.kind, s.start, s.end) for s in got[i] if s.kind != "model") == sorted(want)
    out = secrets.redact(df)
    assert out.columns == df.columns
    for x in out.collect():
        before = dict(rows)[x.doc_id]
        if not got[x.doc_id]:
            assert x.text == before
        else:
            assert "[SECRET]" in x.text and not any(before[s.start : s.end] in x.text for s in got[x.doc_id])
    assert secrets.find_secrets(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_network_learns_held_out_findings():
    r = random.Random(4)
    good = ["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    plain = [sentence(r, 1) * 4 for _ in range(300)]
    x = secrets.Pieces(["key is "] * 600, good + plain, [" and"] * 600)
    y = [1.0] * 300 + [0.0] * 300
    import numpy as np

    y = np.array(y)
    held = np.arange(600) % 3 == 0
    net = secrets.Network()
    test = x.take(np.flatnonzero(held))
    net.fit(x.take(np.flatnonzero(~held)), y[~held])
    net.calibrate(test, y[held])
    p = net.probability(test)
    assert (p[y[held] == 1] >= net.threshold).mean() >= secrets.RECALL - 0.02
    assert (p[y[held] == 0] >= net.threshold).mean() <= 0.02


def other_secret(r, k):
    some = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(a) for _ in range(n))
    return [f"ghp_{some(36)}", f"eyJ{some(17)}.{some(40)}.{some(30)}", some(44)][k % 3]


def test_secrets_of_other_kinds_are_added_and_mail_is_not(spark):
    r = random.Random(9)
    rows, kind = [], {}
    for k in range(480):
        kind[k] = ("base", "other", "mail", "plain")[k % 4]
        word = {"base": planted(r, k // 4), "other": other_secret(r, k // 4), "mail": f"{sentence(r, 1)}{sentence(r, 1)}.{k}@mail{k % 9}.example.com", "plain": ""}
        rows.append((k, f"{sentence(r, 12)} {word[kind[k]]} {sentence(r, 12)}"))
    got = {x.doc_id: x.spans for x in secrets.find_secrets(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    share = lambda name: sum(any(s.kind == "model" for s in got[k]) for k in got if kind[k] == name) / 120
    assert share("other") >= 0.9 and share("mail") <= 0.05 and share("plain") <= 0.02


def test_held_out_secrets_that_no_pattern_and_no_keyword_tells(spark):
    """The model of one corpus on another: tokens of a kind that nothing labels, and ordinary tokens with digits."""
    r = random.Random(21)
    some = lambda n, a: "".join(r.choice(a) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda: some(r.choice((20, 32, 40)), alnum)
    plain = lambda k: [f"{sentence(r, 1)}.{k}@mail.example.com", f"www.{sentence(r, 1)}{k % 7}.example.com", f"20{k % 30:02d}-0{k % 9 + 1}-11", f"chapter{k % 50}", f"{sentence(r, 1)}-{sentence(r, 1)}-{sentence(r, 1)}"][k % 5]
    learn = [(k, f"{sentence(r, 12)} {(planted(r, k), f'token: {secret()}', plain(k))[k % 3]} {sentence(r, 12)}") for k in range(900)]
    found = secrets.find_candidates(spark.createDataFrame(rows_of(learn), SCHEMA))
    net = secrets.train(secrets.labelled(found))
    test = [(k, f"{sentence(r, 12)} {secret() if k % 2 else plain(k // 2)} {sentence(r, 12)}") for k in range(400)]
    got = {x.doc_id: x.spans for x in secrets.scan(secrets.find_candidates(spark.createDataFrame(rows_of(test), SCHEMA)), net).collect()}
    share = lambda odd: sum(any(s.kind == "model" for s in got[k]) for k in got if k % 2 == odd) / 200
    assert share(1) >= 0.9 and share(0) <= 0.1, (share(1), share(0))


def test_training_takes_the_value_of_an_assignment(spark):
    values = {1: ("password = ", "abcd1234=="), 2: ("API_KEY: '", "a=b=c1d2e3"), 3: ('token":"', "xyz.123=q")}
    docs = spark.createDataFrame([(k, f"some words {a}{v} and more") for k, (a, v) in values.items()], "doc_id long, text string")
    got = secrets.labelled(secrets.find_candidates(docs)).where("label = 1").collect()
    assert {r.value for r in got} >= {v for _, v in values.values()}
    assert all(r.before.endswith(a) for r in got for a, v in values.values() if r.value == v)


def test_metadata_is_hashed_whole():
    from lumenmatch.llm import quality_classifier

    names = ["example.com", "example.net", "example-longer.org", "example-longer.info"]
    x = quality_classifier.meta_features(names, ["en"] * 4, [10] * 4)
    assert len({r.tobytes() for r in x}) == 4


def test_of_repeated_ids_the_smallest_row_is_taken(spark):
    from lumenmatch.llm import quality_classifier

    rows = [(1, "b", None), (1, "a", 3), (2, None, 1), (1, "a", 2)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(n)
        assert sorted(map(tuple, quality_classifier._one_each(df).collect())) == [(1, "a", 2), (2, None, 1)]


def test_long_candidates_are_read_whole():
    """What tells a secret may stand anywhere in the candidate."""
    import numpy as np

    r = random.Random(2)
    body = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice((30, 90, 200))))
    value = [body() + ("ZQX7" if k % 2 else "") + body() for k in range(500)]
    x = secrets.Pieces([" is "] * 500, value, [" x"] * 500)
    y = np.array([k % 2 for k in range(500)], float)
    net = secrets.Network()
    net.fit(x.take(np.arange(350)), y[:350], epochs=12)
    z = net.logits(x.take(np.arange(350, 500)))
    assert ((z > 0) == y[350:]).mean() > 0.95
    one = secrets.Pieces(["before"], ["v" * 95], ["after"])
    assert one.rows.shape[0] == 3 and one.first.tolist() == [True, False, False] and one.last.tolist() == [False, False, True]


def test_overlaps_equal_the_plain_rule():
    r = random.Random(8)
    for _ in range(200):
        spans = sorted((a, 0, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(6)))
        taken = secrets._Taken(spans)
        for a in range(64):
            assert taken.meets(a, a + 3) == any(x < a + 3 and a < z for x, _, z in spans)


def test_threshold_keeps_the_recall_and_copies_do_not_fill_the_sample(spark):
    import numpy as np

    net, r = secrets.Network(), np.random.default_rng(1)
    y = (np.arange(400) < 200).astype(float)
    net.logits = lambda x: x
    x = r.normal(0, 1, 400) + y
    net.calibrate(x, y)
    assert (net.probability(x[y == 1]) >= net.threshold).mean() >= secrets.RECALL
    rows = [(1, "is ", "aa11bb22cc33dd44", " x")] * 500 + [(k % 2, "is ", f"{k:03d}" * 6 if k % 2 else "word" * 4 + "abc"[k % 3] * (k // 2), " x") for k in range(240)]
    assert secrets.train(spark.createDataFrame(rows, "label int, before string, value string, after string"), 100) is not None
    short = "see Xk9QzT4w and qWmZpLrTnBvXsKdJ or thing"
    assert [short[a:e] for a, _, e in secrets.candidates(short)] == ["Xk9QzT4w", "qWmZpLrTnBvXsKdJ"]


def test_the_network_learns_from_all_findings_and_its_threshold_keeps_the_recall_of_all(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = random.Random(17)
    some = lambda n, digits: "".join(r.choice("0123456789" if r.random() < digits else "abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # of one context, so that planted findings are like the others; the labels overlap
    rows = [(k % 2, "is ", some(24, 0.25 if k % 2 else 0.1), " x") for k in range(2400)]
    df = spark.createDataFrame(rows, "label int, before string, value string, after string")
    kept = {r.value for r in df.where(F.pmod(F.xxhash64("value"), F.lit(4)) == 0).collect()}
    score = lambda net, values: net.probability(secrets.Pieces(["is "] * len(values), values, [" x"] * len(values)))
    net = secrets.train(df, 100)
    held = [v for y, _, v, _ in rows if y and v in kept]
    assert (score(net, held) >= net.threshold).mean() >= secrets.RECALL
    # nothing but the threshold's own step is above the share that has to be kept
    assert (score(net, held) > net.threshold + 0.02).mean() <= secrets.RECALL
    again = secrets.train(df.unionByName(df).repartition(7), 100)
    assert np.array_equal(again.state(), net.state()) and again.threshold == net.threshold
    # few findings of a label among many shards
    rare = [(0, "is ", some(24, 0.05), " x") for _ in range(3000)] + [(1, "is ", some(24, 0.6), " x") for _ in range(120)]
    net = secrets.train(spark.createDataFrame(rare, df.schema), 800)
    assert (score(net, [some(24, 0.6) for _ in range(200)]) >= net.threshold).mean() >= 0.9
    assert (score(net, [v for y, _, v, _ in rare if not y]) >= net.threshold).mean() <= 0.05


def test_classifier_on_held_out_labels(spark, empty):
    r = random.Random(6)
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        rows.append((k, sentence(r, 60) + (" ### $$$ %%% trash idiot" * 3 if bad else ""), "en", "spam" if bad and k % 2 else "site", 300 + k, "h", 1, "p", 1))
    rows += [(900, None, None, None, None, "h", 1, "p", 1), (901, "", "en", "site", 0, "h", 1, "p", 1), (None, "trash", "en", None, 5, "h", 1, "p", 1), rows[7], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(400)] + [(5, None), (None, 1), (99999, 1), (7, 0), (7, 1)], "doc_id long, good int")
    model = quality_classifier.train(df, labels)
    got = {x.doc_id: x for x in quality_classifier.classify(df, model).collect()}
    assert len(got) == 603 and all(0 <= x.score <= 1 for x in got.values())
    test = range(400, 600)
    assert sum(got[k].kept == (k % 3 != 0) for k in test) >= 0.95 * len(test)
    assert quality_classifier.train(df, labels.limit(3)) is None
    assert quality_classifier.train(empty, labels) is None and quality_classifier.train(df, labels.limit(0)) is None
    assert all(x.kept for x in quality_classifier.classify(df, None).collect())
    assert quality_classifier.classify(empty, model).count() == 0


def test_a_round_of_cotraining_equals_a_plain_one(spark, monkeypatch):
    """Vocabulary, confident documents and both views of one round, worked out again without Spark."""
    import numpy as np
    import pyarrow as pa

    q = quality_classifier
    r = random.Random(5)
    rows = []
    for k in range(500):
        bad = r.random() < 0.4
        words = prose(r, "bb" if bad else "aa", r.randint(10, 60)) + (" junkword" if bad and r.random() < 0.8 else "")
        rows.append((k, words, "spam" if bad and r.random() < 0.9 else f"s{k % 3}", "en", len(words), int(not bad)))
    df = spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(x[0], x[5]) for x in rows[:240]], "doc_id long, good int")
    monkeypatch.setattr(q, "ROUNDS", 1)
    model = q.train(df, labels)
    held = {x.doc_id: x.h for x in spark.range(240).selectExpr("id as doc_id", "pmod(xxhash64(id, 2), 4) = 0 as h").collect()}
    fit = [x for x in rows[:240] if not held[x[0]]]
    seen = {0: Counter(), 1: Counter()}
    for x in fit:
        h, _, _ = q.text_hashes(np.frombuffer(x[1].encode(), np.uint8), np.array([0, len(x[1].encode())]))
        seen[x[5]].update(set(h.tolist()))
    n = {k: sum(x[5] == k for x in fit) for k in (0, 1)}
    gain = {h: abs(np.log((seen[0][h] + 0.5) / (n[0] + 1) / ((seen[1][h] + 0.5) / (n[1] + 1)))) for h in seen[0] | seen[1] if seen[0][h] + seen[1][h] >= 8}
    chosen = [h for h, g in gain.items() if g > 0.5]
    assert len(chosen) <= q.VOCABULARY and model.vocabulary.tolist() == sorted(chosen)
    view = lambda some: (q.text_features(pa.array([x[1] for x in some]), model.vocabulary), q.meta_features(*([x[k] for x in some] for k in (2, 3, 4))))
    y = np.array([x[5] for x in fit])
    x0 = view(fit)
    order = np.argsort([x[0] for x in fit])
    first = [q.logistic(v[order], y[order]) for v in x0]
    pool = rows[240:]
    free = view(pool)
    most = max(1, int(q.CONFIDENT * len(pool)))
    for k in (0, 1):
        p = q._sigmoid(q._apply(free[1 - k], first[1 - k]))
        low, high = [i for i in np.argsort(p, kind="stable") if p[i] < 0.05][:most], [i for i in np.argsort(-p, kind="stable") if p[i] > 0.95][:most]
        taught = [*low, *high]
        label = np.r_[np.zeros(len(low)), np.ones(len(high))]
        again = q.logistic(np.r_[x0[k][order], free[k][taught]], np.r_[y[order], label], np.r_[np.ones(len(y)), np.full(len(label), 0.3)])
        mine = (model.text, model.meta)[k]
        same = np.abs(q._apply(free[k], again) - q._apply(free[k], mine))
        assert len(taught) > 5 and np.median(same) < 0.2  # equal scores may be taken in another order
