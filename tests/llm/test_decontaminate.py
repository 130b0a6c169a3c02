import random
import re

from folio.llm.decontaminate import RUN, SHARE, UNITS, WIDTH, contaminated

ITEM = "a train leaves the station with 12 passengers and after 5 stops it holds 30 kg of mail plus 12 bags for the northern town of Oslo today"


def flagged(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, pos long")
    got = contaminated(docs, spark.createDataFrame(list(items), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_templates_and_slots(spark):
    filler = "quite different words come before and after the passage in this text "
    other = ITEM.replace("12", "77").replace("5 stops", "9 stops").replace("30 kg", "8 lb").replace("Oslo", "Rome")
    odd = ITEM.replace("12 passengers", "77 passengers").replace("12 bags", "41 bags")  # 12 stands for two values
    got = flagged(spark, [filler + ITEM, filler + other + " " + filler, filler * 4, None, "", odd, ITEM[:60]])
    assert set(got) == {(0, 1), (1, 1)}
    assert got[1, 1].n_changed == 6  # 12 twice, 5, 30, kg and Oslo
    assert got[0, 1].n_changed == 0


def test_empty_tables_and_nulls(spark):
    assert not flagged(spark, [None, "", "x"])
    assert not flagged(spark, [ITEM], items=[(1, None), (None, ITEM), (2, "too short")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1] and got[0].n_matched == got[0].n_windows


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    items = [" ".join(word() for _ in range(14)) for _ in range(5)]
    docs = []
    for i in range(60):
        ws = [word() for _ in range(30)]
        if i % 3 == 0:
            it = items[i % 5].split()
            cut = rng.randint(6, 14)
            ws[5:5] = it[:cut]
        docs.append(" ".join(ws))

    def windows(t):
        ws = re.findall(r"\w+", t.lower())
        return [tuple(ws[k : k + WIDTH]) for k in range(len(ws) - WIDTH + 1)]

    want = {}
    for i, t in enumerate(docs):
        for j, it in enumerate(items):
            ds, iw = windows(t), windows(it)
            diag = {}
            for p, w in enumerate(iw):
                for q, x in enumerate(ds):
                    if w == x:
                        diag.setdefault(q - p, set()).add(p)
            hit = set().union(*diag.values()) if diag else set()

            def stretch(s):
                best = run = 0
                for p in range(len(iw)):
                    run = run + 1 if p in s else 0
                    best = max(best, run)
                return best

            longest = max(map(stretch, diag.values()), default=0)
            if len(hit) >= SHARE * len(iw) and hit or longest >= RUN:
                want[i, j] = (len(hit), longest)
    got = flagged(spark, docs, list(enumerate(items)))
    assert {k: (r.n_matched, r.longest) for k, r in got.items()} == want


def test_copies_in_other_case(spark):
    names = "the famous painter Anna Berg met Carl Dahl and Eva Falk near Gent before Hugo Ibsen left the small town for good"
    people = "a Mr Kim, Mr Lee, Mr Moe, Mr Nye, Mr Orr, Mr Poe, Mr Ray"
    texts = [ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.upper().replace("12", "77"), names.lower(), names.upper(), people.lower(), "other words " * 20]
    got = flagged(spark, texts, [(1, ITEM), (2, names), (3, people)])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)}
    assert all(r.n_matched == r.n_windows for r in got.values())


def test_inconsistent_slots_leave_the_rest(spark):
    verbatim = "12 apples cost as much as 12 pears if the old farmer who sells them on the market square beside the town hall is in a good mood"
    table = "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9"
    merged = ITEM.replace("12", "7").replace("5 stops", "7 stops")
    odd = verbatim.replace("12 apples", "77 apples").replace("12 pears", "41 pears")
    shape = ITEM.replace("12 passengers", "77 passengers").replace("12 bags", "41 bags").replace("town", "place")
    got = flagged(spark, [merged, odd, "so " + table + " they say", table.replace("5", "6"), shape], [(1, ITEM), (2, verbatim), (3, table)])
    assert set(got) == {(0, 1), (1, 2), (2, 3)}
    assert got[0, 1].n_changed == 3 and got[0, 1].n_matched == got[0, 1].n_windows
    assert got[1, 2].n_changed == 0 and got[1, 2].longest >= RUN
    assert got[2, 3].n_matched == got[2, 3].n_windows == 11


# --- brute force: every window of every text against every window of every item, in plain Python -----------------------

NUMBER, PERSON, MEASURE = "N", "P", "M"


def typed_tokens(t):
    """(kind, value) of each token, by one walk over the words of the text."""
    t = "".join(" " if c in "\x01\x02\x03" else c for c in t or "")
    out, named = [], set()
    for m in re.finditer(r"(?<=[^\W\dA-ZÄÖÜ_] )(?=[A-ZÄÖÜ])|(?<=[\d,;] )(?=[A-ZÄÖÜ])", t):
        named.add(m.end())
    units = set(UNITS.split())
    last_end = None
    for m in re.finditer(r"\d+(?:[.,:](?=\d)\d+)*|[^\W_]+", t):
        word, kind = m[0], "W"
        if word[0].isdigit() and not (m.start() and (t[m.start() - 1].isalnum())):
            digits = re.match(r"\d+(?:[.,:]\d+)*", word)[0]
            out.append((NUMBER, re.sub("[.,:]", "·", digits)))
            last_end = m.end()
            continue
        if last_end is not None and t[last_end : m.start()].strip() == "" and word.lower() in units:
            kind = MEASURE
        elif m.start() in named:
            kind = PERSON
        out.append((kind, word.lower()))
        last_end = None
    return out


def forms(w):
    """The ways in which a window is compared: what is equal, and its slots as (place, value)."""
    special = [(i, v) for i, (k, v) in enumerate(w) if k != "W"]
    bare = [(i, v) for i, (k, v) in enumerate(w) if k in (NUMBER, MEASURE)]
    word = lambda k, v: v if k == "W" else k + "!"
    out = [("typed", tuple(word(k, v) for k, v in w), special)]
    if any(k == PERSON for k, _ in w):
        out.append(("cased", tuple(v if k == PERSON else word(k, v) for k, v in w), bare))
    if len(bare) >= WIDTH - 1:
        out.append(("values", tuple((k if k in (NUMBER, MEASURE) else "", v) for k, v in w), bare))
    return out


def brute(docs, items):
    found = {}
    cut = lambda ts: [ts[k : k + WIDTH] for k in range(len(ts) - WIDTH + 1)]
    for d, dt in docs:
        windows = [forms(w) for w in cut(typed_tokens(dt))]
        for i, it in items:
            mine = [[f for f in forms(w) if f[0] == "values" or len(f[2]) <= WIDTH - 2] for w in cut(typed_tokens(it))]
            places = [p for p, f in enumerate(mine) if f]
            typed = {p for p, f in enumerate(mine) if any(x[0] == "typed" for x in f)}
            diagonals = {}
            for p, fs in enumerate(mine):
                for q, gs in enumerate(windows):
                    for _, same, a in fs:
                        for _, other, b in gs:
                            if same == other:
                                diagonals.setdefault(q - p, []).append((p, tuple((x, y) for (_, x), (_, y) in zip(a, b)), tuple(p + at for at, _ in a)))
            at_fit, at_typed, at_all, longest = set(), set(), set(), 0
            for hits in diagonals.values():
                moved = {(x, y) for _, pairs, _ in hits if any(x != y for x, y in pairs) for x, y in pairs}
                fits = len(moved) == len({x for x, _ in moved})
                at = {p for p, pairs, _ in hits if fits or all(x == y for x, y in pairs)}
                if fits:
                    at_fit |= {p for p, _, _ in hits}
                    at_typed |= {p for p, _, _ in hits if p in typed}
                at_all |= at
                run = 0
                for p in range(len(mine)):
                    run = run + 1 if p in at else 0
                    longest = max(longest, run)
            if at_all and (len(at_fit) >= SHARE * len(places) or (typed and len(at_typed) >= SHARE * len(typed)) or longest >= RUN):
                found[d, i] = (len(places), len(at_all), longest)
    return found


def test_against_brute_force_with_numbers_names_and_units(spark):
    rng = random.Random(21)
    words, names, units = "alpha beta gamma delta zeta eta theta iota kappa".split(), "Anna Berg Carl Dahl Eva".split(), "kg cm days percent".split()

    def piece():
        x = rng.random()
        if x < 0.2:
            return f"{rng.choice((3, 12, 40, '1,500', '2.5'))}" + (f" {rng.choice(units)}" if rng.random() < 0.5 else "")
        return rng.choice(names) if x < 0.35 else rng.choice(words) + (", " if x > 0.95 else "")

    items = [(k, " ".join(piece() for _ in range(rng.randint(10, 22)))) for k in range(8)]
    docs = []
    for k in range(120):
        t = " ".join(piece() for _ in range(rng.randint(3, 25)))
        item = items[k % 8][1]
        if k % 2:
            for old, new in rng.sample([("12", "77"), ("40", "8"), ("kg", "lb"), ("Anna", "Otto"), ("Berg", "Holm"), ("days", "weeks"), ("3", "4")], rng.randint(0, 4)):
                item = item.replace(old, new, rng.choice((-1, -1, 1)))
            item = rng.choice((item, item, item.upper(), item.lower()))
            t = t + " " + item[: rng.randint(len(item) // 2, len(item))] + " " + t[: rng.randint(0, len(t))]
        docs.append((k, t))
    got = flagged(spark, [t for _, t in docs], items)
    want = brute(docs, items)
    assert {k: (r.n_windows, r.n_matched, r.longest) for k, r in got.items()} == want and len(want) > 20


def test_short_items_and_salted_joins(spark, monkeypatch):
    items = [(1, "Who wrote it?"), (2, "12 kg"), (3, ITEM)]
    texts = ["who wrote it", "Who wrote it? Nobody knows", "12 KG!", "13 kg", "so " + ITEM, "", None]
    want = {(0, 1), (2, 2), (4, 3)}
    assert set(flagged(spark, texts, items)) == want
    monkeypatch.setattr("folio.llm.decontaminate.BROADCAST", 0)
    assert set(flagged(spark, texts, items)) == want
