from datascout.llm import decontamination as dc
from tests.llm.helpers import documents, saved

ITEM = "A farmer near Oslo sells 120 apples for 35 dollars and then gives Anna 12 pears while Anna walks 3 km home with the basket"
OTHER = "A farmer near Rome sells 77 apples for 9 dollars and then gives Peter 41 pears while Peter walks 8 km home with the basket"
MIXED = "A farmer near Rome sells 77 apples for 9 dollars and then gives Peter 41 pears while Maria walks 8 km home with the basket"


def run(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    path = saved(spark, documents=documents(spark, rows, extra=["item_id", "words"]), benchmark=bench)
    return sorted(((x.doc_id, x.item_id, x.kind, x.n_changed) for x in dc.op8_template_decontamination(spark, path).collect()), key=str)


def test_copies_other_values_and_inconsistent_ones(spark):
    pad = "some words of prose that come before, "
    rows = [
        (1, pad + ITEM + " and after."), (2, pad + OTHER + "."), (3, pad + MIXED), (4, pad * 9), (5, None), (6, ""), (7, ITEM.replace(" ", "\n ").upper()),
        (8, ITEM.lower().replace("apples for", "red apples, for")), (1, "nothing at all"), (None, ITEM), (9, ITEM), (9, ITEM),
    ]
    got = run(spark, rows, [(10, ITEM), (11, None), (12, ""), (13, "12 13 14"), (None, "these are eight plain words in one row")])
    assert [g for g in got if g[2] == "copy" and g[0] in (1, 9, None)] == sorted([(1, 10, "copy", 0), (9, 10, "copy", 0), (None, 10, "copy", 0)], key=str)
    assert [g[3] for g in got if g[0] == 2] == [6] and (2, 10) == [g[:2] for g in got if g[2] != "copy" and g[0] == 2][0]
    assert not [g for g in got if g[0] in (3, 4, 5, 6)]


def test_short_items_and_tables_without_rows(spark):
    rows = [(1, "So it is! The quick brown fox jumps. And more"), (2, "quick the brown fox jumps"), (3, "one line\nthe QUICK brown fox jumps\nanother"), (4, "x the quick brown fox jumps y")]
    assert run(spark, rows, [(1, "The quick brown fox jumps.")]) == [(1, 1, "copy", 0), (3, 1, "copy", 0)]
    assert run(spark, [], [(1, ITEM)]) == [] and run(spark, [(1, ITEM)], []) == []


def brute(docs, items):
    """leaks() in plain Python: {(doc_id, item_id): (n_covered, n_own, n_slots, n_changed)} for rows of distinct ids."""
    import regex

    slot, spaces = regex.compile("[\ue000-\ue002]"), regex.compile(r"[\x20\x09-\x0D]+")

    def raw_of(t):
        return spaces.sub(" ", t or "").strip(" ").split(" ")

    def template(raw):
        x = regex.sub("[\ue000-\ue002]", "", " ".join(raw))
        x = regex.sub(r"(?<=[\p{L}\p{N},;:] )\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])", "\ue000", x)
        x = regex.sub(r"\p{Nd}(?:[\p{Nd}.,:/]*\p{Nd})?", "\ue001", x).lower()
        x = regex.sub(rf"(?<![\p{{L}}\p{{M}}])(?:{dc.NUMBER_WORDS})(?![\p{{L}}\p{{M}}])", "\ue001", x)
        x = regex.sub(rf"(?<=\ue001 ?)(?:{dc.UNITS})(?![\p{{L}}\p{{M}}])", "\ue002", x)
        return regex.sub(r"[^\p{L}\p{M}\p{N}\ue000-\ue002 ]+", "", x).split(" ")

    def plain(raw):
        return regex.sub(r"[^\p{L}\p{M}\p{N} ]+", "", " ".join(raw).lower()).split(" ")

    bare = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower()
    out = {}

    def judge(doc, item, pairs, covered, own):
        values = {(bare(ir), bare(r)) for (iw, ir), (w, r) in pairs if slot.search(iw) and slot.search(w)}
        if len(values) == len({i for i, _ in values}):
            got = (covered, -sum(i != d for i, d in values), len(values), own)
            out[doc, item] = max(out.get((doc, item), got), got)

    for form, least in ((template, 3), (plain, 0)):
        words_of = lambda t: [(w, r) for w, r in zip(form(raw_of(t)), raw_of(t)) if w]  # noqa: E731, B023
        long, short = {}, {}
        for item, text in items:
            words = words_of(text)
            line = tuple(w for w, _ in words)
            if len(line) >= 8:
                long.setdefault(line, []).append((item, words))
            elif line and sum(not slot.search(w) for w in line) >= least:
                short.setdefault(line, []).append((item, words))
        usable = {line: {k: line[k : k + 5] for k in range(len(line) - 4) if sum(not slot.search(w) for w in line[k : k + 5]) >= 2} for line in long}
        holders = {}
        for line, ws in usable.items():
            for w in ws.values():
                holders.setdefault(w, set()).add(line)
        own = {line: ({k: w for k, w in ws.items() if len(holders[w]) == 1} or ws) for line, ws in usable.items()}
        index = {}
        for line, ws in own.items():
            for k, w in ws.items():
                index.setdefault(w, []).append((line, k))
        for doc, text in docs:
            words, runs = words_of(text), {}
            for at in range(len(words) - 4):
                for line, k in index.get(tuple(w for w, _ in words[at : at + 5]), ()):
                    for run in ((at - k) // 16, (at - k) // 16 - 1):
                        runs.setdefault((line, run), set()).add((k, at))
            for (line, _), hits in runs.items():
                covered = len({k + d for k, _ in hits for d in range(5)})
                n_own = len({k + d for k in own[line] for d in range(5)})
                if covered < max(-(-6 * n_own // 10), min(8, n_own)):
                    continue
                offsets = [at - k for k, at in hits]
                main = max(set(offsets), key=lambda o: (offsets.count(o), o))
                places = {}
                for k, at in hits:
                    for d in range(5):
                        places.setdefault(k + d, []).append((abs(at - k - main), at + d))
                for item, theirs in long[line]:
                    judge(doc, item, [(theirs[i], words[min(ps)[1]]) for i, ps in places.items()] if form is template else [], covered, n_own)
            for part in [*regex.split(r"[\n\r]+", text or ""), *regex.split(r"[.!?]+(?=[\x20\x09-\x0D]|$)|[\n\r]+", text or "")]:
                mine = words_of(part)
                for item, theirs in short.get(tuple(w for w, _ in mine), ()):
                    judge(doc, item, list(zip(theirs, mine)), len(mine), len(mine))
    return {k: (w, n, s, -c) for k, (w, c, s, n) in out.items()}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(1000, "What is 12 plus 7 times 3 minus 4?"), (1001, "Compute 12 plus 7 times 3"), (1002, ITEM)]
    docs += [(10_000 + i, t) for i, t in enumerate(["so: what is 12 plus 7 times 3 minus 4", "what is 12 plus 8 times 3 minus 4", "COMPUTE 12 PLUS 7 TIMES 3", OTHER, MIXED, ITEM.upper(), OTHER.lower(), ITEM.replace("120", "nine"), ITEM.replace("3 km", "three miles"), None, ""])]
    docs += [(20_000 + i, t.lower()) for i, (_, t) in enumerate(items)] + [(30_000 + i, "before it " + " ".join(t.split()[2:-2])) for i, (_, t) in enumerate(items)]
    path = saved(spark, documents=documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    rows = dc.op8_template_decontamination(spark, path).collect()
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_own, r.n_slots, r.n_changed) for r in rows}
    want = brute(docs, items)
    assert got == want and len(rows) == len(want) and len({k for k, v in want.items() if v[3]}) >= 2
    assert all((r.kind == "copy") == (r.n_changed == 0) for r in rows)
    assert {(10_000, 1000), (10_002, 1001), (10_003, 1002), (10_005, 1002), (10_007, 1002), (10_008, 1002)} <= want.keys() and (10_004, 1002) not in want
    assert all((20_000 + i, item) in want for i, (item, _) in enumerate(items))


INSTRUCTION = "Choose the best answer to the following question and write down the letter only"
SLOTS = "Anna buys 4 pears from Peter for 3 euros and Tom 5 figs for 2 euros"


def test_clean_texts_stay_and_changed_copies_go(spark):
    items = [(1, "Yes"), (2, f"{INSTRUCTION}: which river runs through the old town of Ulm in spring?"), (3, f"{INSTRUCTION}: why do red foxes sleep in the open so often?"), (4, f"{INSTRUCTION}: what makes a good loaf of dark bread rise so slowly?")]
    items += [(5, "Compute 12 plus 7 times 3"), (6, SLOTS), (7, "A tall grey heron stood quite still beside the mill pond until dusk came"), (8, "12 13 14"), (9, "Name the capital of France")]
    clean = ["yes we can, said yes men, and yes again", f"{INSTRUCTION}. Thank you.", "Sums like 3 plus 4 are easy\n1 2 3\n7 8 9", "the capital of France is where they name the streets", "A tall grey heron flew by. It stood quite still. Dusk came late.", "Peter buys 3 apples from Tom for 2 euros and leaves"]
    bad = ["Is it so? Yes. It is", "red foxes: why do red foxes sleep in the open so often, asks the paper", "Compute 15 plus 2 times 9", "Lisa buys 9 pears from Karl for 6 euros and Max 8 figs for 7 euros", "a tall grey heron stood quite still right beside the mill pond until dusk came", "A tall grey heron stood quite still beside the old mill pond until dusk came", SLOTS.upper(), "x\n12 13 14\ny", "Name the capital of France!"]
    bad += [f"{INSTRUCTION}: which river runs through the old town of Ulm in spring?", "Well: compute 15 plus 2 times 9. Done", "before it Anna buys 4 pears from Peter for 3 euros and also Tom 5 figs for 2 euros after it"]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(bad)]
    got = run(spark, rows, items)
    assert not {d for d, *_ in got} & set(range(len(clean)))
    want = {(100, 1), (101, 3), (102, 5), (103, 6), (104, 7), (105, 7), (106, 6), (107, 8), (108, 9), (109, 2), (111, 6)}
    assert {(d, i) for d, i, *_ in got} - {(110, 5)} == want
    docs = documents(spark, rows)
    kept = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} >= set(range(len(clean)))
    pairs = {(d, i): n for d, i, _, n in got}
    assert pairs[102, 5] == 3 and pairs[103, 6] >= 6 and pairs[109, 2] == 0


def test_pipeline_form_keeps_all_others(spark):
    docs = documents(spark, [(1, ITEM), (2, "clean text"), (3, None), (None, "clean")], extra=["rid", "item_id", "`a.b`", "__leak"])
    kept = dc.decontaminate(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "None"]


def test_texts_of_other_rows_are_not_shuffled(spark):
    """Rows without a run met the runs' rows by a shuffle of all texts, once their ids were over the session's broadcast limit."""
    docs = documents(spark, [(i, ITEM if i % 7 == 0 else f"clean text {i}") for i in range(100)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
        found, kept = dc.leaks(docs, bench), dc.decontaminate(docs, bench)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, kept)]
        assert found.count() == 15 and kept.count() == 85
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for plan, kind in zip(plans, ("LeftSemi", "LeftAnti")):
        joins = [line for line in plan.split("\n") if kind in line]
        assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_windows_around_anchors_are_all_windows(spark, monkeypatch):
    items = [(1, ITEM), (2, OTHER.replace("Rome", "the the")), (3, "so so so so so so so so so so"), (4, "é 的 ß ab cd ef gh ij kl mn ab cd ef gh"), (5, SLOTS)]
    texts = [t for _, t in items] + [" ".join(t.split()[k:] + ["so"] * k) for _, t in items for k in (1, 4, 9)] + ["", "so so so so", "ab cd ef", "so " * 30, None]
    docs = documents(spark, list(enumerate(texts)))
    rows = docs.select("doc_id", dc.F.col("doc_id").alias("rid"), dc.joined(dc.template(dc.spaced(dc.F.col("text")))).alias("line"))
    held = dc.own_windows(dc.item_lines(spark.createDataFrame(items, "item_id long, text string"), dc.template)).localCheckpoint()
    got = [sorted(map(tuple, dc._hits(rows, held).select("doc_id", "rid", "at", "key", "spot", "own").collect()))]
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    got.append(sorted(map(tuple, dc._hits(rows, held).select("doc_id", "rid", "at", "key", "spot", "own").collect())))
    assert got[0] == got[1] and len(got[0]) > 200 and len(set(got[0])) == len(got[0])
