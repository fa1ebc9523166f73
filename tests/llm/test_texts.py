import math
import random
import re
import unicodedata

import brute
import numpy as np

from sparksymbols.llm import decontamination, licenses, mixing, quality, token_counts, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, item_id string, label int, size string"


def table(spark, rows):
    """Documents ``(id, text, source)`` with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, "x", 1, "y") for i, t, s in rows], DOCS)


def test_warc(spark):
    pages = [(1, "same"), (4, "same"), (2, "same"), (3, None), (5, ""), (None, "same"), (None, "own"), (9, "é" * 5000), (7, "é" * 5000), (8, "a\r\n\r\nWARC/1.0\r\n")]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nx", h, "k") for i, h in pages], "page_id bigint, url string, html string, digest string")
    got = warc.archive_round_trip(spark, df).collect()
    assert all(r["intact"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute.archive(pages), key=str)
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0


def test_warc_chunks(spark, tmp_path):
    """Records larger than a chunk, sections of a few records; the chunks give the payload back, digests grow with them."""
    pages = [(i, "".join(random.Random(i).choices("abc\r\n é", k=i * 137))) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id bigint, payload string").selectExpr("*", "'u' AS url")
    sections = warc.write_archives(warc.roles(df), str(tmp_path), chunk_bytes=64, section_bytes=200)
    assert sections.count() > 2
    chunks = warc.read_archives(sections, chunk_bytes=50).collect()
    assert max(len(c["data"]) for c in chunks) == 50
    for i, html in pages:
        own = sorted((c for c in chunks if c["record"] == str(i)), key=lambda c: c["chunk_no"])
        assert b"".join(c["data"] for c in own).decode() == html and own[-1]["last"]
        assert own[-1]["digest_so_far"] == own[-1]["stated_digest"]


def test_warc_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id int, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark, df, least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_licenses(spark):
    isc = next(t for i, t in licenses.KNOWN if i == "ISC")
    british = isc.replace("\n\n", "\nCopyright (c) 2020 Somebody\n").replace("software", "SOFTWARE,").replace(" ", "  ")
    docs = [(1, "Copyright 1999 Me\n" + british, "s"), (2, "text\n  Licensed under the MIT Licence!\nmore\nlicensed under the mit license", "s"),
            (3, None, "s"), (4, "", "s"), (5, "Licensed under the MIT License, not", "s"), (6, "Released under the MIT License.", "s"), (7, "漢字 released under the MIT License", "s")]
    got = sorted(tuple(r) for r in licenses.license_scan(table(spark, docs), licenses.known_licenses(spark)).collect())
    assert got == [(1, "document", "ISC", 1), (2, "line", "MIT", 2), (6, "document", "MIT", 1), (6, "line", "MIT", 1)]
    none = spark.createDataFrame([("A", None), ("B", "..."), (None, "x")], "license_id string, text string")
    assert licenses.license_scan(table(spark, docs), none).count() == 0


def test_licence_files(spark):
    """Whole texts as files have them: with and without title, years and holders, wrapped at any width, as comments."""
    import textwrap

    assert len(licenses.KNOWN) >= 40 and len({i for i, t in licenses._WHOLE}) == 9
    docs, want = [], set()
    titles = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense", "BSL-1.0": "Boost Software License - Version 1.0"}
    for n, (name, text) in enumerate(licenses.KNOWN):
        if "\n" not in text:
            continue
        for k, width in enumerate((30, 41, 72, 79, 200)):
            body = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            top = ["", f"{titles.get(name, '')}\n\n", "Copyright (c) 2021 Someone\n\n", "Copyright 1999-2020, Some Body.\nAll rights reserved.\n\n", f"{titles.get(name, '')}\n\nCopyright © <year> A\n"][k]
            docs.append((100 * n + k, top + (textwrap.indent(body, " * ", lambda line: True) if k == 2 else body), "s"))
            want.add((100 * n + k, name))
    docs += [(90_001, docs[0][1] + "\nand more", "s"), (90_002, "MIT License", "s"), (90_003, "Copyright holders be liable\nfor nothing", "s")]
    got = {(r["doc_id"], r["license_id"]) for r in licenses.license_scan(table(spark, docs), licenses.known_licenses(spark)).where("scope = 'document'").collect()}
    assert got == want


QUESTION = "A farmer called Anna sells 12 baskets and Anna keeps 7 of them for 3 hours while the rest go to market quickly"


def test_contaminated_against_plain_loops(spark):
    """Random passages of words, numbers, names and units, copied with some values changed, against the plain rule."""
    rng = random.Random(12)
    words = [a + b for a in "ka lo mi ne ru".split() for b in "na pe ri".split()]

    def passage(n, odd):
        out = []
        while len(out) < n:
            kind = rng.choices(["w", "n", "a", "u"], [1 - odd, odd / 2, odd / 4, odd / 4])[0]
            out += {"w": [rng.choice(words)], "n": [str(rng.randrange(4))], "a": ["on", rng.choice(["Anna", "Bert", "Carl"])], "u": [str(rng.randrange(3)), rng.choice(["km", "kg"])]}[kind]
        return out

    def changed(tokens, share):
        swap = lambda t: rng.choice(["Anna", "Bert", "Dora"]) if t[0].isupper() else str(rng.randrange(9)) if t.isdigit() else t
        return [swap(t) if rng.random() < share else t for t in tokens]

    items = [(i, passage(rng.choice([3, 9, 10, 14, 25]), rng.choice([0.0, 0.2, 0.6]))) for i in range(40)]
    docs = []
    for i in range(160):
        _, tokens = rng.choice(items)
        start = rng.randrange(max(1, len(tokens) - 9))
        part = changed(tokens[start : start + rng.choice([8, 12, 30])], rng.choice([0, 0.1, 0.5]))
        docs.append((i, " ".join(passage(rng.randrange(8), 0.3) + part + passage(rng.randrange(8), 0.3)), "s"))
    items = [(i, " ".join(tokens)) for i, tokens in items]
    want = brute.contaminated([(i, t) for i, t, _ in docs], items, decontamination.UNITS)
    got = decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and 40 < len(want) < 6000


def test_contaminated(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "only five words in here"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id int, text string")
    swapped = QUESTION.replace("Anna", "Maria").replace("12", "1,250").replace("hours", "minutes")
    clash = swapped.replace("Maria keeps", "Peter keeps")  # one name stands for two
    docs = [(1, f"Before it. {QUESTION.upper()}!! After", "s"), (2, f"x\n{swapped}\ny", "s"), (3, f"x\n{clash}", "s"), (4, "so ONLY five, words in here. yes", "s"),
            (5, "21 22 23 24 25 26 27 28 29 30 31 32", "s"), (6, None, "s"), (7, "", "s"), (8, "a farmer called nobody", "s"), (None, QUESTION, "s")]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(table(spark, docs), items).collect()}
    assert (1, 1) in got and (2, 1) in got and got[2, 1] is False and (4, 2) in got and (None, 1) in got
    assert not {d for d, _ in got} & {5, 6, 7, 8}
    assert (3, 1) not in got
    stay = decontamination.drop_contaminated(table(spark, docs), items)
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == [3, 5, 6, 7, 8, None]
    assert decontamination.contaminated(table(spark, docs), items.limit(0)).count() == 0
    assert decontamination.contaminated(table(spark, []), items).count() == 0


def test_contaminated_with_some_values_changed(spark):
    """A value that changes in one place hides neither the windows that stay the same nor a question with new numbers."""
    boxes = "Tom packs 3 boxes with 3 apples each before lunch and then sells 8 of them at the old market"
    items = spark.createDataFrame([(1, QUESTION), (2, boxes), (3, "so 3 boxes with 3 apples")], "item_id int, text string")
    long = "and when the river had risen over the lower fields they moved the sheep to the barn on the hill"
    items = items.union(spark.createDataFrame([(4, f"It was 3 days that Anna stayed {long} for 3 more with Anna there")], items.schema))
    docs = [(1, f"x\nIt was 3 days that Anna stayed {long} for 4 more with Anna there", "s"),
            (2, f"x\nIt was 3 days that Anna stayed {long} for 3 more with Peter there", "s"),
            (3, "x\n" + boxes.replace("3 boxes", "4 boxes").replace("3 apples", "5 apples"), "s"),
            (4, "x\n" + boxes.replace("3", "8"), "s"), (5, "so 4 boxes with 5 apples", "s"),
            (6, QUESTION.replace("Anna", "Maria").replace("Maria keeps", "Peter keeps").replace("12", "5").replace("hours", "days"), "s")]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(table(spark, docs), items).collect()}
    assert got == {(1, 4): False, (2, 4): True, (3, 2): False, (4, 2): False, (5, 3): False}


def test_contaminated_items_made_of_values(spark):
    """Windows of more than half numbers, units and names are found where they are copied, and only there."""
    series = "Continue 1 2 3 5 8 13 21 34 55 89 144 233"
    people = "Anna, Berta, Carla, Dora, Emma, Frida, Greta, Hanna, Ida, Jana, Klara and Lena"
    items = [(1, "12 + 30 = 42"), (2, series), (3, people), (4, "Anna, Berta, Carla"), (5, "It took 5 km and 3 kg")]
    items = spark.createDataFrame(items, "item_id int, text string")
    docs = [(1, "we know that 12 + 30 = 42, so", "s"), (2, "we know that 12 + 30 = 43, so", "s"), (3, f"x\n{series}\ny", "s"),
            (4, f"x\n{series.replace('34 55', '35 56')}", "s"), (5, f"there were {people}", "s"), (6, people.replace("Emma", "Elsa").replace("Carla", "Clara"), "s"),
            (7, f"{people.upper()} 12", "s"), (8, "then It took 5 km and 3 kg", "s"), (9, "x " + " ".join(f"{i} 7" for i in range(400)), "s")]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(table(spark, docs), items).collect()}
    assert got == dict.fromkeys([(1, 1), (3, 2), (5, 3), (5, 4), (7, 3), (7, 4), (8, 5)], True)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["a", "b", "b", "c", "é", None, "z"])) for i in range(400)]
    rows += [(900, None, "a"), (901, " \t", "empty"), (None, "one two", "b"), (5, "twice here", "z"), (5, "twice here", "z")]
    got = mixing.mix_sources(table(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute.mixture_targets(sizes)
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], round(r["target"], 6)), [0])[0] += r["taken"]
    want = {}
    for s in sizes:
        want[sizes[s], round(targets[s], 6)] = want.get((sizes[s], round(targets[s], 6)), 0) + targets[s]
    assert by.keys() == want.keys() and all(abs(by[k][0] - want[k]) <= 1 for k in by)
    again = mixing.mix_sources(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_mixing_takes_heavier_documents_more_often(spark):
    rows = [(i, "good words here" if i % 2 else "### $$$ %%%", "a" if i < 2000 else "b") for i in range(4000)]
    got = mixing.mix_sources(table(spark, rows), weights=(1, 3)).collect()
    good, bad = (sum(r["taken"] for r in got if r["doc_id"] < 2000 and r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 2 * bad


def test_token_rollup(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "t1", 1, 5, 20), ("a", None, "t1", 1, 7, 30), (None, "en", "t1", 1, 1, 1)],
                                   "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_counts.signed(counts, 1)) and not rollup.commit("one", token_counts.signed(counts, 1))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(map(tuple, counts.collect()), key=str)
    (tmp_path / "r" / "batch=two").mkdir()  # a job that was lost before it committed
    assert rollup.committed() == ["batch=one"]
    rollup.commit("two", token_counts.signed(counts.where("lang IS NULL"), -1))
    rollup.commit("three", token_counts.signed(counts.where("source IS NULL"), -1).union(token_counts.signed(counts.where("source IS NULL").selectExpr("source", "lang", "'t2' AS tokenizer", "n_docs", "n_tokens + 3 AS n_tokens", "n_bytes"), 1)))
    got = sorted(map(tuple, rollup.totals().collect()), key=str)
    assert got == sorted([("a", "en", "t1", 1, 5, 20), (None, "en", "t2", 1, 4, 1)], key=str)


def test_corpus_history(spark):
    import base64

    import tiktoken

    ranks = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{token_counts.TOKENIZERS}/{name}.tiktoken", "rb") as f:
            ranks[name] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coders = {n: tiktoken.Encoding(n, pat_str=token_counts.SPLIT, mergeable_ranks=r, special_tokens={}) for n, r in ranks.items()}
    rows = [(1, "the cat", "en", "s"), (2, "the cat", "en", "s"), (3, None, "en", "s"), (4, "le chat é", "fr", "s"), (5, "le chat é", "de", None), (6, "<|endoftext|> 12", None, "t")]
    rows += [(None, "no id", "en", "s"), (None, "no id", "en", "u"), (None, "the cat", "en", "s"), (None, "", "fr", "s"), (7, "seven", "en", "s"), (7, "the dog", "de", "s")]
    rows += [(8, "the dog", "de", "s"), (7, "seven", "en", "s"), (9, "9", "en", "s"), (9, "nine", "en", "s"), (10, "9", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = {}
    for i, t, lang, source in rows:
        if i == max((j for j, u, *_ in rows if (u or "") == (t or "") and j is not None), default=None):
            name = "byte_bpe_50k" if lang == "en" else "byte_bpe_multi_50k"
            cell = want.setdefault((source, lang, name), [0, 0, 0])
            for k, v in enumerate((1, len(coders[name].encode_ordinary(t or "")), len((t or "").encode()))):
                cell[k] += v
    got = {tuple(r)[:3]: list(r)[3:] for r in token_counts.corpus_history(df).collect()}
    assert got == want
    assert token_counts.corpus_history(df.limit(0)).count() == 0


def labelled(spark, toxic_words=("scoundrel", "blötmann"), n=900):
    rng = random.Random(9)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("na", "pe", "ri", "so")]
    docs, labels = [(0, None, "s"), (-1, "", "s"), (None, "no id", "s")], [(None, 1, 1), (-1, None, None)]
    for i in range(1, n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(toxic_words))
        if bad:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(not bad), int(toxic)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def held_out_accuracy(got, truth, k):
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and truth[r["doc_id"]][k] is not None]
    return sum(r["predicted"] == truth[r["doc_id"]][k] for r in held) / len(held), len(held)


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    right, n = held_out_accuracy(got, truth, 0)
    assert len(got) == docs.count() and n > 100 and right > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    stay = quality.drop_low_quality(docs, labels)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_tree_rules():
    """Paths separate labels that a conjunction decides, lasso weights meet the conditions of the least penalised loss."""
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.STATISTICS))).round(2)
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    rules = quality.tree_rules(x, y, trees=60)
    assert len(rules) == len(set(rules)) and max(len({name for name, *_ in rule}) for rule in rules) <= 3
    assert all(len({(name, sign) for name, sign, _ in rule}) == len(rule) for rule in rules)
    followed = np.column_stack([quality._follows(rule, x) for rule in rules])
    weights, intercept = quality.lasso(followed, y, 0.002, 20_000)
    p = 1 / (1 + np.exp(-(followed @ weights + intercept)))
    slope = followed.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-4 and (np.abs(slope) < 0.002 + 1e-4).all()
    assert np.allclose(slope[weights != 0], -0.002 * np.sign(weights[weights != 0]), atol=2e-4)
    assert ((p > 0.5) == y).mean() > 0.95 and 0 < (weights != 0).sum() < len(rules)


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if line]
    count = lambda test: sum(map(test, text))
    share = lambda a, b: a / b if b else 0.0
    solid, letters = len(re.sub(r"[ \t\n\x0b\f\r]+", "", text)), count(lambda c: unicodedata.category(c)[0] == "L")
    return {
        "n_words": float(len(words)), "word_length": share(solid, len(words)), "distinct_words": share(len(set(words)), len(words)),
        "word_variety": share(len(set(words)), math.sqrt(len(words))), "distinct_lines": share(len(set(lines)), len(lines)), "line_words": share(len(words), len(lines)),
        "symbols": share(count(lambda c: c in "#$%&*|@^~=<>{}[]\\_+!"), solid), "capitals": share(count(lambda c: unicodedata.category(c) == "Lu"), letters),
        "digits": share(count(lambda c: unicodedata.category(c)[0] == "N"), solid), "letters": share(letters, solid),
    }


def test_quality_scores_against_plain_sums(spark):
    """Statistics and the compiled score column agree with plain Python, on odd texts too; an id with many rows is learned once."""
    docs, labels, _ = labelled(spark)
    odd = [(9000, None, "s"), (9001, "", "s"), (9002, " \n\n ", "s"), (9003, "É é ſ 漢字 ½ ٣ 😀 #|", "s"), (9004, "word " * 200_000, "s")]
    docs = docs.union(table(spark, odd))
    model = quality.fit_rules(docs, labels)
    assert model.rules
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for row in docs.select("doc_id", "text").collect():
        own = plain_statistics(row["text"])
        total = model.intercept + sum(w for rule, w in model.rules if all(own[n] <= at if sign == "<=" else own[n] > at for n, sign, at in rule))
        assert math.isclose(got[row["doc_id"]], 1 / (1 + math.exp(-total)), rel_tol=1e-9), row
    known = labels.where("doc_id % 5 = 1").limit(1).first()["doc_id"]
    many = docs.union(docs.where(f"doc_id = {known}").crossJoin(spark.range(50)).drop("id"))
    assert quality.fit_rules(many, labels) == model


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    right, n = held_out_accuracy(got, truth, 1)
    assert len(got) == docs.count() and n > 100 and right > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    disguised = table(spark, [(5000, "kana SC0UNDR3L lope", "s"), (5001, "kana ѕсоundrеl lope", "s"), (5002, "kana lope miri", "s")])
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs.union(disguised), labels).collect()}
    assert scores[5000] > 0.5 and scores[5001] > 0.5 and scores[5002] < 0.5
    spared = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs.union(disguised), labels, exceptions=("kana scoundrel lope",)).collect()}
    assert spared[5000] < 0.5
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    few = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(few) == docs.count() and all(math.isclose(r["score"], 0.5) for r in few)


def test_toxicity_finds_held_out_words(spark):
    """Held-out toxic documents are found and others left alone: a constant score fails; many more words than a short list."""
    rng = random.Random(3)
    bad = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(700)]
    good = ["".join(rng.choice("hjvwz") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, marks = [], []
    for i in range(4000):
        words, toxic = [rng.choice(good) for _ in range(40)], i % 3 == 0
        for _ in range(9 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(toxic)))
    got = toxicity.toxicity_scores(table(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    truth = dict(marks)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    found = sum(p and t for p, t in held)
    assert found / sum(t for _, t in held) > 0.95 and found / max(1, sum(p for p, _ in held)) > 0.95
    lexicon = toxicity.learn_lexicon(table(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    assert len(lexicon.weights) > 600


def test_density_equals_a_plain_scan():
    """Aho-Corasick hits, the heaviest term at each start, spared phrases: as by looking at every place."""
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({" ba": 1.0, " bad ": 2.5, " badly ": 1.5, " mean": 3.0}, ("bad hair", "mean value bad"))
    phrases = [toxicity.fold(p) for p in lexicon.exceptions]
    matcher = lexicon.matcher()
    for _ in range(300):
        text = " ".join(rng.choice(["bad", "b4d", "badly", "hair", "mean", "value", "meaning", "ok"]) for _ in range(rng.randrange(14)))
        folded, total = toxicity.fold(text), 0.0
        spared = {i for p in phrases for at in range(len(folded)) if folded.startswith(p, at) for i in range(at, at + len(p) - 1)}
        for at in range(len(folded)):
            if at not in spared:
                total += max((w for term, w in lexicon.weights.items() if folded.startswith(term, at)), default=0.0)
        assert math.isclose(lexicon.density(matcher, text), math.log1p(100 * total / max(1, folded.count(" ") - 1)))
    assert lexicon.density(matcher, "bad hair " * 60_000) < 1


def test_fold():
    assert toxicity.fold("1d10t!! Idi0t### 100 x5 іdiot") == " idiot idiot 100 x5 idiot "
    assert toxicity.fold("worthle55 idi07! a55, 1999 b8d 9oose 3 v2") == " worthless idiot ass 1999 bbd goose 3 v2 "
    assert toxicity.fold(None) == "  "
