"""Operators 11, 12 and 13 on their edges: nulls, ties, repeated rows, empty tables, clashing columns, long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksymbols.llm import conversations, hard_negatives, line_rules, turn_repair

TURNS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(codes):
    """Cost and letters by trying every edit from every state."""
    known = {}

    def best(i, state, added):
        if (i, state, added) in known:
            return known[i, state, added]
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        steps = []
        if i < len(codes):
            initial, fault = divmod(codes[i], 3)
            steps.append((3, "D", i + 1, state))
            if fault != turn_repair.GONE:
                more = fault == turn_repair.CUT
                for to in [turn_repair.NEXT.get((state, initial))]:
                    if to is not None:
                        steps.append((more, "K", i + 1, to))
                steps += [(2 + more, "R", i + 1, to) for (at, role), to in turn_repair.NEXT.items() if at == state and role]
        if added < 3:
            steps += [(2, "I", i, to) for (at, role), to in turn_repair.NEXT.items() if at == state and role]
        for cost, letter, at, to in steps:
            rest = best(at, to, added + 1 if letter == "I" else 0)
            if rest:
                found.append((cost + rest[0], letter + rest[1]))
        known[i, state, added] = min(found, default=None)
        return known[i, state, added]

    return best(0, 0, 0)


def plain_repair(rows):
    """The expected row of each conversation, rows given as ``conv_id, turn, role, text``."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{' ' if conv is None else conv}\0{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults, codes = set(), Counter(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            place = "sua".find(role[0]) if role and role[0] in "sua" else 3
            codes.append(3 * place + {None: 0, "truncated": 1}.get(fault, 2))
        cost, audit = cheapest(tuple(codes))
        mended, state, i = [], 0, 0
        for letter in audit:
            into = turn_repair.GROWN[state]
            if letter == "I":
                mended.append(f"{turn_repair.ROLE_INTO[into]}:")
                state = into
                continue
            _, role, text = own[i]
            if letter == "K":
                mended.append(f"{role}:{text}")
                state = turn_repair.NEXT[state, codes[i] // 3]
            elif letter == "R":
                mended.append(f"{turn_repair.ROLE_INTO[into]}:{text}")
                state = into
            i += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in mended))
        initials = [role[:1] for _, role, _ in own]
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(mended).encode()).hexdigest())
    return out


def some_turns(seed, n, convs):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Yes.", "No", "So it is!", " \t", "", None, "Why?", "long\ntext. ", "Yes."]
    return [(r.choice(convs), r.choice([None, *range(8)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_against_plain_walk(spark, partitions):
    """One conversation holds most rows and spans all partitions; ids, turns, roles and texts may be null."""
    rows = some_turns(3, 120, [1, 1, 1, 1, 2, 3, None]) + [(9, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(40)]
    rows += [(4, 1, "user", "Same.")] * 30
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({"segment": F.lit(1), "plan": F.lit("x"), "same": F.lit(0)})
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9, 77, None)], "conv_id bigint")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df, ids, partitions).collect()}
    want = plain_repair(rows) | {77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got == want


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "cut off"), (1, 2, "user", "cut off"), (1, 3, "tool", "Done.")]
    got = conversations.repaired_turns(spark.createDataFrame(rows, TURNS), 2).orderBy("segment", "line").collect()
    assert [(r["edit"], r["turn"], r["role"], r["text"]) for r in got] == [
        ("I", None, "user", ""), ("K", 0, "assistant", "Hello."), ("K", 1, "user", "cut off"), ("R", 3, "assistant", "Done.")
    ]


def test_repair_of_nothing_and_of_long_texts(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.damaged_and_repaired(none).count() == 0
    long = [(5, 1, "user", "word " * 1_000_000 + "."), (5, 2, "assistant", "x" * 3_000_000 + ".")]
    df = spark.createDataFrame(long, TURNS)
    (row,) = conversations.repair(df, df, 2).collect()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for *_, r, t in long).encode()).hexdigest()


def test_vectors_at_square_roots():
    """A walk over many rows agrees with the same rows cut anywhere."""
    r = random.Random(5)
    codes = bytes(r.randrange(12) for _ in range(500))
    whole = list(turn_repair.walk(codes))
    for cut in (1, 22, 23, 250, 499):
        vectors, _ = turn_repair.through(codes[cut:])
        _, states = turn_repair.through(codes[:cut])
        first = list(turn_repair.walk(codes[:cut], vectors[0]))
        assert first + list(turn_repair.walk(codes[cut:], 0, states[4 * vectors[0]])) == whole


def plain_lines(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = {at + k for at, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_line_counts(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a a a a", "a b c a b c", "x y\nx y\nx y", "ä ß é 😀 # |", "\n\n", "a b c d e a b c z b c d"]
    texts += [" ".join(r.choice("ab\ncd|") for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, kept int, w string")
    got = {row["doc_id"]: row for row in line_rules.clean_lines(docs).collect()}
    for i, text in enumerate(texts):
        row, want = got[i], plain_lines(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want, text
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_line_rules(spark):
    prose = "\n".join(f"Sentence{i} has{i} words{i} that{i} come{i} once{i} only{i}." for i in range(12))
    menu = "Home | News | Sport | Mail | Cars | Money\n"
    texts = {
        "good": prose, "menu": menu + prose, "mostly menu": "\n".join(f"Home{i} | News | Sport | Mail{i} | Cars | Money" for i in range(30)) + "\n" + prose[:200],
        "furniture": "This page uses cookies, as pages do.\nAll rights reserved 2020 by us.\n" + prose, "headings": "A heading\n" + prose,
        "unstopped": "\n".join(f"item{i} of{i} a{i} list{i} without{i} stops{i}" for i in range(20)), "quoted": "\n".join(f"He{i} said{i} “it{i} is{i} these{i} things{i}.”" for i in range(12)),
        "shouting": "\n".join(f"BUY{i}!! NOW{i}!! CHEAP{i}!! GOODS{i}!! TODAY." for i in range(20)), "long": ("Words of a very long text follow here. " * 3 + "\n") * 50_000,
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values()])], "doc_id bigint, text string")
    got = dict(zip(texts, sorted(line_rules.clean_lines(docs).collect(), key=lambda r: r["doc_id"])))
    assert {name: row["kept"] for name, row in got.items()} == {
        "good": True, "menu": True, "mostly menu": False, "furniture": True, "headings": True, "unstopped": False, "quoted": True, "shouting": False, "long": False,
    }
    assert got["menu"]["clean_text"] == got["furniture"]["clean_text"] == got["headings"]["clean_text"] == prose
    assert [got["menu"]["n_navigation"], got["furniture"]["n_boilerplate"], got["headings"]["n_punctuation"]] == [1, 2, 1]
    assert line_rules.clean_lines(docs.limit(0)).count() == 0
    assert "ArrowEval" not in (plan := line_rules.line_verdicts(docs)._jdf.queryExecution().toString()) and "Exchange" not in plan


VECTORS = "vec_id bigint, embedding array<double>, label int"


def plain_negatives(rows, every):
    fine = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        fine.append((i, [int(np.floor(256 * x)) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    rank = lambda row: (-row[0], row[1] is None, row[1] or 0)
    for i, vector, label in fine:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), j, own) for j, v, own in fine]
        positives = sorted((s for s in scored if s[2] == label and s[1] != i), key=rank)[:5]
        for score, j, _ in positives:
            found = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=rank)[:5]
            out += [(i, j, at, k, score, s) for at, (s, k, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def some_vectors(seed, n, spread=0.3, width=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, width))
    return [(i, [float(x) for x in (centres[i % 4] + spread * r.normal(size=width)).round(2)], int(i % 4 if r.random() < 0.5 else r.integers(4))) for i in range(n)]


def test_negatives_against_plain_loops(spark, monkeypatch):
    """Several blocks, strips and groups; nulls, ties, repeated rows, unequal lengths."""
    rows = some_vectors(1, 300)
    rows += [(301, None, 1), (302, [1.0], None), (303, [1.0, None], 1), (304, [float("nan")], 1), (305, [float("inf"), 1.0], 2), (306, [], 3)]
    rows += [(None, rows[5][1], 1), (307, rows[5][1][:3], 2), (308, rows[8][1] + [9.0], 0), (308, rows[8][1], 0), (309, rows[8][1], 2), (309, rows[8][1], 2)]
    for name, value in (("STRIP_ROWS", 40), ("BLOCK_ROWS", 16), ("GROUPS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({"block": F.lit(1), "score": F.lit("s"), "vector": F.lit(0)})
    got = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in hard_negatives.hard_negatives(df, 5).collect()]
    want = plain_negatives(rows, 5)
    assert len(want) > 300 and sorted(got, key=str) == want


def test_negatives_of_nothing_and_of_large_numbers(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(100, [2.0**20, 3.0], 1), (101, [2.0**19, 5.0], 1), (102, [2.0**19, 4.0], 2), (103, [2.0**19, 5.0], 2), (104, [-(2.0**20), 0.0], 3)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_negatives(rows, 100) and len(got) == 2


def test_bounds_skip_pairs():
    """Where anchors lie close together, most pairs are never scored, and none of the first few is missed."""
    r = np.random.default_rng(4)
    anchors = np.floor(2560 * (np.ones(16) + 0.01 * r.normal(size=(40, 16))))
    matrix = np.floor(2560 * r.normal(size=(2000, 16)))
    order, parent, edges = hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and (parent < 0).sum() == 1
    block = {"ids": np.arange(40) + 10_000, "labels": np.zeros(40, int), "matrix": anchors, "norms": hard_negatives._norms(anchors), "order": order, "parent": parent, "edges": edges}
    strip = {"ids": np.arange(2000), "nulls": np.zeros(2000, bool), "labels": np.zeros(2000, int), "matrix": matrix, "norms": hard_negatives._norms(matrix)}
    best = {}
    hard_negatives.mine_strip(block, strip, None, best)
    scored, pairs = hard_negatives.mine_strip(block, strip | {"ids": np.arange(2000) + 2000}, None, best)
    assert pairs == 80_000 and scored < pairs / 10
    for at, anchor in enumerate(anchors):
        top = sorted((matrix @ anchor).tolist(), reverse=True)[:3]
        assert [score for score, _, _ in best[at, at].rows] == [s for s in top for _ in range(2)][:5]
