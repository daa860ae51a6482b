"""Line dedup, decontamination, quality rules."""

import math
import random
import re

from pyspark.sql import functions as F

from sieveworks.llm.decontaminate import Seeds, contamination, keep_clean
from sieveworks.llm.line_dedup import Winnow, dedup_lines, minima
from sieveworks.llm.quality_rules import RATIOS, Risk, binomial_tail, fit_cutoffs, judge, keep_documents, measures

from .conftest import prose

WS = "[\x20\x09-\x0d]+"


def brute_lines(docs, how):
    """Removed lines by comparing windows of worded lines, and the lines beside them, in document order."""
    seen, out = {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x)]
        mine, gone = [lines[k] for k in at], set()
        for f in range(len(at)):
            t = next((t for t in range(f, len(at)) if t - f + 1 == how.window or sum(len(x.split()) for x in mine[f : t + 1]) >= how.long_words), None)
            if t is None:
                break
            key = tuple(mine[f : t + 1])
            if key not in seen:
                seen[key] = mine, f, t
                continue
            other, g, u = seen[key]
            low, high = f, t
            for k in range(1, how.window):
                if low == f - k + 1 and f - k >= 0 and g - k >= 0 and mine[f - k] == other[g - k]:
                    low = f - k
                if high == t + k - 1 and t + k < len(mine) and u + k < len(other) and mine[t + k] == other[u + k]:
                    high = t + k
            gone |= set(at[low : high + 1])
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None, sorted(gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [prose(rng, rng.choice([3, 6, 30])) for _ in range(25)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(90, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for how in (Winnow(3, 25), Winnow(2, 10), Winnow(4, 60)):
        got = dedup_lines(frame, how).orderBy("doc_id").collect()
        expected = brute_lines(docs, how)
        assert [(r["doc_id"], r["text"], r["removed"]) for r in got] == expected and any(x[2] for x in expected)


def test_fingerprints_are_the_minima_of_windows(spark):
    """Few lines are kept, each window has one, and what is repeated shares one."""
    rng = random.Random(31)
    base = [prose(rng, 6) for _ in range(400)]
    docs = [(1, "\n".join(base)), (2, "\n".join([prose(rng, 6), *base[100:130], prose(rng, 6)]))]
    how = Winnow(8, 10**6)
    rows = minima(spark.createDataFrame(docs, "doc_id long, text string"), how).collect()
    assert len(rows) < 0.4 * 432 and sum(len(r["_windows"]) for r in rows) == 400 - 7 + 32 - 7
    assert all(r["_a"][r["_c"]] == r["_print"] == min(r["_a"][w["f"] : w["t"] + 1]) for r in rows for w in r["_windows"])
    prints = [{r["_print"] for r in rows if r["_id"] == i} for i in (1, 2)]
    assert len(prints[0] & prints[1]) >= 30 // 8


def test_line_dedup_odd_rows(odd_docs, no_docs):
    rows = {(r["doc_id"], r["text"]): r for r in dedup_lines(odd_docs).collect()}
    assert rows[(2, None)]["removed"] == [] and rows[(3, "")]["n_lines"] == 1
    by = {k[0]: r for k, r in rows.items()}
    assert by[5]["removed"] == [] and len(by[6]["removed"]) == 300 and by[6]["text"] == ""
    assert len(by[9]["removed"]) == 7  # every window after the first repeats it
    assert dedup_lines(odd_docs).count() == odd_docs.count() and dedup_lines(no_docs).count() == 0


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 30, 5000)) for i in range(5)] + [(5, None), (6, "too short")]
    passage = items[2][1].split()
    for k in range(4, 30, 7):
        passage[k] = "changed"
    docs = [(1, prose(rng, 80, 5000) + " " + items[0][1].upper().replace(" ", ",  ") + " " + prose(rng, 20)), (2, " ".join(passage)), (3, prose(rng, 200, 5000)), (4, None), (5, " ".join(items[3][1].split()[:15])), (6, " ".join(items[3][1].split()[:12]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for how in (Seeds(), Seeds(broadcast_seeds=1)):
        got = {r["doc_id"]: r for r in contamination(frame, bench, how).collect()}
        assert {i: r["items"] for i, r in got.items()} == {1: [0], 2: [2], 3: [], 4: [], 5: [3], 6: []}
        assert got[1]["overlap"] == 30 and got[2]["overlap"] == 26 and got[5]["overlap"] == 15
    assert {r["doc_id"] for r in keep_clean(frame, bench).collect()} == {3, 4, 6}


def accepted(same):
    """The longest run of the scorer, over a list of booleans."""
    score = equal = best = 0
    for s in same:
        score += 1 if s else -4
        equal += s
        if score < 0:
            score = equal = 0
        best = max(best, equal)
    return best


def test_a_mask_fits_every_accepted_run():
    """All ways to place mismatches among 13 equal words that the scorer accepts."""
    runs = [[True]]
    full = []
    while runs:
        run = runs.pop()
        if sum(run) == 13:
            full.append(run)
        else:
            runs += [run + [True]] + ([run + [False]] if accepted(run + [False]) == sum(run) and accepted(run + [False, True]) == sum(run) + 1 else [])
    assert len(full) == 80
    places = [[p for p, c in enumerate(m) if c == "1"] for m in Seeds().masks]
    assert all(any(all(run[i + p] for p in ps) for ps in places for i in range(len(run) - ps[-1])) for run in full)


def test_decontamination_matches_direct_alignment(spark, odd_docs):
    """Short items, and passages with a substitution in every fifth and every sixth word and at random."""
    rng = random.Random(21)
    items = [(n, prose(rng, n, 50_000)) for n in range(1, 14)] + [(100 + i, prose(rng, 100, 5000)) for i in range(6)] + [(200, None), (201, " ., "), (202, "same line of text")]
    texts = {i: (t or "").split() for i, t in items}
    docs = [(i, f"{prose(rng, 5, 5000)} {t.upper()}, {prose(rng, 5, 5000)}") for i, t in items[:13]]
    for i, step in enumerate((5, 6, 4, 5)):
        docs.append((50 + i, " ".join(f"x{k}" if k % step == step - 1 else w for k, w in enumerate(texts[100 + i][7:]))))
    docs += [(60 + i, " ".join(f"y{k}" if rng.random() < share else w for k, w in enumerate(texts[104 + i % 2]))) for i, share in enumerate((0.1, 0.15, 0.2, 0.25, 0.3, 0.2, 0.25, 0.22))]
    docs += [(80, " ".join(texts[12][:-1])), (81, " ".join(texts[13][:12])), (82, None), (83, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = {}
    for i, text in docs:
        mine = [w for w in re.split("[ ,]+", (text or "").lower()) if w]
        best = {j: max((accepted([mine[k + s] == w for k, w in enumerate(ws) if 0 <= k + s < len(mine)]) for s in range(-len(ws), len(mine))), default=0) for j, ws in texts.items() if ws and ws != ["."]}
        expected[i] = sorted(j for j, b in best.items() if b >= min(13, len(texts[j])) and j < 201)
    assert expected[50] == [100] and expected[51] == [101] and expected[0 + 1] == [1] and expected[80] == []
    for how in (Seeds(), Seeds(broadcast_seeds=1)):
        got = {r["doc_id"]: r["items"] for r in contamination(frame, spark.createDataFrame(items, "item_id long, text string"), how).collect()}
        assert got == expected
    odd = contamination(odd_docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(odd) == odd_docs.count() and {r["doc_id"] for r in odd if r["contaminated"]} == {9}


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd_docs, bench).where("contaminated").count() == 0
    kept = keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert contamination(no_docs, bench).count() == 0


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(covered)


def test_base_counts_match_brute_force(spark, odd_docs):
    rng = random.Random(3)
    texts = [prose(rng, n, 6) for n in (0, 1, 2, 3, 4, 9, 60)] + ["#a *b\x0bc\n\nx\nx\n y\n y\n!! AB", "a a a a", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", measures(F.col("text")).alias("m")).orderBy("i").collect()
    for text, m in zip(texts, (r["m"] for r in got)):
        words = [w for w in re.split(WS, text or "") if w]
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words)) and m["n_repeat_words"] == repeat_words(words)
        assert m["n_dup_lines"] == len(lines) - len(set(lines)) and m["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")


def tail(n, k, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def test_binomial_tail_is_exact(spark):
    cases = [(100, 0), (100, 1), (100, 3), (2000, 20), (5000, 70), (500, 24), (40_000, 720), (40_000, 799), (200_000, 3800)]
    frame = spark.createDataFrame(cases, "n long, k long")
    for r, (n, k) in zip(frame.select(binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect(), cases):
        assert abs(r["p"] - (tail(n, k, 0.02) if k < n * 0.02 else 1)) < 1e-9
    assert spark.createDataFrame([(0, 0)], "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p")).first()["p"] == 1


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(4)
    words = [prose(rng, 60).split() for _ in range(1500)]
    docs = [(i, " ".join(w if i % 10 else [x.upper() + "!!" for x in w]), "en" if i % 3 else None) for i, w in enumerate(words)]
    labels = spark.createDataFrame([(i, bool(i % 10)) for i in range(1500)] + [(None, True), (3, None)], "doc_id long, good boolean")
    how = Risk(alpha=0.1)
    out = judge(spark.createDataFrame(docs, "doc_id long, text string, stratum string"), labels, how).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == 1500 and not any(kept[i] for i in range(0, 1500, 10))
    for stratum in ("en", None):
        good = [r for r in out if r["stratum"] == stratum and r["doc_id"] % 10]
        assert sum(not r["kept"] for r in good) <= how.alpha * len(good)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, True), (None, False), (5, None)], "doc_id long, good boolean")
    kept = keep_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {5, 6, 7, None}
    assert keep_documents(no_docs, labels).count() == 0
    assert keep_documents(odd_docs, labels.limit(0)).count() == kept.count()
    assert len(RATIOS) == 5 and fit_cutoffs.__doc__
