import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_stages_keep_clean_documents_and_drop_copies(spark):
    import corpus_pipeline as C
    from tidewater.llm.common import table, written

    docs = table(spark, DIR, "documents").select(*C.COLUMNS)
    labels = {r.doc_id: r.quality for r in table(spark, DIR, "labels").collect()}
    ids = {r.doc_id for r in docs.collect()}
    seen = []
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), name)
        assert docs.columns == list(C.COLUMNS)
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(got) <= ids
        seen.append(set(got))
        if name == "quality":
            assert not [i for i, q in labels.items() if q == 1 and i not in got]
            junk = [i for i, q in labels.items() if q == 0]  # a few dozen rows to learn from here: most of it goes, not all
            assert sum(i in got for i in junk) <= 0.25 * len(junk)
        if name == "lines":
            assert seen[-1] == seen[-2]
    pieces = C.STAGES[-1][1](spark, docs, DIR).collect()
    assert {p.doc_id for p in pieces} == seen[-1]


def test_lines_and_mix_keep_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    rows = [(None, f"clean text number {i} of its own", "en", "a", 0) for i in range(4)] + [(7, f"other line {i} {i}a {i}b {i}c {i}d", f"l{i}", "b", 0) for i in range(3)] + [(8, "twice the very same row stands here", None, None, 0)] * 2
    docs = spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # a similar line is removed, its row stays
    got = [tuple(r) for r in C.lines(spark, docs, DIR).select("doc_id", "lang", "source").collect()]
    assert sorted(map(str, got)) == sorted(str((i, g, s)) for i, _, g, s, _ in rows)
    from tidewater.llm import mixing

    sizes = docs.selectExpr("doc_id", "source", "cast(size(split(text, ' ')) as long) as size")
    want = mixing.mix_copies(sizes).selectExpr("sum(copies)").first()[0]
    mixed = [tuple(r) for r in C.mix(spark, docs, DIR).collect()]
    assert len(mixed) == want and set(mixed) <= {tuple(r) for r in docs.collect()}


def test_every_stage_by_brute_force_on_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, equal ids with different texts, further columns with the names that stages use."""
    import collections
    import random

    import corpus_pipeline as C
    from tidewater.llm import packing, quality_classifier
    from tidewater.llm.common import table, written

    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeiortnsl") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(6, 14))) for _ in range(n))
    shared = prose(1)
    texts = [prose(rnd.randint(1, 6)) for _ in range(40)] + [f"{prose(2)}\n{shared}" for _ in range(5)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:4]] + ["$$$ ### " * 12] * 3 + [None, "", " \n ", "one", "ONE", None]
    rows = [(rnd.choice([None, i, i, i, 7]), t, rnd.choice(["en", None]), rnd.choice(["a", "b", None]), 0, f"c{i}", 1.5, i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[50]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, score double, size int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bad = lambda t: "$" in (t or "")
    spark.createDataFrame([(r[0], int(not bad(r[1]))) for r in rows if r[0] is not None], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    path, stages = str(tmp_path), dict(C.STAGES)
    docs = table(spark, path, "documents")
    rows_of = lambda df: [tuple(r) for r in df.select(*C.COLUMNS).collect()]
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))

    kept = written(stages["quality"](spark, docs, path), "q")
    model = quality_classifier.fit(docs, table(spark, path, "labels"))
    good = {r.text for r in quality_classifier.score_texts(docs, model).collect() if r.score >= 0.3}
    now = [r[:5] for r in rows if r[1] in good]
    assert same(rows_of(kept), now) and len(now) < len(rows)

    distinct = list(dict.fromkeys((r[0], r[1] or "") for r in now))
    h = [r.h for r in spark.createDataFrame([(n, t) for n, (_, t) in enumerate(distinct)], "n int, t string").selectExpr("n", "shiftrightunsigned(xxhash64(cast(t as binary)), 1) AS h").orderBy("n").collect()]
    earlier, left = [], {}
    for _, (i, t) in sorted(zip(h, distinct), key=lambda y: (y[1][0] is None, y[1][0] or 0, y[0])):
        lines = []
        for line in t.split("\n"):
            w = frozenset(line.lower().split())
            if not (w and any(5 * len(w & x) >= 4 * len(w | x) for x in earlier)):
                lines.append(line)
            if w:
                earlier.append(w)
        left[i, t] = "\n".join(lines)
    now = [(i, left[i, t or ""], g, s, len(left[i, t or ""])) for i, t, g, s, _ in now]
    kept = written(stages["lines"](spark, kept, path), "l")
    assert same(rows_of(kept), now)

    sets = []
    for _, t, *_ in now:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    group = list(range(len(now)))
    for a in range(len(now)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    kept = written(stages["near_duplicates"](spark, kept, path), "n")
    one = rows_of(kept)
    assert len(one) == len(set(group)) and set(one) <= set(now)
    least = lambda g: min(((now[k][0] is None, now[k][0] or 0) for k in range(len(now)) if group[k] == g))
    assert sorted((r[0] is None, r[0] or 0) for r in one) == sorted(least(g) for g in set(group))

    mixed = written(stages["mix"](spark, kept, path), "m")
    times = collections.Counter(rows_of(mixed))
    assert set(times) <= set(one) and max(times.values()) <= 2
    total = sum(len((r[1] or "").split()) for r in one)
    assert abs(sum(n * len((r[1] or "").split()) for r, n in times.items()) - 1.5 * total) < 0.15 * total

    tokens = collections.Counter()
    tokenizer = packing.Encoder().whole
    for r, n in times.items():
        tokens[r[0]] += n * (len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    have = collections.Counter()
    for p in stages["pack"](spark, mixed, path).collect():
        have[p.doc_id] += p.length
    assert have == tokens

    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_near_duplicates_by_brute_force(spark):
    import random

    import corpus_pipeline as C

    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeiortn") for _ in range(5)) for _ in range(500)]
    rows = []
    for i in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(8, 200))]
        rows.append((rnd.choice([None, i, i + 100, 5]), " ".join(base)))
        for changes in (0, 1, 2, 3, 4, 6):
            w = list(base)
            for _ in range(changes):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((rnd.choice([None, i * 10, 5]), " ".join(w)))
    rows += [(1, None), (2, ""), (None, " "), (3, "one two"), (4, "One  two"), rows[0], rows[0], rows[30], rows[30]]
    docs = [(i, t, "en", None, len(t or "")) for i, t in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [tuple(r) for r in C.near_duplicates(spark, df, DIR).collect()]

    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    order = lambda i: (i is None, i or 0)
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g), key=order) for g in set(group)}
    assert len(got) == len(least) and set(got) <= set(docs)
    kept = {g: [r for r in got if any(group[k] == g and docs[k] == r for k in range(len(rows)))] for g in least}
    assert all(len(v) == 1 and v[0][0] == least[g] for g, v in kept.items())


def test_near_duplicates_take_the_links_of_simhash(spark):
    """Texts within SimHash's radius whose sets are far apart: a phrase many times over and a short end of their own. Others stay apart."""
    import random

    import corpus_pipeline as C
    from tidewater.llm.simhash import DISTANCE, simhash

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeiortnsl") for _ in range(6))
    rows = []
    for g in range(6):
        phrase = " ".join(word() for _ in range(9))
        rows += [(10 * g + i, " ".join([phrase] * 80 + [word() for _ in range(8)])) for i in range(3)]
    rows += [(100 + i, " ".join(word() for _ in range(60))) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    group, sets, far = {i: i for i, _ in rows}, {}, 0
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i, t in rows:
        for j, u in rows:
            near = bin(simhash(t) ^ simhash(u)).count("1") <= DISTANCE
            similar = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            far += near and not similar
            if (near or similar) and group[i] != group[j]:
                x, y = max(group[i], group[j]), min(group[i], group[j])
                group = {k: y if v == x else v for k, v in group.items()}
    assert far > 0
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, DIR).collect()) == sorted(set(group.values()))
