"""Each operator against a brute-force version, on a fixture with nulls, empty and long texts, ties, copies and extra columns."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import fingerprints, graph, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, warc
from tidewater.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def make():
    rnd = random.Random(4)
    words = ["the", "of", "and", "été", "Straße", "ñandú", *["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 9))) for _ in range(400)]]

    def prose(n):
        return "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 30))) + "." for _ in range(n))

    texts = [None, "", " \t\n ", "one", "Hello hello", "KK İ cc BY 4.0", "CC-BY cc by by cc by", "All rights reserved. all  RIGHTS\treserved", "under the GNU General Public License, version 3.", "x" * 99, "x" * 100, "x" * 101, "ab " * 300]
    texts += [prose(rnd.randint(1, 9)) for _ in range(40)]
    long = prose(300)
    texts += [long, long, long.replace("the", "thee", 3), texts[20], texts[20] + " tail", texts[21][:200] + texts[22][:300], "Licensed under the MIT License.\n" + texts[23], "Licensed under the MIT License.\n" + texts[24]]
    near = texts[25].split("\n")
    texts += ["\n".join(near[:-1] + [near[-1] + " added"])] * 2 + ["日本語 テキスト 🙂 🙂", "!! ## " * 40, "WORD!! " * 60]
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4 if i % 3 else 0], 0, 1.0, 5) for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(docs, rows, empty):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            f = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at, labels = at + f, labels | ({label} if f else set())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        # detections, by the same rules with Python's expressions
        norm = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', t or ''))} "
        found = []
        for rule in license_scan.rules():
            if rule["keyword"] in norm.lower():
                found += [(m.start(), m.end(), rule["priority"], rule["rule"]) for m in re.finditer(rule["pattern"], norm, re.ASCII)]
        beaten = lambda d: any(e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3])) for e in found)  # noqa: B023, E731
        assert r.rules == sorted({d[3] for d in found if not beaten(d)}) and r.n_detections == len(found)
    assert license_scan.scan_licenses(empty).count() == 0
    assert len(license_scan.rules()) > 200


def test_license_scan_of_many_places_in_one_text(spark):
    t = "Licensed under CC BY-NC 4.0. " * 300
    r = license_scan.scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word) == (300, 2, 299 * 7 + 2) and r.labels == "cc-by,cc-by-nc-4.0,license"


def test_mixing(docs, rows, empty):
    d = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    got = mixing.mix_copies(d).collect()
    assert sorted(r.doc_id for r in got) == sorted(x[0] for x in rows)
    sizes = {x[0]: len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows}
    total = collections.Counter()
    for x in rows:
        total[x[3]] += sizes[x[0]]
    order = sorted([s for s in total if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), 1.5 * sum(total.values())
    while left:  # share by weight, stop those above, share again
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            left.remove(s)
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2
    for s in order:
        n, rate = sum(r.source == s for r in got), target[s] / total[s]
        assert abs(sum(r.copies for r in got if r.source == s) - n * rate) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_copies(d).collect()))
    assert mixing.mix_copies(empty).count() == 0


def test_quality_rules(docs, rows, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs.drop("size")).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)
    every = [{r.doc_id: r.kept for r in quality_rules.apply_rules(docs, order=o).collect()} for o in (list(quality_rules.rules()), list(quality_rules.rules())[::-1])]
    assert every[0] == every[1] == {i: r.kept for i, r in got.items()}  # the order changes the cost only
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_classifier(spark, empty):
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choice(["the", "an", "er", "in"]) for _ in range(3)) for _ in range(60))
    bad = lambda: rnd.choice([lambda: " ".join(f"{rnd.choice(['re', 'on'])}###" for _ in range(60)), lambda: " ".join(["again"] * 30 + ["more"] * 30), lambda: good().upper()])()
    data = [(i, None if i == 300 else "" if i == 301 else good() if i % 2 else bad()) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(298)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score_texts(docs, model).collect()}
    held = [i for i in range(298) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == i % 2 for i in held) / len(held) > 0.95
    assert got[300] == got[301] and all(0 <= s <= 1 for s in got.values())
    assert len(quality_classifier.training_rows(docs, labels)) == 298 - len(held)
    assert quality_classifier.score_texts(docs, quality_classifier.fit(docs, labels.limit(0))).agg(F.countDistinct("score")).first()[0] == 1
    assert quality_classifier.score_texts(empty, model).count() == 0


def test_fingerprints(docs, rows, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs, parts=5).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        e = fingerprints.edited(t, after)
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == fingerprints.as_hex(fingerprints.sketch(t)) and r.near_next == fingerprints.likeness(fingerprints.sketch(t), fingerprints.sketch(after))
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_closed_syncmers_by_definition():
    t = "the quick brown fox jumps over the lazy dog, été and naïve " * 3
    k, s = fingerprints.K, fingerprints.S
    inner = {}

    def h(x):  # the same hash of an s-mer, one at a time
        if x not in inner:
            c = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in x:
                    c = c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(ch))
                inner[x] = int(fingerprints._mix(np.array([c]))[0])
        return inner[x]

    want = []
    for i in range(len(t) - k + 1):
        m = [h(t[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(m) in (m[0], m[-1]):
            want.append(i)
    at, hashes = fingerprints.anchors(t)
    assert at.tolist() == want
    by_kmer = {}
    for i, x in zip(at, hashes):
        assert by_kmer.setdefault(t[i : i + k], x) == x  # context-free
    shifted = set(fingerprints.anchors("zzz" + t)[1].tolist())
    assert set(hashes.tolist()) <= shifted


def test_simhash(docs, rows, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    import xxhash

    fp = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert got[i].fp & (2**64 - 1) == fp[i]
    assert {i: r.component_id for i, r in got.items()} == brute_components(fp)
    assert simhash.near_duplicates(empty).count() == 0


def brute_components(fp):
    comp = {i: i for i in fp}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in fp:
        for b in fp:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in fp}


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for bits in range(5):
        y = x.copy()
        for row in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[row] ^= np.uint64(1) << np.uint64(b)
        shared = simhash.ring_keys(x) == simhash.ring_keys(y)
        passes = np.array([simhash.passes(x, y, k // 5) for k in range(25)])
        assert (shared & passes).any(axis=0).all()


def test_simhash_of_a_group_under_one_key(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << b) for b in range(40)] + [base ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(20, 40)]
    rows = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)]
    pairs = simhash.link_pairs(spark.createDataFrame(rows, "fp long, node long")).collect()
    assert len(pairs) < 30 * len(fps)  # no pairs of all with all
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(p.a, p.b) for p in pairs], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(len(fps)), 0)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 140), 100) | {299: 299, 300: 299}


def test_line_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, buckets=5).collect()}
    earlier = []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(lower(line).encode().split())
            if len(w) >= 5:
                if any(5 * len(w & x) >= 4 * len(w | x) for x in earlier):
                    earlier.append(w)
                    continue
                earlier.append(w)
            kept.append(line)
        assert got[i].text == "\n".join(kept), i
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = repeated()
    earlier, want = [], {}
    for i, t in in_order(spark, rows):
        kept = []
        for line in t.split("\n"):
            w = frozenset(line.split())
            again = len(w) >= 5 and any(5 * len(w & x) >= 4 * len(w | x) for x in earlier)
            earlier.append(w)
            if not again:
                kept.append(line)
        want[i, t] = "\n".join(kept)
    for parts in (1, 5):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, REPEATED).repartition(parts), buckets=3, carry=("lang",)).collect()
        assert sorted((r.lang, str(r.doc_id), r.text) for r in got) == sorted((n, str(i), want[i, t or ""]) for i, t, n in rows)


def test_line_dedup_of_lines_about_the_threshold(spark):
    """Large groups of lines whose similarity lies about 0.8, so that closest candidates often fail and records have many."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    lines = []
    for _ in range(6):
        base = rnd.sample(words, rnd.choice([9, 20, 36, 70, 240]))
        for _ in range(60):
            new = list(base)
            for _ in range(rnd.randint(0, len(base) // 4)):
                new[rnd.randrange(len(new))] = rnd.choice(words)
            lines.append(" ".join(new).upper() if rnd.random() < 0.1 else " ".join(new))
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(len(lines) // 3)]
    earlier, want = [], {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = frozenset(lower(line).split())
            if not any(5 * len(w & x) >= 4 * len(w | x) for x in earlier):
                kept.append(line)
            earlier.append(w)
        want[i] = "\n".join(kept)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=4).collect()
    assert {r.doc_id: r.text for r in got} == want and 30 < sum(r.n_removed for r in got) < len(lines) - 30


def test_candidates_are_all_that_pass():
    rng = np.random.default_rng(5)
    n = 400
    rows = np.zeros(n, line_dedup.PREFIX)
    rows["code"], rows["doc"], rows["line"] = rng.integers(0, 6, n), rng.integers(0, 90, n), rng.integers(0, 4, n)
    rows["n"] = rng.integers(1, 40, n)
    rows["pos"] = rng.integers(0, 3, n) % rows["n"]
    rows["sig"] = np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)
    rows, rest = line_dedup.by_code([(rows, np.zeros(0, np.uint64))])
    want = collections.defaultdict(set)
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = rows[i], rows[j]
            x, y = int(a["n"]), int(b["n"])
            need = -(-4 * (x + y) // 9)
            if a["code"] == b["code"] and b["rank"] < a["rank"] and 5 * min(x, y) >= 4 * max(x, y) and min(x - a["pos"], y - b["pos"]) >= need and bin(int(a["sig"]) ^ int(b["sig"])).count("1") <= x + y - 2 * need:
                want[i].add(j)
    have = collections.defaultdict(set)
    for later, earlier, _ in line_dedup.passing(rows, rest):
        for i, j in zip(later.tolist(), earlier.tolist()):
            have[i].add(j)
    assert have == want and len(want) > 50
    later, earlier, more = line_dedup.closest(rows, rest)
    assert set(later.tolist()) == set(want) and all(rows["rank"][j] in rows["rank"][list(want[i])] and m == (len(want[i]) > 1) for i, j, m in zip(later.tolist(), earlier.tolist(), more.tolist()))
    asked = np.arange(len(rows)) % 2 == 0
    later, earlier, whole = line_dedup.candidates(rows, rest, asked, most=3)
    few = {i for i in want if asked[i] and len(want[i]) <= 3}
    assert sorted(zip(later.tolist(), earlier.tolist())) == sorted((i, j) for i in few for j in want[i])
    many = {i for i in want if asked[i] and len(want[i]) > 3}
    assert many and many | {j for i in many for j in want[i]} == set(whole.tolist())


def test_parity_maps_bound_the_distance_of_sets():
    rng = np.random.default_rng(2)
    sets = []
    for n in (3, 40, 64, 65, 150, 230, 500, 900):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [base, np.concatenate([base[: n - n // 12], rng.integers(0, 2**63, n // 10, dtype=np.uint64)])]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    rows = np.zeros(len(sets), [*line_dedup.PREFIX, ("rest", "<i8")])
    rows["n"] = n
    rows["sig"], rest = line_dedup.parity_maps(n, np.concatenate(sets))
    more = line_dedup.maps_of(n) - 1
    rows["rest"] = np.cumsum(more) - more
    assert more.tolist() == sorted(more.tolist()) and set(more.tolist()) == {0, 1, 3, 7}
    maps = line_dedup.Maps(rows, rest)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = np.array([i]), np.array([j])
            near, far = np.bitwise_count(maps.one[x] ^ maps.one[y]), len(np.setxor1d(a, b))
            assert maps.far(x, y, near)[0] <= far and near[0] <= maps.far(x, y, near)[0]
            if far == 0:
                assert maps.far(x, y, near)[0] == 0


def test_line_dedup_of_every_line(spark, tmp_path, docs, rows):
    short = [(100 + i, t, None, None, 0, 0.0, 0) for i, t in enumerate(["Menu\nAll rights reserved.\n\n", "all RIGHTS reserved.\nmenu home\n \na a b", "b a\nMenu Home x y\nmenu\n"])]
    spark.createDataFrame(rows + short, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    earlier, all_lines = [], 0
    for i, t, *_ in sorted(rows + short, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(lower(line).encode().split())
            if w:
                again = any(5 * len(w & x) >= 4 * len(w | x) for x in earlier)
                earlier.append(w)
                if again:
                    continue
            kept.append(line)
        lines = len((t or "").split("\n"))
        all_lines += lines
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_sha256) == (lines, lines - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), i
    assert sum(r.n_lines for r in got.values()) == all_lines


def test_packing(docs, rows, empty):
    got = packing.pack_texts(docs, group=7).collect()
    encoder = packing.Encoder()
    want = {i: [*encoder.whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in want.items():
        have = b"".join(bytes(r.ids) for r in sorted(by_doc[i], key=lambda r: r.start))
        assert np.frombuffer(have, "<u4").tolist() == ids
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]] and sum(r.length for r in rs) <= 2048 and len(rs) <= packing.SEGMENTS
    assert packing.pack_texts(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n", "a", " a", "a ", "a\nb", "a  b", "a \nb", "\na b\n", "it's 12,345.67 naïve x", "tab\there", "<|endoftext|> x", "日本 語", "a b", "don't I'll we've", "œuvre ﬁ", "x\r\ny"])
def test_encoder_gives_the_tokenizers_ids(text):
    e = packing.Encoder()
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_vector_limits_hold_and_examples_stay_whole():
    rnd = random.Random(6)
    p = packing.Packer((100, 4, 40), cut=False)
    sizes = {}
    for k in range(300):
        n = rnd.randint(1, 100)
        sizes[k] = (n, rnd.randint(0, min(n, 40)))
        p.add(k, *sizes[k])
    done = p.pieces()
    for seq in done:
        assert sum(n for _, _, n in seq) <= 100 and len(seq) <= 4 and sum(sizes[k][1] for k, _, _ in seq) <= 40
    assert sorted(k for seq in done for k, _, _ in seq) == list(range(300)) and all(start == 0 and n == sizes[k][0] for seq in done for k, start, n in seq)
    with pytest.raises(ValueError):
        p.add(1, 101)


def test_suffix_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, buckets=5).collect()}
    seen = set()
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                hit[k : k + 100] = b"\x01" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(hit), spans, kept), i
    assert suffix_dedup.remove_repeats(empty).count() == 0


REPEATED = "doc_id long, text string, lang string"


def repeated():
    rnd = random.Random(9)
    prose = lambda n: "\n".join(" ".join("".join(rnd.choice("aeiortn") for _ in range(6)) for _ in range(9)) for _ in range(n))
    a, b, c, d = prose(5), prose(2), prose(6), prose(3)
    out = [(1, a), (1, a), (2, b), (2, c), (2, c), (3, a + "\n" + b), (None, d), (None, d), (None, c + d), (None, prose(2)), (2**63 - 1, d), (4, None), (4, None), (None, None)]
    return [(i, t, str(n)) for n, (i, t) in enumerate(out)]


def in_order(spark, rows):
    """Distinct (doc_id, text) as the operators order them: null ids last, then by hash of the text."""
    distinct = list(dict.fromkeys((i, t or "") for i, t, _ in rows))
    h = [r.h for r in spark.createDataFrame([(n, t) for n, (_, t) in enumerate(distinct)], "n int, t string").selectExpr("n", "shiftrightunsigned(xxhash64(cast(t as binary)), 1) AS h").orderBy("n").collect()]
    return [x for _, x in sorted(zip(h, distinct), key=lambda y: (y[1][0] is None, y[1][0] or 0, y[0]))]


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    rows = repeated()
    seen, want = set(), {}
    for i, t in in_order(spark, rows):
        b = t.encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                hit[k : k + 100] = b"\x01" * 100
            seen.add(b[k : k + 100])
        want[i, t] = (len(b), sum(hit), bytes(x for x, y in zip(b, hit) if not y))
    for parts in (1, 5):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, REPEATED).repartition(parts), buckets=3).collect()
        assert sorted(((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got)) == sorted((str(i), *want[i, t or ""]) for i, t, _ in rows)


def test_minimizer_runs_of_a_text_over_the_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 10)
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    docs = spark.createDataFrame([(1, long), (2, "zz" + long[700:4200])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, buckets=3).collect()}
    assert (got[1].n_removed, got[2].n_removed, bytes(got[2].kept)) == (0, 3500, b"zz")


def test_memory_of_the_map_step_is_that_of_its_runs_and_a_small_chunk(monkeypatch):
    """12 MB of text, more than a chunk: the arrays of a chunk and the copies that settling makes were 200 MB at their peak."""

    class Docs:
        def mapInArrow(self, step, schema):
            raise StopIteration(step)

    monkeypatch.setattr(suffix_dedup, "doc_bytes", lambda *_: Docs())
    with pytest.raises(StopIteration) as found:
        suffix_dedup.find_repeats(None, buckets=8)
    raw = np.random.default_rng(5).integers(97, 123, 12_000_000, np.uint8).tobytes()
    texts = [raw[i : i + 3000] for i in range(0, len(raw), 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array(range(len(texts)), pa.int64())], ["doc", "bytes", "h"])
    tracemalloc.start()
    try:
        blocks = [x for out in found.value.value(iter([batch])) for x in out.column("block").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(int((suffix_dedup.unpack(x, suffix_dedup.RUN)[0]["n"]).sum()) for x in blocks) == len(texts) * (3000 - 99)
    assert peak < 100e6


def test_only_windows_with_a_common_side_of_the_anchor_are_pending():
    """Prose of few words shares most 16-byte strings and few 100-byte ones."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeiortnl") for _ in range(rnd.randint(5, 9))) for _ in range(50)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)).encode() for _ in range(300)]
    texts += [t[:150] + texts[0][100:260] + t[150:] for t in texts[1:40]]
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    t, at, n, anchor, n_before, before, after = suffix_dedup.minimizer_runs(data, begin, end)
    runs = np.zeros(len(t), suffix_dedup.RUN)
    for c, v in (("anchor", anchor), ("doc", t), ("lo", at - begin[t]), ("n", n), ("n_before", n_before), ("before", before), ("after", after)):
        runs[c] = v
    runs["whole"] = [hash(data[x : x + k + 99].tobytes()) & (2**64 - 1) for x, k in zip(at.tolist(), n.tolist())]
    first, others = suffix_dedup.settle(runs)
    have = suffix_dedup.shared(first)
    sent = {(d, lo + k) for d, lo, m in zip(have["doc"].tolist(), have["lo"].tolist(), have["n"].tolist()) for k in range(m)}
    where = collections.defaultdict(list)
    for d, lo, m in zip(first["doc"].tolist(), first["lo"].tolist(), first["n"].tolist()):
        for k in range(m):
            where[texts[d][lo + k : lo + k + 100]].append((d, lo + k))
    wanted = {x for v in where.values() if len(v) > 1 for x in v}
    assert wanted and wanted <= sent
    old = first["anchor"][1:] == first["anchor"][:-1]
    pending = first[np.append(False, old) | np.append(old, False)]
    assert (have["n"] + 99).sum() < 0.25 * (pending["n"] + 99).sum()


def test_suffix_dedup_deals_texts_once_and_leaves_no_shuffle_of_a_write(spark, docs):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before = files()
    kept = suffix_dedup.remove_repeats(docs, buckets=3)
    for _ in range(50):  # files go a moment after the write
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    kept.collect()
    assert "ReusedExchange" in kept._jdf.queryExecution().executedPlan().toString()


def test_warc(spark):
    html_ = '<html lang="en"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><p>One<br>two &eacute;</p><a href="/c?d=1">link</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://e.x/p", html_, "extra"), (2, None, None, "e"), (None, "http://e.x/q", "", "e"), (3, "http://e.x/p", "<p>open <b>mark", "e"), (1, "http://e.x/p", html_, "extra")], "page_id long, url string, html string, record string")
    got = warc.derivatives(pages).collect()
    assert len(got) == 10 and len({r.record_id for r in got}) == 8
    for r in got:
        (headers, block), = warc.parse(bytes(r.record))
        h = dict(headers)
        assert h["WARC-Type"] == r.kind and h["WARC-Refers-To"] == r.refers_to and h["WARC-Block-Digest"] == warc.digest(block) and int(h["Content-Length"]) == len(block) == r.content_length
        source, = warc.parse(warc.response(r.page_id, None if r.target_uri.startswith("urn:page") else r.target_uri, next((p.html for p in pages.collect() if p.page_id == r.page_id), None)))
        assert dict(source[0])["WARC-Record-ID"] == r.refers_to and dict(source[0])["WARC-Payload-Digest"] == r.source_payload_digest
    text = {r.page_id: dict(kind=r.kind, block=next(warc.parse(bytes(r.record)))[1]) for r in got if r.kind == "conversion"}
    assert text[1]["block"].decode() == "One\ntwo é\nlink" and text[2]["block"] == b"" and text[3]["block"] == b"open mark"


def test_warc_files_round_trip(spark, tmp_path):
    import gzip

    records = [warc.response(i, f"http://e.x/{i}", f"<p>page {i}</p>") for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[2:])))
    got = warc.read_warc(spark, f"file://{tmp_path}").orderBy("path", "n").collect()
    assert [bytes(r.record) for r in got] == records
    with pytest.raises(ValueError):
        list(warc.parse(records[0][:-3]))


def test_repeated_rows_do_not_crash(spark):
    d = spark.createDataFrame([(1, "some words that stand here twice over and over"), (1, "some words that stand here twice over and over"), (None, "x"), (None, None)], "doc_id long, text string")
    assert license_scan.scan_licenses(d).count() == 4
    assert quality_rules.apply_rules(d).count() == 4
    assert simhash.near_duplicates(d).count() == 4
    assert suffix_dedup.remove_repeats(d, buckets=2).count() == 4
    assert line_dedup.dedup_lines(d, buckets=2).count() == 4
    assert sum(r.length for r in packing.pack_texts(d).collect()) > 4
    assert fingerprints.fingerprint_documents(d, parts=2).count() == 4
    sized = d.withColumn("size", F.lit(3)).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix_copies(sized).count() == 4


def test_columns_with_the_names_of_results_are_replaced(spark):
    d = spark.createDataFrame([(1, "All rights reserved here in some text of twenty words " * 3, "n", "k", "l", "b", "s", 7)], "doc_id long, text string, n_words string, kept string, labels string, _base string, score string, base_failed int")
    r = license_scan.scan_licenses(d).first()
    assert (r.n_words, r.n_base, r.labels, r.kept, r._base) == (30, 3, "reserved", "k", "b") and r.score > 0
    r = quality_rules.apply_rules(d).first()
    assert (r.n_words, r.kept, r.base_failed, r.labels) == (30, False, True, "l")
    model = quality_classifier.train([])
    assert quality_classifier.score_texts(d, model).first().score == 0.5


def test_every_query_has_a_name():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
