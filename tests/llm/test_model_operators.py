"""Language, toxicity, HTML, passages, transport streams, pipeline: accuracy, brute force and odd rows."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindex.llm import html_blocks, html_extraction, labelled_pages, language_id, substring_dedup, toxicity, transport_stream
from tests.llm.test_text_operators import LONG, ODD, VOCABULARY, odd

R = random.Random(7)

# 4

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sche", "ung", "ein", "pfl"], "cc": ["ción", "ado", "ña", "llo"]}


def text_in(lang, words):
    return " ".join("".join(R.choice(SYLLABLES[lang]) for _ in range(R.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, text_in(lang, R.randint(4, 60)), lang) for i, lang in enumerate(R.choices(list(SYLLABLES), k=400))] + [(900, text_in("aa", 9), None), (901, None, "aa"), (902, "12 34", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy(spark, spoken):
    model = language_id.train(spoken, rows=150)
    assert model.languages == ["aa", "bb", "cc"]
    found = language_id.identify_language(spoken, model).filter("lang is not null and doc_id < 900")
    held = found.filter(language_id.is_held_out(F.col("doc_id")))
    assert held.count() > 50 and held.filter("lang = lang_pred").count() / held.count() > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0
    assert {r["doc_id"] for r in held.select("doc_id").collect()} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_rare_languages_are_learned(spark, spoken):
    rare = spark.createDataFrame([(5000 + i, "zzx qqj " * 9, "rare") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(spoken.unionByName(rare), rows=40)
    assert model.languages == ["aa", "bb", "cc", "rare"]


def test_query_predicts_as_naive_cosines_do(spark, spoken, tmp_path):
    """Bundles and cosines summed one n-gram at a time, over all documents that may be learned from."""
    from spindex.llm.queries import op4_language_id

    spoken.write.parquet(f"{tmp_path}/documents.parquet")
    letters, p = language_id.letter_vectors().astype(float), language_id.Profiler()

    def bundle(text):
        codes = [int(p.table[ord(c)]) for c in text or ""]
        codes = [0, *[c for i, c in enumerate(codes) if c or i and codes[i - 1]], 0]
        codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
        v = np.zeros(language_id.DIMENSIONS)
        for i in range(len(codes) - 2):
            v += letters[codes[i]] * np.roll(letters[codes[i + 1]], 1) * np.roll(letters[codes[i + 2]], 2)
        return v / np.linalg.norm(v)

    rows = [r for r in spoken.collect()]
    sums = {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and any(c.isalpha() for c in r["text"] or ""):
            sums[r["lang"]] = sums.get(r["lang"], 0) + bundle(r["text"])
    means = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    common = sum(means.values()) / len(means)
    unit = lambda v: v / np.linalg.norm(v)
    for r, got in zip(sorted(rows, key=lambda r: r["doc_id"]), op4_language_id(spark, str(tmp_path)).orderBy("doc_id").collect()):
        if any(c.isalpha() for c in r["text"] or ""):
            cosine = {k: float(unit(bundle(r["text"]) - common) @ unit(v - common)) for k, v in means.items()}
            assert got["lang_pred"] == max(cosine, key=cosine.get)
            assert got["score"] == pytest.approx(1 / sum(np.exp(language_id.SHARPNESS * (c - max(cosine.values()))) for c in cosine.values()), rel=1e-2)
        else:
            assert (got["lang_pred"], got["score"]) == ("und", 0)


def test_language_odd_rows(spark, spoken):
    model = language_id.train(spoken, rows=100)
    got = language_id.identify_language(odd(spark), model).collect()
    assert len(got) == len(ODD) and all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4)) for r in got)
    assert language_id.identify_language(odd(spark, []), model).count() == 0
    none = language_id.train(spoken.limit(0))
    assert {r["lang_pred"] for r in language_id.identify_language(odd(spark), none).collect()} == {"und"}


def test_bundles_are_sums_of_bound_vectors():
    p = language_id.Profiler()
    v = p.letters.astype(int)
    a, b, blank = v[1], v[2], v[0]
    # " ab ": blank a b, a b blank; a letter's vector is rolled by its place
    want = blank * np.roll(a, 1) * np.roll(b, 2) + a * np.roll(b, 1) * np.roll(blank, 2)
    assert np.array_equal(p.bundles(["...AB!"])[0][0], want)


# 6


def toxic_rows(n):
    rows, labels = [], []
    for i in range(n):
        words = R.sample(VOCABULARY, R.randint(5, 60))
        insult, group = R.random() < 0.4, R.random() < 0.4
        words += [R.choice(["vile", "scummy"])] * insult + [R.choice(["clerks", "pilots"])] * group
        R.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    """Neither an insult nor a group is toxic alone: no additive weights tell them apart at one half."""
    rows, labels = toxic_rows(1500)
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    scored = toxicity.score_toxicity(docs, model).join(truth.dropna(), "doc_id").filter(toxicity.is_held_out(F.col("doc_id")))
    wrong = scored.filter((F.col("score") >= 0.5) != (F.col("toxic") == 1)).count()
    assert scored.count() > 200 and wrong / scored.count() < 0.03
    both = [model.terms[t] for w in (b"vile", b"pilots") for t in toxicity.word_terms(w) if t in model.terms]
    assert model.score(both) > 0.5 and model.factors[both].any()


def test_machine_against_a_naive_double_sum():
    r = np.random.default_rng(4)
    m = toxicity.FactorizationMachine({i: i for i in range(12)}, -0.3, r.normal(size=12), r.normal(size=(12, 5)))
    for n in range(12):
        places = sorted(r.choice(12, n, replace=False).tolist())
        z = -0.3 + sum(m.weights[i] for i in places) + sum(sum(a * b for a, b in zip(m.factors[i], m.factors[j])) for i in places for j in places if i < j)
        assert m.score(places) == pytest.approx(1 / (1 + np.exp(-z)))


def test_query_scores_as_a_naive_machine_does(spark, tmp_path):
    from spindex.llm.queries import op6_toxicity

    rows, labels = toxic_rows(300)
    docs, truth = spark.createDataFrame(rows + [(9000, None), (9001, LONG)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    truth.write.parquet(f"{tmp_path}/labels.parquet")
    model, texts = toxicity.train(docs, truth), dict(rows) | {9000: "", 9001: LONG}
    for r in op6_toxicity(spark, str(tmp_path)).collect():
        terms = {t for w in texts[r["doc_id"]].split() for t in toxicity.word_terms(w.encode()) if t in model.terms}
        places = [model.terms[t] for t in terms]
        z = model.bias + sum(model.weights[i] for i in places) + sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(places) for j in places[:n])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    rows, labels = toxic_rows(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = docs.unionByName(spark.range(50_000).selectExpr("id % 3 AS doc_id", "concat('vile ', id % 7) AS text"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda terms, x, y, prior: seen.append(len(x)))
    toxicity.train(many, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(60))]


def test_toxicity_odd_rows(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == sum(r["score"] < 0.5 for r in got) >= len(ODD) - 1
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(odd(spark, []), none).count() == 0 and toxicity.drop_toxic(odd(spark), none).count() == len(ODD)


# 8

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>A title</h1><p><b>First  line &amp; more.<br><p>Second
paragraph is <a href='/x'>linked</a> here, and goes on.</p><script>var t="<p>x</p>";</script><p>Third one &lt;tag&gt;.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this.</p></div></div><form class="newsletter"><label>Mail</label><button>Send</button></form>
<footer>&copy; Us</footer>"""


def test_extraction():
    model = html_extraction.default_model()
    assert html_extraction.main_text(PAGE, model) == "A title\nFirst line & more.\nSecond paragraph is linked here, and goes on.\nThird one <tag>."


def test_viterbi_against_all_paths():
    import itertools

    model = html_extraction.default_model()
    for page, _ in labelled_pages.labelled_pages(12, seed=5):
        found = html_blocks.blocks(page)[:9]
        e = [model.emission(b) for b in found]

        def score(path):
            return model.first[path[0]] + model.last[path[-1]] + sum(x[y] for x, y in zip(e, path)) + sum(model.step[a][b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(found)), key=score)
        assert score(best) == pytest.approx(score(model.decode(found)))


@pytest.mark.parametrize("page", ["", "<", "<p", "text only", "<p>a<p>b", "</div></p>x", "<script>unclosed", "<a href='x>", "<!-- open", "&am &copy x &#x41; &#999999999;", "<div " * 300, "<p>" * 2000 + "x", "a<b<c"])
def test_malformed_pages_parse(page):
    for b in html_blocks.blocks(page):
        assert b.text == " ".join(b.text.split()) and b.text


def test_extraction_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "A long sentence stands here. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit(1))
    got = html_extraction.extract_text(df).collect()
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert html_extraction.extract_text(df.limit(0)).count() == 0


# 5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    r = np.random.default_rng(8)
    for _ in range(600):
        a = r.integers(0, r.choice([2, 5, 40]), r.integers(0, 40))
        b = a.tolist()
        for _ in range(r.integers(0, 8)):
            p = int(r.integers(0, len(b) + 1))
            b[p : p + int(r.integers(0, 2))] = [int(x) for x in r.integers(0, 40, r.integers(0, 2))]
        b = np.array(b, int)
        want = levenshtein(a.tolist(), b.tolist())
        assert substring_dedup.edit_distance(a, b, 99) == want and substring_dedup.edit_distance(a, b, 3) == min(4, want)


def test_edit_distance_of_many_edits():
    r = np.random.default_rng(11)
    for kinds in (1, 3, 40, 100_000):
        for _ in range(15):
            a = r.integers(0, kinds, r.integers(60, 200)).tolist()
            b = list(a)
            for _ in range(r.integers(1, 4)):
                p, n = int(r.integers(0, len(b) + 1)), int(r.integers(0, 50))
                b[p : p + n * int(r.integers(0, 2))] = r.integers(0, kinds, n * int(r.integers(0, 2))).tolist()
            want, x, y = levenshtein(a, b), np.array(a, int), np.array(b, int)
            for most in (500, want, max(0, want - 1), 30):
                assert substring_dedup.edit_distance(x, y, most) == min(want, most + 1)


def test_passage_with_a_paragraph_moved_out_and_another_put_in(spark):
    words = [f"m{R.randrange(10**6)}" for _ in range(400)]
    copy = words[:100] + [f"n{R.randrange(10**6)}" for _ in range(30)] + words[100:300] + words[330:]
    found = substring_dedup.repeated_passages(odd(spark, [(6000, " ".join(words)), (6001, " ".join(copy))])).collect()
    assert [(r["start"], r["end"], r["edits"]) for r in found] == [(0, 400, 60)]


def test_best_chain_against_brute_force():
    import itertools

    r = random.Random(9)
    for _ in range(200):
        anchors = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randint(2, 8))})
        x, y = [a for a, _ in anchors], [b for _, b in anchors]

        def score(c):
            return len(c) - substring_dedup.GAP * sum(x[j] - x[i] + y[j] - y[i] for i, j in zip(c, c[1:]))

        best = max((score(c) for n in range(1, len(x) + 1) for c in itertools.combinations(range(len(x)), n) if all(x[i] < x[j] and y[i] < y[j] for i, j in zip(c, c[1:]))), default=0)
        found = substring_dedup.chains(x, y)
        assert best <= 1 or best == pytest.approx(score(found[0]))
        used = [i for c in found for i in c]
        assert len(used) == len(set(used)) and all(x[i] < x[j] and y[i] < y[j] for c in found for i, j in zip(c, c[1:]))


def passage_rows():
    passages = [[R.choice(VOCABULARY) for _ in range(60)] for _ in range(4)]
    rows, holders = [], {}
    for i in range(160):
        words, k = [R.choice(VOCABULARY) for _ in range(R.randint(30, 300))], R.randrange(8)
        if k < 4:
            passage = list(passages[k])
            for _ in range(i % 3 * 2):
                passage[R.randrange(60)] = R.choice(VOCABULARY)
            at = R.randrange(len(words))
            words[at:at] = passage
            holders.setdefault(k, set()).add(i + 100)
        rows.append((i + 100, " ".join(words)))
    return rows, holders


def test_passages(spark):
    rows, holders = passage_rows()
    texts = dict(rows)
    found = substring_dedup.repeated_passages(odd(spark, ODD + rows).repartition(5)).collect()
    group = {d: d for d in texts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for r in found:
        a, b = texts[r["doc_id"]].split()[r["start"] : r["end"]], texts[r["other_id"]].split()[r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 40 and levenshtein(a, b) == r["edits"] <= 0.2 * max(len(a), len(b))
        assert any({r["doc_id"], r["other_id"]} <= own for own in holders.values())
        group[root(r["doc_id"])] = root(r["other_id"])
    assert all(len({root(d) for d in own}) == 1 for own in holders.values())


def test_passages_odd_rows(spark):
    rows = [(50, LONG), (50, LONG), (51, "Before. " + LONG.upper()), (None, LONG), (52, None)]
    found = substring_dedup.repeated_passages(odd(spark, rows)).collect()
    assert [(r["doc_id"], r["other_id"], r["edits"], r["end"] - r["start"]) for r in found] == [(51, 50, 0, 12_000)]
    assert substring_dedup.repeated_passages(odd(spark, [])).count() == 0


def test_passages_parted_by_other_words(spark):
    rows, want, at = [], {}, 5000
    for size, gaps in ((55, (30, 60, 100)), (80, (60, 200)), (120, (100, 300))):
        for gap in gaps:
            first, second = ([f"w{R.randrange(10**6)}" for _ in range(size)] for _ in range(2))
            for d in (at, at + 1):
                rows.append((d, " ".join([*first, *(f"g{R.randrange(10**6)}" for _ in range(gap)), *second])))
            want[at + 1] = [(0, size), (size + gap, 2 * size + gap)]
            at += 2
    found = substring_dedup.repeated_passages(odd(spark, rows)).collect()
    got = {d: sorted((r["start"], r["end"]) for r in found if r["doc_id"] == d and r["edits"] == 0) for d in want}
    assert got == want and len(found) == 2 * len(want)


def test_passages_of_lines_that_others_hold_alone(spark):
    rows, pairs, at = [], set(), 10_000
    for lines, alone in ((2, 20), (2, 20), (2, 60), (3, 60)):
        shared = [[f"l{R.randrange(10**6)}" for _ in range(26)] for _ in range(lines)]
        held = [[line] for line in shared for _ in range(alone)] + [shared, shared]
        R.shuffle(held)
        for i, own in enumerate(held):
            words = [[f"o{R.randrange(10**6)}" for _ in range(20)] for _ in range(2)]
            rows.append((at + i, " ".join([*words[0], *sum(own, []), *words[1]])))
        pairs.add((max(both := [at + i for i, own in enumerate(held) if own is shared or len(own) > 1]), min(both), 26 * lines))
        at += 1000
    found = substring_dedup.repeated_passages(odd(spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"], r["end"] - r["start"]) for r in found if r["edits"] == 0} == pairs


def test_periodic_passages(spark):
    def own(n):
        return [f"p{R.randrange(10**6)}" for _ in range(n)]

    line = own(7)
    kinds = {20_000: lambda n: ["of"] * (50 + n), 21_000: lambda n: own(10) + ["de"] * 10 + own(10) + ["de"] * 50, 22_000: lambda n: line * (8 + n), 23_000: lambda n: ["x", "y"] * (25 + n)}
    rows = [(at + i, " ".join([*own(R.randrange(30)), *make(i % 3), *own(20)])) for at, make in kinds.items() for i in range(8)]
    texts = {d: t.split() for d, t in rows}
    found = substring_dedup.repeated_passages(odd(spark, rows).repartition(3)).collect()
    group = {d: d for d in texts}
    for r in found:
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert r["doc_id"] // 1000 == r["other_id"] // 1000 and min(len(a), len(b)) >= 40 and levenshtein(a, b) == r["edits"] <= 0.2 * max(len(a), len(b))
        old, new = group[r["doc_id"]], group[r["other_id"]]
        group = {d: new if g == old else g for d, g in group.items()}
    assert len(set(group.values())) == len(kinds)


def test_repeats():
    seed, at = np.array([5, 5, 9, 5, 9, 5, 5], np.uint64), np.array([0, 3, 4, 6, 8, 20, 21])
    hashes, places = substring_dedup.repeats(seed, at)
    assert sorted(places.tolist()) == [3, 6, 8, 20, 21] and len(set(hashes.tolist())) == 5
    moved, _ = substring_dedup.repeats(seed[:4], at[:4] + 100)
    assert set(moved.tolist()) < set(hashes.tolist())


# 10


def test_streams_round_trip():
    r = np.random.default_rng(10)
    for n in [*range(0, 800, 3), 16_383, 16_384, 16_385, 140_000]:
        data = transport_stream.padded(r.bytes(n))
        d = transport_stream.demux(transport_stream.mux(data))
        assert d.first.payload == data and len(data) % 64 == 0 and len(data) >= max(64, n)
        assert (d.sync_errors, d.counter_errors, d.crc_errors, d.first.broken_units) == (0, 0, 0, 0)
        assert d.first.timestamps == d.first.decode_timestamps == [i * 3600 for i in range(len(d.first.timestamps))] and d.first.random_access == list(range(0, len(d.first.timestamps), 8))
        assert d.programs == {1: 0x1000} and {p: x.kind for p, x in d.streams.items()} == {0x100: 6}
        assert d.clocks == [i * 3600 for i in d.first.random_access]


def test_stream_faults_are_counted():
    stream = transport_stream.mux(bytes(range(256)) * 200)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    lost = transport_stream.demux(b"".join(packets[:10] + packets[11:]))
    assert lost.counter_errors == 1 and lost.first.broken_units == 1
    repeated = transport_stream.demux(b"".join(packets[:10] + packets[9:]))
    assert repeated.counter_errors == 0 and repeated.first.payload == bytes(range(256)) * 200
    torn = bytearray(packets[0])
    torn[10] ^= 1
    assert transport_stream.demux(bytes(torn) + b"".join(packets[1:])).crc_errors == 1
    assert transport_stream.demux(b"").packets == 0 and transport_stream.demux(b"x" * 200).sync_errors == 2
    assert transport_stream.section_crc(b"123456789") == 0x0376E6E7


class Writer:
    """Packets by the letter of the format, one at a time, apart from the library's writer."""

    def __init__(self):
        self.counters, self.out = {}, []

    def crc(self, data):
        c = 0xFFFFFFFF
        for byte in data:
            for k in range(8):
                c = (c << 1 ^ (0x04C11DB7 if (c >> 31 ^ byte >> (7 - k)) & 1 else 0)) & 0xFFFFFFFF
        return c.to_bytes(4, "big")

    def packet(self, pid, start, body, flags=None, extra=b""):
        n = self.counters[pid] = (self.counters.get(pid, -1) + 1) % 16
        room = 184 - len(body)
        field = b""
        if flags is not None or room:
            inner = (bytes([flags or 0]) + extra) if flags is not None or room > 1 else b""
            field = inner + b"\xff" * (room - 1 - len(inner))
            field = bytes([len(field)]) + field
        assert len(field) + len(body) == 184
        self.out.append(bytes([0x47, start << 6 | pid >> 8, pid & 255, (0x30 if field else 0x10) | n]) + field + body)

    def carry(self, pid, data, flags=None, extra=b""):
        first = True
        while data or first:
            most = 184 - (2 + len(extra) if first and flags is not None else 0)
            body, data = data[:most], data[most:]
            self.packet(pid, first, body, flags if first else None, extra if first else b"")
            first = False

    def section(self, table, key, body):
        s = bytes([table, 0xB0 | (9 + len(body)) >> 8, 9 + len(body) & 255]) + key.to_bytes(2, "big") + b"\xc1\0\0" + body
        return s + self.crc(s)

    def table(self, pid, *sections):
        data = b"\0" + b"".join(sections)
        data += b"\xff" * (-len(data) % 184)
        for i in range(0, len(data), 184):
            self.packet(pid, i == 0, data[i : i + 184])

    def stamp(self, mark, t):
        v = mark << 36 | (t >> 30 & 7) << 33 | 1 << 32 | (t >> 15 & 0x7FFF) << 17 | 1 << 16 | (t & 0x7FFF) << 1 | 1
        return v.to_bytes(5, "big")

    def unit(self, stream_id, data, pts=None, dts=None, sized=True):
        head = b"" if pts is None else self.stamp(2 if dts is None else 3, pts) + (b"" if dts is None else self.stamp(1, dts))
        body = bytes([0x80, 0 if pts is None else 0x80 if dts is None else 0xC0, len(head)]) + head + data
        return b"\0\0\1" + bytes([stream_id]) + (len(body) if sized else 0).to_bytes(2, "big") + body


def other_writers_stream():
    w, r = Writer(), np.random.default_rng(20)
    video, audio = [r.bytes(int(n)) for n in (70_000, 5, 900, 90_000)], [r.bytes(int(n)) for n in (300, 184, 2000)]
    w.table(0, w.section(0, 7, b"\0\0\xe0\x10" + b"\0\2\xe3\0"))  # a network table, and program 2 at 0x300
    info = b"\x05\xf0" + bytes([240]) * 240
    streams = b"\x1b\xe0\x51" + bytes([0xF0, 200]) + bytes(200) + b"\x0f\xe0\x52\xf0\0"
    w.table(0x300, w.section(2, 2, b"\xe0\x51" + (0xF000 | len(info)).to_bytes(2, "big") + info + streams))  # over several packets
    for n, x in enumerate(video):
        w.carry(0x51, w.unit(0xE0, x, 90_000 + n * 3600, 86_400 + n * 3600, sized=False), *((0x50, ((n * 3600) << 15 | 0x7E00).to_bytes(6, "big")) if n in (0, 3) else ()))
        if n < 3:
            w.carry(0x52, w.unit(0xC0, audio[n], 90_000 + n * 1920))
        if n == 1:
            w.carry(0x52, b"\0\0\1\xbe\0\x08" + b"\xff" * 8)  # padding
            w.packet(0x1FFF, 0, bytes(184))
    return w, video, audio


def test_streams_of_another_writer():
    w, video, audio = other_writers_stream()
    d = transport_stream.demux(b"".join(w.out))
    assert d.programs == {2: 0x300} and {p: (s.kind, s.program) for p, s in d.streams.items()} == {0x51: (0x1B, 2), 0x52: (0x0F, 2)}
    v, a = d.streams[0x51], d.streams[0x52]
    assert v.payload == b"".join(video) and a.payload == b"".join(audio)
    assert v.timestamps == [90_000 + n * 3600 for n in range(4)] and v.decode_timestamps == [86_400 + n * 3600 for n in range(4)]
    assert a.timestamps == a.decode_timestamps == [90_000 + n * 1920 for n in range(3)] and a.starts == [0, 300, 484]
    assert v.random_access == [0, 3] and d.clocks == [0, 10_800] and v.starts == [0, 70_000, 70_005, 70_905]
    assert (d.sync_errors, d.counter_errors, d.crc_errors, v.broken_units, a.broken_units) == (0, 0, 0, 0, 0)


def test_faults_of_another_writers_stream():
    w, video, audio = other_writers_stream()
    first = next(i for i, p in enumerate(w.out) if (p[1] & 0x1F, p[2]) == (0, 0x51))
    lost = transport_stream.demux(b"".join(w.out[: first + 3] + w.out[first + 4 :]))
    assert lost.counter_errors == 1 and lost.streams[0x51].broken_units == 1 and lost.streams[0x51].payload == b"".join(video[1:]) and lost.streams[0x52].payload == b"".join(audio)
    table = next(i for i, p in enumerate(w.out) if (p[1] & 0x1F, p[2]) == (3, 0))
    cut = transport_stream.demux(b"".join(w.out[: table + 1] + w.out[table + 2 :]))
    assert cut.counter_errors == 1 and cut.crc_errors == 1 and not cut.streams
    told, told_at = Writer(), 9
    told.table(0, told.section(0, 7, b"\0\2\xe3\0"))
    told.table(0x300, told.section(2, 2, b"\xe0\x51\xf0\0\x1b\xe0\x51\xf0\0"))
    told.carry(0x51, told.unit(0xE0, b"a" * 100, 1, sized=False))
    told.counters[0x51] = told_at
    told.carry(0x51, told.unit(0xE0, b"b" * 100, 2, sized=False), 0x80)
    d = transport_stream.demux(b"".join(told.out))
    assert d.counter_errors == 0 and d.streams[0x51].payload == b"a" * 100 + b"b" * 100


def test_stream_columns(spark):
    got = transport_stream.read_transport_stream(transport_stream.to_transport_stream(odd(spark))).collect()
    texts = sorted(transport_stream.padded((t or "").encode()) for _, t in ODD)
    assert sorted(bytes(r["payload"]) for r in got) == texts and all(r["units"] == len(r["timestamps"]) and r["other_streams"] == [] for r in got)
    assert transport_stream.to_transport_stream(odd(spark, [])).count() == 0
    w, video, audio = other_writers_stream()
    media = spark.createDataFrame([(1, bytearray(b"".join(w.out))), (2, None), (3, bytearray(b"junk"))], "id long, media binary").withColumn("payload", F.lit("clash"))
    rows = {r["id"]: r for r in transport_stream.read_transport_stream(media).collect()}
    assert bytes(rows[1]["payload"]) == b"".join(video) and rows[1]["stream_pid"] == 0x51 and rows[1]["table_pid"] == 0x300 and rows[1]["program"] == 2
    other = rows[1]["other_streams"]
    assert len(other) == 1 and bytes(other[0]["payload"]) == b"".join(audio) and other[0]["timestamps"] == [90_000, 91_920, 93_840]
    assert all(bytes(rows[i]["payload"]) == b"" and rows[i]["stream_pid"] is None and rows[i]["other_streams"] == [] for i in (2, 3))


def test_query_of_streams_against_plain_python(spark, tmp_path):
    import hashlib

    from spindex.llm.queries import op10_transport_stream

    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in ODD:
        data = (t or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        media = transport_stream.mux(payload)
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    got = [tuple(r)[:7] for r in op10_transport_stream(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# Pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = toxic_rows(1400)
    bench = " ".join(f"b{i}" for i in range(40))
    planted = [(5000, rows[5][1]), (5001, bench), (5002, " ".join(f"long{i % 4999}" for i in range(12_000)) + " token=abcdef0123456789abcdef012345 end"), (5003, None), (5004, ""), (None, "without an id " * 5), (5003, None)]
    every = [(d, t, "en", None, len(t or "")) for d, t in rows + planted]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {d for d, x in labels if x}
    assert len(toxic & set(seen["toxicity"])) < 0.1 * len(toxic) and len(set(seen["toxicity"]) - toxic) > 0.97 * (len(rows) - len(toxic))
    assert 5000 not in seen["near_dedup"] or 5 not in seen["toxicity"]
    assert {5003, 5004} & set(seen["near_dedup"]) == {5003} and None in seen["near_dedup"]
    assert 5001 in seen["near_dedup"] and 5001 not in seen["decontamination"] and 5002 in seen["decontamination"]
    assert "abcdef0123" not in seen["secrets"][5002] and seen["secrets"].keys() == seen["decontamination"].keys()
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == set(seen["secrets"])
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == set(seen["secrets"])


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage in plain Python, over a small corpus with copies, benchmark passages and secrets."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import FILES, brute_simhash, brute_windows, naive_redacted, naive_spans
    from tokenizers import Tokenizer

    from spindex.llm import decontamination, secrets

    rows, labels = toxic_rows(500)
    item = [f"b{i}" for i in range(60)]
    more = []
    for i in range(40):
        words = [f"q{R.randrange(10**6)}" for _ in range(R.randint(80, 200))]
        if i % 4 == 1:
            at = R.randrange(40)
            words[30:30] = item[at : at + 14]
        if i % 5 == 2:
            words[7:7] = ["token=Zk8" + "".join(R.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=30)), "x"]
        more.append((1000 + 10 * i, " ".join(words)))
        for k in range(i % 3):
            copy = list(words)
            copy[R.randrange(len(copy))] = f"q{R.randrange(10**6)}"
            more.append((1001 + 10 * i + k, " ".join(copy)))
    docs = [(d, t, len(t)) for d, t in rows + more] + [(9000, None, None), (9001, "", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    machine = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    terms = toxicity.Terms(machine.terms)
    kept = [(d, t) for d, t, _ in docs if machine.score(terms(t)) < 0.5]
    assert len(docs) - 0.3 * len(rows) < len(kept) < len(docs)
    kept = [(d, t) for (d, t), (_, _, c) in zip(kept, brute_simhash(kept)) if d == c]

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in kept}
    gone = {d for d, _ in kept if sets[d] and any(e < d and sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e, _ in kept)}
    assert any(d > 1000 for d in gone) and not any(d < 1000 for d in gone)
    model = secrets.train(secrets.labelled_strings(spark).unionByName(secrets.ordinary_words(spark.createDataFrame(kept, "doc_id long, text string"))))
    want, cut, masked = {}, 0, 0
    for d, t in kept:
        if d in gone:
            continue
        words = decontamination.words_of((t or "").encode())
        hit, _ = brute_windows([(1, [w.encode() for w in item])], words, 13)
        if hit and 20 * len(hit) >= len(words):
            cut += 1
            continue
        if hit:
            spans = [(i, i + 1) for i in sorted(hit)]
            t = decontamination.without_spans(t.encode(), decontamination.merged(spans)).decode()
        spans = naive_spans(t or "", model)
        masked += bool(spans)
        want[d] = naive_redacted(t, spans) if spans else t or ""
    assert cut > 3 and masked > 3
    encode = Tokenizer.from_file(FILES[0]).encode
    pieces = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert pieces.keys() == want.keys()
    for d, text in want.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[d])), "<u4").tolist()
        assert ids == [*encode(text, add_special_tokens=False).ids, 1], d


def test_near_dedup_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for i in range(30):
        words = [f"d{R.randrange(10**6)}" for _ in range(R.randint(60, 200))]
        rows.append((30_000 + 10 * i, " ".join(words)))
        for k in range(1, 4):
            copy = list(words)
            for _ in range(k):
                copy[R.randrange(len(copy))] = f"d{R.randrange(10**6)}"
            rows.append((30_000 + 10 * i + k, " ".join(copy)))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def near(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, odd(spark, rows), "").collect()}
    sets = {d: shingles(t) for d, t in rows}
    assert {30_000 + 10 * i for i in range(30)} <= kept
    assert not any(near(sets[a], sets[b]) for a in kept for b in kept if a < b)


def test_near_copies_stay_apart_and_do_not_depend_on_partitions(spark):
    """Chains of copies of copies, families of texts that are alike by less, and repeated texts."""
    from spindex.llm import near_copies

    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for k in range(25):
            words = list(base) if family % 2 else list(rows[-1][1].split()) if k else list(base)
            for _ in range(R.choice([0, 1, 2, 4] if family % 2 else [1])):
                words[R.randrange(len(words))] = f"x{R.randrange(10**6)}"
            rows.append((1000 * family + R.randrange(1000), " ".join(words)))
    rows = list(dict(rows).items()) + [(9001, ""), (9002, None), (9003, "a b"), (9004, "a b"), (None, "a b"), (None, "a b")]

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def near(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    kept = []
    for parts in (1, 7):
        df = odd(spark, rows).repartition(parts)
        kept.append(sorted(r["doc_id"] or 0 for r in near_copies.drop_near_copies(df).collect()))
    assert kept[0] == kept[1]
    own = {d: sets(t or "") for d, t in rows if d is not None}
    stay = [d for d in kept[0] if d and own[d]]
    assert not any(near(own[a], own[b]) for a in stay for b in stay if a < b)
    assert all(any(e < d and near(own[d], own[e]) for e in own if own[e]) for d in own if own[d] and d not in stay)
    assert {9001, 9002, 9003} <= set(kept[0]) and kept[0].count(0) == 2 and 9004 not in kept[0]
    assert near_copies.drop_near_copies(odd(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op3_licenses", "op7_decontamination"])
def test_against_sql(spark, name):
    import duckdb

    from spindex.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())


def test_seed_links_do_not_depend_on_batches(spark):
    rows = [(R.randrange(12), R.randrange(9), R.randrange(5)) for _ in range(400)]
    rows = sorted(set(rows))
    seeds = spark.createDataFrame([(h, d, p, None, None) for h, d, p in rows], substring_dedup.SEEDS)

    def links(batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        return sorted((r["doc"], r["pos"], r["center"], r["center_pos"]) for r in substring_dedup.shared_links(seeds).collect())

    one_by_one, whole = links(1), links(10_000)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for h in range(12):
        own = [(d, p) for x, d, p in rows if x == h]
        for before, (d, p) in zip(own, own[1:]):
            want += [(d, p, *own[0])] if d != own[0][0] else []
            want += [(d, p, *before)] if d != before[0] != own[0][0] else []
    assert one_by_one == whole == sorted(want)


def test_word_hashes(monkeypatch):
    from spindex.llm.decontamination import words_of

    texts = [b"", b"One two, one.", b"  ", "Ünï two-TWO".encode(), b"a" * 9000 + b" b", b"one", b"x y z " * 700, b"".join(bytes([c]) for c in range(256))]
    for chunk in (1 << 19, 50):
        monkeypatch.setattr(substring_dedup, "_CHUNK", chunk)
        known: dict[bytes, int] = {}
        got = list(substring_dedup.word_hashes(texts))
        for t, h in zip(texts, got, strict=True):
            assert len(h) == len(words_of(t))
            for w, x in zip(words_of(t), h.tolist()):
                assert known.setdefault(w, x) == x
        assert len(set(known.values())) == len(known) > 8


def exact_runs(a, b, least):
    """Maximal stretches of `least` equal words or more, as (start in a, start in b, length)."""
    out, places = [], {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    for i in range(len(a)):
        for j in places.get(a[i], []):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return out


def groups_of(rows, docs):
    group = {d: d for d in docs}
    for r in rows:
        old, new = group[r["doc_id"]], group[r["other_id"]]
        group = {d: new if g == old else g for d, g in group.items()}
    return sorted(sorted(d for d in docs if group[d] == g) for g in set(group.values()))


def test_query_against_brute_force_in_any_layout(spark, tmp_path):
    """Every stretch of over 50 equal words of two documents lies in rows of both, that are
    within the edits allowed, and the groups are the same in 1, 4 and 16 partitions."""
    from spindex.llm.queries import op5_substring_dedup

    r = random.Random(5)
    fresh = lambda n: [f"b{r.randrange(10**7)}" for _ in range(n)]
    passages = [fresh(r.choice([51, 70, 150, 400])) for _ in range(12)]
    docs = {}
    for d in range(90):
        words = fresh(r.randint(5, 120))
        for i in r.sample(range(12), r.choice([0, 1, 1, 2, 3])):
            p, kind = list(passages[i]), r.random()
            if kind < 0.3:
                p = p[: r.randint(51, len(p))]
            elif kind < 0.5:
                for _ in range(len(p) // 12):
                    at = r.randrange(len(p))
                    p[at : at + r.randint(0, 1)] = fresh(r.randint(0, 2))
            words += p + fresh(r.randint(0, 150))
        docs[300 + d] = words
    for n, (gap, size) in enumerate(((30, 1000), (60, 1000), (150, 1000), (30, 5000), (60, 5000), (150, 5000))):  # a part moved out, another put in
        base = fresh(size)
        docs[1000 + 2 * n], docs[1001 + 2 * n] = base, base[: size // 4] + fresh(gap) + base[size // 4 : size // 2] + base[size // 2 + gap :]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    seen = []
    for parts in (1, 4, 16):
        path = tmp_path / str(parts)
        df.repartition(parts).write.parquet(f"{path}/documents.parquet")
        found = op5_substring_dedup(spark, str(path)).collect()
        seen.append(groups_of(found, docs))
        covered = {}
        for row in found:
            a, b = docs[row["doc_id"]][row["start"] : row["end"]], docs[row["other_id"]][row["other_start"] : row["other_end"]]
            if parts == 1:
                assert min(len(a), len(b)) >= 40 and levenshtein_of(a, b) == row["edits"] <= 0.2 * max(len(a), len(b))
            covered.setdefault(row["doc_id"], set()).update(range(row["start"], row["end"]))
            covered.setdefault(row["other_id"], set()).update(range(row["other_start"], row["other_end"]))
        ids = sorted(docs)
        for i, x in enumerate(ids):
            for y in ids[:i]:
                for a, b, n in exact_runs(docs[x], docs[y], 51):
                    for d, at in ((x, a), (y, b)):  # whole, but for words at its ends that another holder has edited
                        missed = sorted(set(range(at, at + n)) - covered.get(d, set()))
                        assert len(missed) <= 0.1 * n and all(w < at + 12 or w >= at + n - 12 for w in missed), (parts, x, y, d, at, n, missed)
        for n in range(6):
            whole = [x for x in found if x["doc_id"] == 1001 + 2 * n]
            gap, size = ((30, 1000), (60, 1000), (150, 1000), (30, 5000), (60, 5000), (150, 5000))[n]
            if 2 * gap <= 0.2 * size:  # else its equal parts, as above
                assert [x["edits"] for x in whole] == [2 * gap]
    assert seen[0] == seen[1] == seen[2]


def levenshtein_of(a, b):
    """The same as `levenshtein`, a row at a time for long sequences."""
    ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([ids[w] for w in a]), np.array([ids[w] for w in b])
    row, steps = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        best = np.r_[i, np.minimum(row[:-1] + (y != w), row[1:] + 1)]
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])
