"""The corpus operators on small tables: against plain versions of what they compute, and on tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import decontaminate, fixity, language, lines, near, packing, passages, quality, simhash, toxicity
from proofmill.llm.packing import pack_histogram
from proofmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_draw = random.Random(3)
WORDS = ["".join(_draw.choice("abcdefghijklmnop") for _ in range(_draw.randint(2, 8))) for _ in range(400)]


def prose(n, draw=_draw):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def frame(spark, texts, first=0):
    rows = [(k, t, "xx", "s", None if t is None else len(t)) for k, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def altered(text, share, draw=_draw):
    ws = text.split(" ")
    for i in draw.sample(range(len(ws)), int(len(ws) * share)):
        ws[i] = "zz" + ws[i]
    return " ".join(ws)


@pytest.fixture(scope="module")
def copies():
    """Texts with exact copies, near copies on both sides of the threshold, and odd ones."""
    base = [prose(120) for _ in range(12)]
    out = base + [base[0], base[1]] + [altered(b, s) for b in base[:6] for s in (0.01, 0.02, 0.03, 0.05, 0.08)]
    return out + [None, "", "  \t\n ", "one", "ONE", "one two", "word " * 300, "word " * 301, prose(5000), base[2].upper()]


#: Names that operators use within.
ODD_COLUMNS = ", id bigint, mark string, key string, n bigint" + "".join(f", {x} int" for x in ("later", "gone_id", "gone_doc", "gone_mark", "spans", "cut_id", "cut_mark", "row"))
ODD = [None, "", " ", "\n\n", "x", "é" * 5, "a\x00b", "line\nline\nline", "🙂 🙂 🙂", "word " * 20000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null and repeated ids, repeated rows, and columns with clashing names."""
    rows = [(None if k == 4 else k % 8, t, None if k % 3 else "en", None, None, 1, "x", "y", 2) for k, t in enumerate(ODD)]
    rows = [(*r, *[3] * 8) for r in rows]
    return spark.createDataFrame([*rows, rows[1], rows[5]], DOCS + ODD_COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + ODD_COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")


# packing


def test_packing_keeps_every_id(spark, copies):
    rows = packing.pack(frame(spark, copies), 64).collect()
    encode = packing.Encoder(packing.default_vocabulary())
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    for d, text in enumerate(copies):
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        assert encode(text or "").tolist() == ids[:-1]
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 64


def test_packing_histogram_is_tight():
    draw = random.Random(1)
    counts = {n: draw.randint(0, 40) for n in range(1, 101)}
    counts = {k: v for k, v in counts.items() if v}
    places, sequences = pack_histogram(counts, 100)
    assert {k: sum(p[2] for p in places if p[0] == k) for k in counts} == counts
    assert sequences <= 1.08 * sum(k * v for k, v in counts.items()) / 100 + 1


def test_packing_of_many_short_pieces_wastes_little():
    counts = {n: 2000 // n for n in range(1, 101)}
    _, sequences = pack_histogram(counts, 100)
    assert sequences <= 1.02 * sum(k * v for k, v in counts.items()) / 100 + 1


# near-duplicates


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, copies, k, percent):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_groups(frame(spark, copies), k, percent).collect()}
    assert found == brute.near(list(enumerate(copies)), k, percent)


def test_near_groups_that_leaders_do_not_join(spark):
    """Many texts near a threshold around one: links across components, some of which only blocks find."""
    draw = random.Random(8)
    base = prose(150, draw).split(" ")
    texts = []
    for k in range(60):
        ws = list(base)
        for i in draw.sample(range(len(ws)), 2 + k % 5):
            ws[i] = f"q{draw.randint(0, 10**6)}"
        texts.append(" ".join(ws))
    found = {r["doc_id"]: r["component_id"] for r in near.near_groups(frame(spark, texts), 3, 85).collect()}
    assert found == {d: c for d, (_, c) in brute.near(list(enumerate(texts)), 3, 85).items()}


def test_keep_one(spark, copies):
    kept = {r["doc_id"] for r in near.keep_one(frame(spark, copies)).collect()}
    assert kept == {d for d, (_, c) in brute.near(list(enumerate(copies)), 5, 80).items() if c == d}


# lines


@pytest.fixture(scope="module")
def lined():
    draw = random.Random(2)
    pool = [prose(draw.randint(1, 90), draw) for _ in range(40)] + ["", "  ", "a", "a b"]
    near_ = [altered(p, s, draw) for p in pool[:20] for s in (0.05, 0.1, 0.2, 0.3)]
    out = ["\n".join(draw.choice(pool + near_) + draw.choice(["", "", "\t", " \r"]) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    hot = prose(60, draw)
    return out + [altered(hot, 0.04, draw) for _ in range(40)] + [None, "", "\n", "A b\na B"]


def test_lines(spark, lined):
    expected = brute.lines(list(enumerate(lined)), 80)
    found = {r["doc_id"]: r["removed"] for r in lines.decide(frame(spark, lined)).collect()}
    assert found == {d: ",".join(map(str, v)) for d, v in expected.items()}
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup(frame(spark, lined)).collect()}
    for d, text in enumerate(lined):
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected[d])
        if d in kept and expected[d]:
            assert kept[d] == (left, len(left))
        elif d in kept:
            assert kept[d][0] == text
        else:
            assert expected[d] and not left.strip(" \t\n\r\x0b\x0c")


def test_line_plans_hold_no_python(spark, lined):
    plan = lines.decide(frame(spark, lined))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# benchmark items


def test_items_within_their_edits(spark):
    draw = random.Random(4)
    items = [prose(draw.randint(10, 16), draw) for _ in range(10)] + ["tiny words", "x"]

    def damaged(t, n):
        b = list(t)
        for _ in range(n):
            p = draw.randrange(len(b))
            b[p : p + 1] = draw.choice([[], [draw.choice("abcxyz")], [b[p], draw.choice("abcxyz")]])
        return "".join(b)

    texts = []
    for k, t in enumerate(items[:10]):
        for share in (0.0, 0.05, 0.1, 0.2):
            texts.append(f"{prose(8, draw)} {damaged(t, int(len(t) * share))} {prose(6, draw)}")
        texts.append(prose(20, draw))
    texts += ["we say tiny  WORDS here", "tinywords", None, ""]
    rows = decontaminate.find(frame(spark, texts), spark.createDataFrame([*enumerate(items), (None, "z"), (99, None)], "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in rows}
    expected = {(d, k): n for d, text in enumerate(texts) if text for k, t in enumerate(items) if len(t) >= 16 and (n := brute.edits(t, text)) <= max(0, min(len(t) // 10, len(t) // 8 - 2))}
    assert len(expected) >= 24
    missed = [x for x in expected if x not in found]
    assert len(missed) <= 0.01 * len(expected) and {x for x in found if len(items[x[1]]) >= 16} <= set(expected)
    assert (len(texts) - 4, 10) in found and (len(texts) - 3, 10) not in found
    for (d, k), r in found.items():
        part = texts[d].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert r["distance"] == 0 or brute.edits(items[k], part) == r["distance"] == expected[d, k]
    kept = {r["doc_id"] for r in decontaminate.keep_clean(frame(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in found}


@pytest.mark.parametrize("lengths", [[20], [20] * 24 + [300], [16, 23, 20, 150, 600]])
def test_items_of_mixed_lengths(spark, lengths):
    """Short items, which allow no edits, alone and before longer ones."""
    draw = random.Random(12)
    items = [prose(140, draw)[:n].replace(" ", "q") if n < 24 else prose(140, draw)[:n].strip() for n in lengths]
    texts = [f"{prose(8, draw)} {t} {prose(6, draw)}" for t in items] + [f"{prose(8, draw)} {t[: len(t) // 2]}#{t[len(t) // 2 + 1 :]} {prose(6, draw)}" for t in items]
    rows = decontaminate.find(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    n = len(items)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == {(k, k, 0) for k in range(n)} | {(n + k, k, 1) for k in range(n) if len(items[k]) >= 24}


def test_long_items_edited_at_their_start(spark):
    draw = random.Random(14)
    item = prose(2400, draw)[:9000].strip()
    k = len(item) // 10 - 10
    start = "".join(draw.choice("qrstuv") if n < k else ch for n, ch in enumerate(item))  # all edits at the start
    windows = decontaminate.Items([0], [item.encode()])
    assert windows.passes([start.encode(), ("#" * 4096 + item[4096:]).encode()], [0, 0]).all()  # left to verification
    rows = decontaminate.find(frame(spark, [f"{prose(8, draw)} {start} {prose(6, draw)}", prose(50, draw)]), spark.createDataFrame([(0, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(0, 0)] and k - 60 <= rows[0]["distance"] <= k


def test_tables_come_from_all_items():
    draw = random.Random(13)
    short, long_ = ([prose(140, draw)[:n].encode() for _ in range(24)] for n in (30, 300))
    tables = lambda texts: decontaminate.Items(list(range(len(texts))), texts).tables
    assert tables(short + long_) >= 0.8 * tables(long_)


# passages


def test_shared_passages(spark):
    draw = random.Random(6)
    shared, fuzzy = prose(80, draw), prose(120, draw)
    texts = [prose(100, draw) + " " + shared, prose(50, draw) + " " + shared + " " + prose(70, draw), prose(30, draw), fuzzy, prose(40, draw) + " " + altered(fuzzy, 0.05, draw), prose(200, draw), None, ""]
    rows = passages.repeated(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(1, 0), (4, 3)}
    for r in rows:
        if r["doc_id"] == 1:
            assert texts[1][r["start_char"] : r["end_char"]] == shared == texts[0][r["source_start"] : r["source_end"]]
            assert r["n_words"] == r["n_matched"] == 80
        else:
            assert r["n_matched"] >= 0.9 * 120
    cut = {r["doc_id"]: r["text"] for r in passages.without(frame(spark, texts)).collect()}
    assert cut[1] == texts[1].replace(shared, "") and cut[0] == texts[0] and cut[6] is None


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    draw = random.Random(16)
    shared, fuzzy, one, two = prose(60, draw).split(" "), prose(150, draw).split(" "), prose(52, draw), prose(52, draw)
    text = lambda ws: f"{prose(40, draw)} {' '.join(ws)} {prose(40, draw)}"
    texts = [text(shared[:30]), text(shared[30:]), text(shared), text(shared)]  # neither half is a passage
    texts += [text(fuzzy[k : k + 30]) for k in range(0, 150, 30)] + [text(fuzzy), text(altered(" ".join(fuzzy), 0.05, draw).split(" "))]
    texts += [text([one, prose(38, draw), two]), text([one, prose(38, draw), two])]  # too unlike with what stands between
    rows = passages.repeated(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(3, 2), (10, 9), (12, 11)}
    spans = [texts[r["doc_id"]][r["start_char"] : r["end_char"]] for r in rows if r["doc_id"] != 10]
    assert sorted(spans) == sorted([" ".join(shared), one, two])
    cut = {r["doc_id"]: r["text"] for r in passages.without(frame(spark, texts)).collect()}
    assert cut[3] == texts[3].replace(" ".join(shared), "") and cut[2] == texts[2]


def test_every_exact_passage_is_found(spark):
    """Passages of 51 to 90 words whose parts also stand elsewhere, against all runs of all texts."""
    draw = random.Random(21)
    shared = [prose(draw.randint(51, 90), draw).split(" ") for _ in range(12)]
    texts = []
    for k in range(60):
        ws = draw.choice(shared)
        if k % 3 == 0:  # a part under 50 words
            low = draw.randrange(len(ws) - 35)
            ws = ws[low : low + 35]
        texts.append(f"{prose(draw.randint(30, 60), draw)} {' '.join(ws)} {prose(draw.randint(30, 60), draw)}")
    pairs = brute.run_lengths(texts, 50)
    later = {b for b, _ in pairs}
    found = passages.repeated(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in found} >= later and len(later) > 20
    near_ = brute.run_lengths(texts, 30)
    assert {(r["doc_id"], r["source_id"]) for r in found} <= near_


def test_passages_that_no_first_or_last_document_holds(spark):
    """The first and last documents of all seeds and runs hold 46 words of a passage of 52, or a third of one with changed words."""
    draw = random.Random(31)
    shared, fuzzy = prose(52, draw).split(" "), prose(90, draw).split(" ")
    text = lambda ws: f"{prose(40, draw)} {' '.join(ws)} {prose(40, draw)}"
    parts = [shared[:46], shared[6:], *(fuzzy[k : k + 30] for k in range(0, 70, 10))]
    texts = [text(ws) for ws in parts]
    whole = [text(shared), text(shared), text(fuzzy), text(altered(" ".join(fuzzy), 0.05, draw).split(" "))]
    texts = [*texts, *whole, *(text(ws) for ws in parts)]
    rows = passages.repeated(frame(spark, texts)).collect()
    n = len(parts)
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(n + 1, n), (n + 3, n + 2)}
    assert {texts[r["doc_id"]][r["start_char"] : r["end_char"]] for r in rows if r["doc_id"] == n + 1} == {" ".join(shared)}


def test_documents_that_share_no_more_than_two_seeds_all_meet(spark, monkeypatch):
    """Many documents with one run of 30 words, of which pairs share more: blocks of few rows give the same as brute force."""
    monkeypatch.setattr(passages, "BLOCK", 8)
    draw = random.Random(32)
    common = prose(30, draw)
    ends = [prose(30, draw) for _ in range(30)]
    texts = [f"{prose(30, draw)} {common} {ends[k % 30] if 10 <= k < 70 else prose(30, draw)} {prose(30, draw)}" for k in range(80)]
    rows = passages.repeated(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(k + 30, k) for k in range(10, 40)}


def test_rows_that_have_met_all_classes_are_not_asked_again():
    mid = np.arange(2, 62, dtype=np.uint32).tobytes()
    early = [(doc, 5, b"", mid, b"") for doc in (0, 1)]
    asked = lambda doc, most: [(b, a) for b, a, _, _ in passages.meet(early, [(doc, 7, b"", mid, b"", set())], most, 33, 50, 0.8)]
    assert asked(2, 1) == [(2, 0), (2, None)]
    assert asked(2, 2) == [(2, 0), (2, 1)]
    assert asked(1, 1) == [(1, 0)]


# fingerprints


def test_fingerprints(spark, copies):
    rows = {r["doc_id"]: r for r in simhash.fingerprint_documents(frame(spark, copies)).collect()}
    assert len(rows) == len(copies)
    for d, text in enumerate(copies):
        text, ahead = text or "", copies[(d + 1) % len(copies)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + ahead[:k]
        assert (rows[d]["n_chars"], rows[d]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[d]["near_edited"] <= 1 and 0 <= rows[d]["near_next"] <= 1
        if edited == text:
            assert rows[d]["near_edited"] == 1
    assert rows[0]["fingerprint"] == rows[12]["fingerprint"]
    long_ = [d for d in range(12)]
    assert np.mean([rows[d]["near_edited"] for d in long_]) > np.mean([rows[d]["near_next"] for d in long_]) + 0.1


def test_fingerprint_bits(spark, copies):
    rows = {r["doc_id"]: r for r in simhash.fingerprint_documents(frame(spark, copies)).collect()}
    prints = {d: brute.fingerprint(t) for d, t in enumerate(copies)}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for d, text in enumerate(copies):
        text, ahead = text or "", copies[(d + 1) % len(copies)] or ""
        edited = brute.fingerprint(text[: len(text) - len(text) // 4] + ahead[: len(text) // 4])
        r = rows[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[d], edited)
        assert (r["near_edited"], r["near_next"]) == (1 - apart(prints[d], edited) / 128, 1 - apart(prints[d], prints[(d + 1) % len(copies)]) / 128)
        assert r["n_within"] == (sum(apart(prints[d], p) <= 3 for p in prints.values()) if d % 50 == 0 else None)


def test_fingerprints_never_stage_all_texts_at_once(spark, monkeypatch):
    """Shuffle files lie beside a table while it is written: none holds the texts of half the rows; all have their own number."""
    seen, stage = [], simhash.Scratch.stage

    def watch(self, df, name, tidy=True):
        out = stage(self, df, name, tidy)
        if {"text", "head"} & set(out.columns):
            seen.append((name, out.count(), [r["row"] for r in out.select("row").collect()] if "row" in out.columns else []))
        return out

    monkeypatch.setattr(simhash.Scratch, "stage", watch)
    texts = [prose(20) for _ in range(400)]
    df = frame(spark, texts).union(frame(spark, [None, "a b", "a b"], 7)).union(frame(spark, ["c d", "e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert simhash.fingerprint_documents(df).count() == 405
    numbers = [n for _, _, own in seen for n in own]
    assert len(numbers) == len(set(numbers)) == 405
    assert max(n for _, n, _ in seen) < 405 / 2


def test_block_tables_find_all_within_the_radius(spark):
    draw = random.Random(9)
    start = [draw.getrandbits(128) for _ in range(6)]
    prints = start + [s ^ sum(1 << b for b in draw.sample(range(128), n)) for s in start for n in (1, 2, 3, 4, 6)]
    halves = lambda v: tuple(x - (1 << 64) * (x >> 63) for x in (v & (1 << 64) - 1, v >> 64))
    df = spark.createDataFrame([halves(v) for v in prints], "f0 bigint, f1 bigint")
    found = {(r["q0"], r["q1"], r["f0"], r["f1"]) for r in simhash.within(df, df, 3).collect()}
    assert found == {(*halves(a), *halves(b)) for a in prints for b in prints if (a ^ b).bit_count() <= 3}


# classifiers


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    texts = [r["text"] for r in docs.where("text is not null").limit(40).collect()]
    raw = [t.encode() for t in texts]
    x = language.vectors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    losses = model.losses(x)
    for m, got in zip(model.margins(x), losses):
        best, expected = brute.decode(m.tolist(), model.code.tolist(), model.weight.tolist())
        assert np.allclose(got, expected, atol=1e-4) and got.argmin() == best


def test_many_languages_are_bounded():
    assert language.LANGUAGES * max(20, language.ROWS // language.LANGUAGES) * language.SIZE * 2 <= 200e6


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        c = language.codewords(n)
        assert c.shape[0] == n and all((c[a] != c[b]).sum() >= max(1, c.shape[1] // 4) for a in range(n) for b in range(a))


def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


def test_discriminant(spark):
    draw = np.random.default_rng(4)
    rows = [(draw.normal(k, 1 + k, quality.D), k) for k in (0, 1) for _ in range(60)]
    sums = {}
    for x, k in rows:
        one = np.append(1, x)
        sums[k] = sums.get(k, 0) + np.outer(one, one)
    model = quality.Discriminant({k: (s[0, 0], s[0, 1:], s[1:, 1:]) for k, s in sums.items()})
    plain = brute.discriminant(rows)
    assert np.allclose(model.difference(np.array([x for x, _ in rows])), [plain(x) for x, _ in rows])


def test_chain_on_rows_that_it_has_not_seen(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.where("doc_id % 4 <> 1").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    rows = toxicity.classify(docs, known).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    toxic = [r["said"] for r in rows if r["toxic"] == 1]
    assert np.mean([r["said"] == r["toxic"] for r in rows]) > 0.93 and toxic and np.mean(toxic) > 0.6


def test_toxic_texts(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.classify(docs, labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert np.mean([r["said"] == r["toxic"] for r in rows]) > 0.95


# archives


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>\r\n\r\nWARC/1.1 é") for k in range(10)] + [(None, None, None), (3, "http://x/3", "again")], "page_id bigint, url string, html string")
    fixity.write_archives(pages, f"{tmp_path}/w", 4)
    rows = fixity.read_archives(spark, f"{tmp_path}/w").collect()
    assert len(rows) == 12 and all(r["whole"] for r in rows)
    assert sorted(bytes(r["body"]).decode() for r in rows) == sorted([f"<p>{k}</p>\r\n\r\nWARC/1.1 é" for k in range(10)] + ["", "again"])
    file = next(p for p in (tmp_path / "w").rglob("part-*"))
    data = bytearray(file.read_bytes())
    data[10] ^= 1
    file.write_bytes(bytes(data)[:-7])
    for crc in (tmp_path / "w").rglob(".*.crc"):
        crc.unlink()
    damaged = fixity.read_archives(spark, f"{tmp_path}/w").collect()
    assert sum(not r["whole"] for r in damaged) >= 1 and sum(r["whole"] for r in damaged) >= 8


def test_archives_are_audited_against_their_layout(spark, tmp_path):
    """What is read back from written archives has the manifest of their layout; a changed byte is found, and equal subtrees are not read."""
    from proofmill.llm.util import Scratch

    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k} {'y' * 900}</p>") for k in range(400)], "page_id bigint, url string, html string")
    scratch = Scratch(spark)
    fixity.write_archives(pages, f"{tmp_path}/w", 100)
    keys = ["archive", "offset", "length", "digest"]
    left = scratch.stage(fixity.layout(pages, scratch, "plan", 100).select(*keys), "plan_rows")
    read = fixity.manifest_of(fixity.read_archives(spark, f"{tmp_path}/w"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, left.collect()))
    file = next((tmp_path / "w" / "archive=2").glob("part-*"))
    data = bytearray(file.read_bytes())
    at = data.find(b"<p>250 ") + 20
    data[at] ^= 1
    file.write_bytes(bytes(data))
    for crc in (tmp_path / "w").rglob(".*.crc"):
        crc.unlink()
    right = scratch.stage(fixity.manifest_of(fixity.read_archives(spark, f"{tmp_path}/w")), "read_rows")
    found = fixity.audit(left, right, scratch).collect()
    assert [(r["archive"], r["kind"]) for r in found] == [(2, "changed")] and found[0]["offset"] <= at < found[0]["offset"] + found[0]["length"]
    shape = fixity.shape_of(left, right)
    a, b = fixity.tree(left, shape, scratch, "a"), fixity.tree(right, shape, scratch, "b")
    _, seen = fixity.descend(a, b, shape, scratch)
    assert len(seen) == len(shape) + 1 and seen[0] == 1 and seen[-1] < 100 and sum(seen) < 0.4 * left.count()
    assert fixity.descend(a, a, shape, scratch)[1] == [1]  # nothing below equal roots


def test_audit_finds_each_damage(spark):
    from proofmill.llm.util import Scratch

    rows = [(a, o * 40000, 40000, f"d{a}-{o}") for a in range(40) for o in range(9)]
    left = spark.createDataFrame(rows, "archive bigint, offset bigint, length bigint, digest string")
    other = [r for r in rows if r[:2] != (7, 8 * 40000)]
    other = [(a, o, n, "bad") if (a, o) == (3, 80000) else (a, o, n, d) for a, o, n, d in other] + [(50, 0, 10, "new")]
    other = [(a, o + 5, n, d) if (a, o) == (20, 320000) else (a, o, n, d) for a, o, n, d in other]
    right = spark.createDataFrame(other, left.schema)
    found = {(r["archive"], r["offset"], r["kind"], r["moved_to"]) for r in fixity.audit(left, right, Scratch(spark)).collect()}
    assert found == {(3, 80000, "changed", None), (7, 320000, "missing", None), (20, 320000, "moved", 320005), (50, 0, "extra", None)}
    assert fixity.audit(left, left, Scratch(spark)).count() == 0
    assert fixity.audit(left.limit(0), left.limit(0), Scratch(spark)).count() == 0


def test_op8_sql(spark):
    from compare import of_duckdb, of_spark

    assert set(ORACLE_SQL) <= set(QUERIES)
    assert of_spark(QUERIES["op8_fixity"](spark, SF)) == of_duckdb(ORACLE_SQL["op8_fixity"], SF)


# odd tables


RUNS = {
    "packing": lambda d, lab: packing.pack(d), "near": lambda d, lab: near.near_groups(d), "keep_one": lambda d, lab: near.keep_one(d), "lines": lambda d, lab: lines.decide(d), "dedup": lambda d, lab: lines.dedup(d),
    "items": lambda d, lab: decontaminate.find(d, d.select(F.col("doc_id").alias("item_id"), "text")), "passages": lambda d, lab: passages.repeated(d), "without": lambda d, lab: passages.without(d),
    "fingerprints": lambda d, lab: simhash.fingerprint_documents(d), "language": lambda d, lab: language.identify(d), "keep_known": lambda d, lab: language.keep_known(d), "keep_clean": lambda d, lab: decontaminate.keep_clean(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")), "quality": lambda d, lab: quality.score(d, lab),
    "toxicity": lambda d, lab: toxicity.classify(d, lab), "fixity": lambda d, lab: fixity.compare(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key")),
}
#: Rows for each document, whatever its text.
PER_DOCUMENT = {"near", "lines", "fingerprints", "language", "quality", "toxicity", "without"}


@pytest.mark.parametrize("name", list(RUNS))
def test_odd_tables(odd, none, labels, name):
    rows = RUNS[name](odd, labels).collect()
    if name in PER_DOCUMENT:
        assert len(rows) == odd.count()
    assert RUNS[name](none, labels).count() == 0
    assert RUNS[name](odd, labels.limit(0)).count() == len(rows)


def test_odd_values(odd):
    said = {(r["doc_id"], r["lang_pred"]) for r in language.identify(odd).collect()}
    assert (0, "und") in said
    assert {r["doc_tokens"] for r in packing.pack(odd).where("doc_id = 2").collect()} >= {2}
    assert {r["component_id"] for r in near.near_groups(odd).where("doc_id is null").collect()} == {None}


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == names and 0.5 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()

