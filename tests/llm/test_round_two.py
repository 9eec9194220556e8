"""Edges that decide, foreign columns, odd ids, tables cut in, and plain versions of whole stages."""

from __future__ import annotations

import base64
import itertools
import random
import re
import struct
import time

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, langid, linededup, lmscore, mainhtml, minhash, mixing, mpegts, quality
from quarry.llm.queries import QUERIES

SENTENCE = "A sentence of the story goes on for quite a while, as it should. "


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a heading and a date line, both unmarked and both weak, between paragraphs
        (f"<div><p>{SENTENCE * 2}</p><h2>Part two</h2><p>12 May</p><p>{SENTENCE * 2}</p></div>", f"{SENTENCE * 2}Part two 12 May {SENTENCE * 2}".strip()),
        # a plain item among links goes with the links
        ("<div><p><a href=1>Home</a></p><p><a href=2>News</a></p><p>You are here now, on this page of ours.</p><p><a href=3>Sport</a></p><p><a href=4>Fun</a></p></div>", ""),
        # a paragraph that is one link stays in its article
        (f"<article><p>{SENTENCE}</p><p><a href=x>See the whole table</a></p><p>{SENTENCE}</p></article>", f"{SENTENCE}See the whole table {SENTENCE}".strip()),
    ],
)
def test_edges_decide(page, text):
    assert mainhtml.main_text(page) == text
    found = mainhtml.blocks(page)
    alone = mainhtml.labels([mainhtml.evidence(b) for b in found], [])
    assert " ".join(b.text for b, k in zip(found, alone, strict=True) if k) != text


def test_flow_runs_and_changes_labels_on_the_given_pages(spark, monkeypatch):
    calls, cut = [], mainhtml.cut
    monkeypatch.setattr(mainhtml, "cut", lambda *a: calls.append(1) or cut(*a))
    changed = 0
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").toPandas()["html"]
    for page in pages:
        found = mainhtml.blocks(page)
        scores = [mainhtml.evidence(b) for b in found]
        changed += sum(k != (s > 0) for k, s in zip(mainhtml.labels(scores, mainhtml.smoothness(found)), scores, strict=True))
    assert len(calls) > 0.9 * len(pages) and changed > 0


def test_pages_without_telling_elements(spark):
    """Articles, menus and footers as plain boxes: most pages keep their text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").toPandas()["html"]
    right = 0
    for page in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        plain = re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b[^>]*>", r"<\1div>", page)
        right += mainhtml.main_text(plain) == mainhtml.main_text(f"<article>{inner}</article>")
    assert right > 0.9 * len(rows)


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", "<article><p>Text.</p></article>", "clash", 7), (1, "u", "<article><p>Text.</p></article>", "clash", 7), (None, None, None, None, None), (2, "u", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = mainhtml.with_main_text(df).collect()
    assert sorted(r["text"] for r in got) == ["", "", "Text.", "Text."] and sorted(str(r["n_chars"]) for r in got) == ["1", "7", "7", "None"]
    assert mainhtml.with_main_text(df.limit(0)).count() == 0


def test_stray_end_tags_cost_no_walk():
    def took(n):
        began = time.perf_counter()
        mainhtml.blocks("<div>" * n + "</b>" * n)
        return time.perf_counter() - began

    took(2_000)
    assert took(40_000) < 40 * max(took(4_000), 0.004)


# language


def test_letters_are_letters_in_both_readings(make):
    model = langid.fit(make([(0, "eins ½ zwei", "de", "s"), (1, "one Ⅷ two", "en", "s"), (2, "uno x² dos", "es", "s")]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.with_language(make(["½ ²", "Ⅷ", "zwei", "two", "x²", "\u0301"]), model).collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "de", "en", "es", "und"] and got[0][1] == got[1][1] == 0.0


def plain_language(train, text, languages):
    """Word-first backoff by counting with plain dictionaries."""
    import regex

    counts = [{k: {} for k in languages} for _ in range(langid.ORDER + 1)]
    for t, k in train:
        for w in regex.findall(r"\p{L}+", t.lower()):
            counts[0][k][w] = counts[0][k].get(w, 0) + 1
            ended = f" {w} "
            for order in range(1, langid.ORDER + 1):
                for i in range(len(ended) - order + 1):
                    g = ended[i : i + order]
                    if g != " ":
                        counts[order][k][g] = counts[order][k].get(g, 0) + 1

    def log(order, item, k):
        size = len(set().union(*counts[order].values()))
        return np.log((counts[order][k].get(item, 0) + 0.5) / (sum(counts[order][k].values()) + 0.5 * size))

    def known(order, item):
        return any(item in counts[order][k] for k in languages)

    words = regex.findall(r"\p{L}+", text.lower())
    scores = dict.fromkeys(languages, 0.0)
    for w in words:
        if known(0, w):
            items = [(0, w)]
        else:
            ended = f" {w} "
            items = next((x for order in range(min(langid.ORDER, len(ended)), 0, -1) if (x := [(order, g) for i in range(len(ended) - order + 1) if known(order, g := ended[i : i + order])])), [])
        for k in languages:
            scores[k] += sum(log(o, g, k) for o, g in items) / max(1, len(items))
    mean = [scores[k] / len(words) for k in languages]
    best = int(np.argmax(mean))
    return languages[best], 1 / sum(np.exp((m - mean[best]) * min(len(words), langid.EVIDENCE)) for m in mean)


def test_language_equals_a_plain_backoff(make):
    rng = random.Random(5)
    stems = {"aa": ["abra", "cad", "abr"], "bb": ["bron", "cabr", "dob"], "cc": ["zuk", "abz", "kuz"]}
    train = [(" ".join(rng.choice(stems[k]) + rng.choice(["", "a", "on"]) for _ in range(9)), k) for k in rng.choices(sorted(stems), k=30)]
    rows = ["".join(rng.choice("abrcdonzuk  ") for _ in range(40)) for _ in range(40)] + ["qqq wx", "abra " * 20_000]
    model = langid.fit(make([(i, t, k, "s") for i, (t, k) in enumerate(train)]))
    got = {r["doc_id"]: r for r in langid.with_language(make(rows), model).collect()}
    for i, text in enumerate(rows):
        lang, score = plain_language(train, text, sorted(stems))
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4), text[:50]


def test_language_ties_and_empty_tables(make):
    model = langid.fit(make([(0, "same", "bb", "s"), (1, "same", "aa", "s")]))
    assert [(r["lang_pred"], r["score"]) for r in langid.with_language(make(["same", "same", "qq"]), model).collect()] == [("aa", 0.5)] * 3
    assert langid.with_language(make([]), model).count() == 0


# LM scores


def test_scores_within_equal_scores_beside(make):
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["a", "b", "ab", "Dog!!", "7"]) for _ in range(rng.randint(0, 40))), "en", "s") for i in range(60)]
    rows += [rows[0], rows[0], (None, "a b a", "en", "s"), (None, None, "en", "s"), (None, "a b a", "en", "s"), (90, "", "en", "s"), (91, "long " * 40_000, "en", "s")]
    df = make(rows)
    chosen = df.filter("doc_id % 3 = 0").select("doc_id").union(df.filter("doc_id is null").select("doc_id"))
    flagged = df.select("text", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)).alias("target"))
    beside = lmscore.with_scores(df, flagged)
    assert "kept" in beside.columns and beside.columns.count("score") == 1  # a clashing column is replaced, others stay
    names = ("doc_id", "n_tokens", "target_loss", "background_loss", "score")

    def told(rows):
        return sorted(tuple(str(r[c]) if c == "doc_id" else round(r[c], 9) for c in names) for r in rows)

    monkeyed = lmscore.scores_within(df, chosen).collect()
    assert told(monkeyed) == told(beside.collect()) and len(monkeyed) == len(rows)
    assert lmscore.scores_within(make([]), chosen).count() == 0


def test_many_chunks_and_ranges_give_the_same_scores(make, monkeypatch):
    rng = random.Random(17)
    rows = [" ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["the same text of all"] * 30
    df = make(rows, extra=False)
    chosen = df.filter("doc_id % 4 = 1").select("doc_id")
    one = {r["doc_id"]: r for r in lmscore.scores_within(df, chosen).collect()}
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 700)
    assert lmscore.chunks_of(df) > 10
    many = {r["doc_id"]: r for r in lmscore.scores_within(df, chosen).collect()}
    assert one.keys() == many.keys() and all(one[i]["score"] == pytest.approx(many[i]["score"], abs=1e-12) and one[i]["n_tokens"] == many[i]["n_tokens"] for i in one)


# media


def read_plainly(stream):
    """The payload of the first elementary stream, read bit by bit by the standard's layout."""
    bits = {}
    sections = {}
    pmt = data = None
    pes = []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid = int.from_bytes(p[1:3], "big") % 8192
        first, control = p[1] // 64 % 2, p[3] // 16 % 4
        if control % 2:
            if pid in bits:
                assert p[3] % 16 == (bits[pid] + 1) % 16
            bits[pid] = p[3] % 16
        body = p[4:] if control == 1 else p[5 + p[4] :] if control == 3 else b""
        if pid in (0, pmt):
            sections[pid] = body[1:] if first else sections[pid] + body
            s = sections[pid]
            size = int.from_bytes(s[1:3], "big") % 4096
            if len(s) >= size + 3:
                if pid == 0:
                    pmt = int.from_bytes(s[10:12], "big") % 8192
                else:
                    skip = 12 + int.from_bytes(s[10:12], "big") % 4096
                    data = int.from_bytes(s[skip + 1 : skip + 3], "big") % 8192
        elif pid == data:
            if first:
                pes.append(body)
            elif pes:
                pes[-1] += body
    out = b""
    for x in pes:
        assert x[:3] == b"\0\0\1" and int.from_bytes(x[4:6], "big") in (0, len(x) - 6)
        out += x[9 + x[8] :]
    return out


@pytest.mark.parametrize("n", [0, 5, 16_384, 16_385, 700_000])
def test_another_reader_reads_the_streams(n):
    payload = mpegts.padded("".join(random.Random(n).choices("abcé\n ", k=n)))
    assert read_plainly(mpegts.mux(payload)) == payload


def test_media_query_against_another_reader(spark, sf_dir, texts):
    done = mpegts.with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "media", "n_bytes").collect()
    for r in done:
        data = (texts[r["doc_id"]]["text"] or "").encode()
        assert read_plainly(bytes(r["media"]))[: len(data)] == data and r["n_bytes"] == len(data)


def test_cut_in_reads_from_the_next_entry_point():
    payload = mpegts.padded("0123456789" * 60_000)
    stream = mpegts.mux(payload)
    got = mpegts.demux(stream[188 * 1500 :])
    assert got.errors == 0 and got.programs and got.times[0][2]
    assert payload.endswith(got.data[mpegts.DATA_PID]) and len(got.data[mpegts.DATA_PID]) % 192 == len(payload) % mpegts.UNIT % 192
    assert len(got.data[mpegts.DATA_PID]) > len(payload) - 1500 * 184 - mpegts.UNIT * mpegts.RANDOM_ACCESS


def test_sections_over_several_packets():
    streams = b"".join(struct.pack(">BHH", 6, 0xE000 | 0x200 + i, 0xF000) for i in range(60))
    table = mpegts.section(2, 1, struct.pack(">HH", 0xE000 | 0x200, 0xF000) + streams)
    assert len(table) > 300
    packets = mpegts.section_packets(mpegts.PMT_PID, table)
    assert len(packets) == 2
    got = mpegts.demux(b"".join(mpegts.section_packets(0, mpegts.ASSOCIATION) + packets))
    assert got.errors == 0 and len(got.kinds) == 60
    again = mpegts.section_packets(mpegts.PMT_PID, table, 2)
    assert mpegts.demux(b"".join(mpegts.section_packets(0, mpegts.ASSOCIATION) + packets[:1] + again[1:])).errors >= 1  # a lost half
    # two sections in one packet, the second of which goes on in the next: the pointer says where one begins
    body = mpegts.ASSOCIATION + table
    joined = [struct.pack(">BHB", 0x47, 0x4000, 0x10) + b"\0" + mpegts.ASSOCIATION.ljust(183, b"\xff")]
    first = (b"\0" + mpegts.MAP + table)[:184]
    rest = (mpegts.MAP + table)[183:]
    joined += [struct.pack(">BHB", 0x47, 0x4000 | mpegts.PMT_PID, 0x10) + first]
    joined += [(struct.pack(">BHB", 0x47, mpegts.PMT_PID, 0x10 | 1 + i) + rest[k : k + 184]).ljust(188, b"\xff") for i, k in enumerate(range(0, len(rest), 184))]
    got = mpegts.demux(b"".join(joined))
    assert got.errors == 0 and len(got.kinds) == 61 and body


# near duplicates


def planted(rng, n):
    """Texts with planted near copies of similarities around the threshold."""
    rows = []
    for g in range(n):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 300))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_recall_on_planted_links(make, percent, size):
    rows = planted(random.Random(percent), 150)
    sets = {i: brute.shingles(t, size) for i, t in enumerate(rows)}
    want = brute.components(sets, percent)
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(make(rows, extra=False), percent, size).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 150 and sum(got[i] == want[i] for i in linked) >= 0.999 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)  # no link that isn't there


def test_groups_on_all_given_documents(spark):
    """Recall against all pairs that share a shingle, over the whole of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: brute.shingles(r["text"]) for r in docs.collect()}
    want = brute.components(sets)
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(docs).collect()}
    assert got == want


def test_very_long_texts(make):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [long, long + " tail", "short text of five words", "\n".join(["a line"] * 50_000)]
    got = {r["doc_id"]: r for r in minhash.groups(make(rows)).collect()}
    assert got[1]["component_id"] == 0 and got[0]["n_shingles"] == 119_998 and got[2]["component_id"] == 2
    lines = {r["doc_id"]: r for r in linededup.deduplicated(make(rows + ["a line"] * 9)).collect()}
    assert lines[3]["n_lines"] == 50_000 and lines[3]["kept_text"] == "" and lines[0]["kept_text"] == long
    kept = {r["doc_id"]: r for r in quality.measured(make(rows)).collect()}
    assert kept[0]["n_words"] == 120_000 and kept[3]["n_repeat_words"] == 100_000
    assert quality.measured(make([])).count() == 0


# common


def test_parts_by_bitmap(spark, make):
    df = make([(i if i % 10 else None, f"t{i}", "en", "s") for i in range(2_000)])
    wanted = df.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("w"))
    inside, outside = common.parted(df, ["doc_id"], wanted)
    a, b = ([r["doc_id"] for r in x.collect()] for x in (inside, outside))
    assert sorted(map(str, a + b)) == sorted(str(r["doc_id"]) for r in df.collect()) and inside.columns == df.columns == outside.columns
    assert {i for i in a if i is not None} >= {i for i in range(2_000) if i % 10 and i % 7 == 0} and len(a) < 300 and None in b
    inside, outside = common.parted(df, ["doc_id"], wanted.limit(0))
    assert inside.count() == 0 and outside.count() == 2_000


def test_no_local_folder_on_a_cluster():
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, master):
            self.sparkContext, self.given = Context(master), {}
            self.conf = self

        def get(self, key, default=None):
            return self.given.get(key, default)

        def set(self, key, value):
            self.given[key] = value

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(Session(master))
    own = Session("local[4]")
    assert common.shared_folder(own) == own.given["spark.checkpoint.dir"]


# mixing


def test_rows_without_ids_meet_their_targets(make):
    rows = [(None, " ".join(["w"] * (1 + i % 7)) + f" x{i}", "en", f"s{i % 3}") for i in range(3_000)]
    got = mixing.rates(make(rows)).collect()
    for s in range(3):
        own = [r for r in got if r["source"] == f"s{s}"]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < 0.1 * own[0]["target"]


# the pipeline

PROSE = "This is a perfectly fine sentence number {0} with enough different words like {1} to be kept, as it should be."


def stage(number, spark, docs):
    return corpus_pipeline.STAGES[number][1](spark, docs, None)


def plain_verdict(text):
    """The quality verdict and the lines that stay, by the rules as the module states them."""
    w = brute.words(text)
    lines = (text or "").split("\n")
    fails = [line_fails(x) for x in lines]
    worded = [bool(brute.words(x)) for x in lines]
    chars = sum(len(x) for x, k in zip(lines, worded, strict=True) if k)
    lost = sum(len(x) for x, k, f in zip(lines, worded, fails, strict=True) if k and f)
    kept = "\n".join(x for x, k, f in zip(lines, worded, fails, strict=True) if not (k and f))
    return not brute.quality(text)[5] and 2 * lost <= chars and bool(w), kept


def line_fails(x):
    n = len(x)
    stock = r"(?i)all rights reserved|copyright (\(c\)|©|\d{4})|©|privacy policy|terms of (use|service)|cookie (policy|settings)|(accept|uses?) cookies|enable javascript|lorem ipsum|sign (in|up) |log ?in to|subscribe to|click here|share (this|on)|powered by"
    shouts, bars = len(re.findall(r"[!?]{2,}", x)), len(re.findall("[|•·»›→]", x))
    return (
        10 * len(re.findall(r"[#*$%&<>{}=~^\\_]", x)) >= n
        or shouts >= 3 and 20 * shouts >= n
        or bars >= 2 and 25 * bars >= n
        or n <= 240 and re.search(stock, x) is not None
        or n <= 24 and re.search(r"[.!?…:;。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*\Z", x) is None
    )


def odd_documents(make):
    rng = random.Random(21)
    rows = [(i, PROSE.format(i, rng.random()) + "\nA line that all of them have in common, word for word.\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + ".", "en", f"s{i % 3}") for i in range(14)]
    rows += [(30, rows[3][1], "en", "s1"), (31, rows[3][1] + " And more.", "en", "s1"), (None, rows[3][1], "en", "s0"), (None, PROSE.format("x", "y"), "en", None), (None, PROSE.format("x", "y"), "en", None)]
    rows += [(40, PROSE.format("q", "r"), "en", "s0"), (40, PROSE.format("q", "r"), "en", "s0"), (41, PROSE.format("m", "n"), "de", "s0"), (41, PROSE.format("completely", "unlike") * 2, "de", "s0")]
    rows += [(50, "Menu | a | b | c\n" + PROSE.format("z", "z") + "\nshort", "en", "s0"), (51, "too few words here", "en", "s0"), (52, "spam " * 500, "en", "s2"), (53, "", "en", "s0"), (None, None, None, None), (54, "a | b | c | d | e | f | g | h | i\n" * 9 + "One line of ten words that stands at the end here.", "en", "s1")]
    return make(rows).withColumn("n_words", F.lit("clash")).withColumn("component_id", F.lit("clash")).withColumn("__row", F.lit("clash")).withColumn("copies", F.lit("clash"))


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_each_stage_against_a_plain_version(spark, make):
    docs = odd_documents(make)
    columns, clash = docs.columns, [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert len(clash) > 15
    start = collected(docs)

    def same_columns(df, rows):
        assert df.columns == columns and all(r[c] == "clash" for r in rows for c in clash) and all(r["n_chars"] == len(r["text"]) for r in rows)

    key = lambda r: (str(r["doc_id"]), r["text"], str(r["lang"]), str(r["source"]))

    one = corpus_pipeline.written(stage(0, spark, docs), "one")
    rows = collected(one)
    same_columns(one, rows)
    want = [(str(r["doc_id"]), plain_verdict(r["text"])[1], str(r["lang"]), str(r["source"])) for r in start if plain_verdict(r["text"])[0]]
    assert sorted(map(key, rows)) == sorted(want) and 0 < len(rows) < len(start)

    two = corpus_pipeline.written(stage(1, spark, one), "two")
    after = collected(two)
    same_columns(two, after)
    seen = {}
    for r in rows:  # rows with equal id and text count as one document
        for k in {brute.line_key(x) for x in r["text"].split("\n")} - {""}:
            seen.setdefault(k, set()).add((str(r["doc_id"]), r["text"]))
    hot = {k for k, d in seen.items() if len(d) >= 10}
    assert len(hot) == 1
    left = sum(brute.line_key(x) in hot for r in after for x in r["text"].split("\n"))
    assert left == 1 and len(after) == len(rows)
    bare = lambda t: "\n".join(x for x in t.split("\n") if brute.line_key(x) not in hot)
    assert sorted(bare(r["text"]) for r in after) == sorted(bare(r["text"]) for r in rows)

    three = corpus_pipeline.written(stage(2, spark, two), "three")
    kept = collected(three)
    same_columns(three, kept)
    sets = {i: brute.shingles(r["text"], 5) for i, r in enumerate(after)}
    group = brute.components(sets, 80)
    by_id = {}
    for i, r in enumerate(after):  # rows under one doc_id are one group
        if r["doc_id"] is not None and r["doc_id"] in by_id:
            a, b = group[i], group[by_id[r["doc_id"]]]
            group = {k: b if g == a else g for k, g in group.items()}
        by_id.setdefault(r["doc_id"], i)
    first = {}
    for i, g in group.items():
        first.setdefault(g, []).append(after[i])
    assert len(kept) == len(first)
    best = [min((r["doc_id"] is None, r["doc_id"] or 0) for r in rs) for rs in first.values()]
    assert sorted(best) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert all(any(key(r) == key(x) for x in after) for r in kept)

    four = corpus_pipeline.written(stage(3, spark, three), "four")
    mixed = collected(four)
    same_columns(four, mixed)
    sizes = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    wanted = brute.targets(sizes)
    for r in kept:
        n = sum(key(x) == key(r) for x in mixed)
        rate = wanted[r["source"]] / sizes[r["source"]]
        assert int(rate + 1e-9) <= n <= min(2, int(rate + 1e-9) + 1)
    assert sorted(map(key, collected(stage(3, spark, three)))) == sorted(map(key, mixed))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    five = collected(stage(4, spark, four))
    assert sorted((str(r["doc_id"]), r["ids"], r["n_tokens"]) for r in five) == sorted((str(r["doc_id"]), ids := library.encode_ordinary(r["text"]), len(ids)) for r in mixed)


def test_quality_verdict_of_given_documents_against_a_plain_version(spark, sf_dir, texts):
    for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect():
        assert r["kept"] == plain_verdict(texts[r["doc_id"]]["text"])[0], r["doc_id"]


def test_weak_parts_against_a_plain_sweep(make):
    """Linking compared with all pairs of parts, over texts of random parts."""
    from quarry.llm import credentials

    rng = random.Random(31)
    bits = ["user=bob ", "login: alice ", "pwd=hunter2 ", "pass: s3cret99 ", "https://db.example.com/x ", "host=db1.local ", "AKIAABCDEFGH123456 ", "token=abcdefghijklmnop ", "\n\n", "\n", "prose goes here. " * 12, "api_key=short12 "]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    got = {r["doc_id"]: r["spans"] for r in credentials.findings(make(rows)).select("doc_id", credentials.listed(F.col("spans")).alias("spans")).collect()}
    for i, text in enumerate(rows):
        assert got[i] == plain_findings(text, credentials), text


def plain_findings(text, credentials):
    parts = []
    for n, k in enumerate(credentials.KINDS):
        for m in re.finditer(k.pattern, text):
            size = len(m[k.group])
            if size >= min(k.strong, k.weak):
                parts.append((m.start(), n, m.end(), k.role, size >= k.strong))
    breaks = [m.start() for m in re.finditer(r"\n[\x20\x09\x0B-\x0D]*(?=\n)", text)]
    scope = lambda at: sum(b <= at for b in breaks)
    out = []
    for a, n, b, role, strong in parts:
        others = [p for p in parts if p[:2] != (a, n) and scope(p[0]) == scope(a)]
        near = lambda what: any(r == what and (x - b <= credentials.REACH if x >= a else a - y <= credentials.REACH) for x, _, y, r, _ in others)  # noqa: E731, B023
        covered = any(s and x < b and y > a for x, _, y, _, s in others)
        linked = {"access": near("secret"), "secret": near("access"), "endpoint": near("access") and near("secret")}[role]
        if strong or linked and not covered:
            kind = credentials.WEAK_SECRET if n == 0 and not strong else n
            out.append((a, kind, b, credentials.KINDS[kind].name))
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(out))


def test_secrets_of_empty_tables(make):
    from quarry.llm import credentials

    assert credentials.findings(make([])).count() == 0


def test_cut_is_minimal_on_long_chains():
    rng = random.Random(12)
    for _ in range(40):
        n = rng.randint(9, 13)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(i, i + 2, rng.uniform(0, 0.5)) for i in range(n - 2) if rng.random() < 0.5]

        def cost(label, scores=scores, edges=edges):
            return sum(abs(s) for s, k in zip(scores, label, strict=True) if k != (s > 0)) + sum(w for i, j, w in edges if label[i] != label[j])

        assert cost(mainhtml.labels(scores, edges)) <= min(map(cost, itertools.product([False, True], repeat=n))) + 1e-9
